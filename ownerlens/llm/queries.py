"""Registered queries of the training-data operators, with check SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ownerlens.llm import bpe, chunks, counting, extraction, langid, leaks, manifest, quality, repeats, shards, simhash, spelling, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return add


@_query("op1_quality_rules", rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT doc_id, i, list_slice(w, i, i + {quality.WINDOW - 1}) AS s FROM w, unnest(range(1, len(w) - {quality.WINDOW - 2})) u(i)),
twin AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS p FROM twin) GROUP BY 1),
m AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS b FROM f WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT avg(b / n) AS m, coalesce(var_samp(b / n), 0) AS v, avg(1 / n) AS inv FROM h),
k AS (SELECT m, CASE WHEN v - m * (1 - m) * inv > 0 THEN greatest(1.0, least({quality.POOLED}, m * (1 - m) / (v - m * (1 - m) * inv) - 1))
                ELSE {quality.POOLED} END AS k FROM p),
r AS (SELECT source, round((b + m * k) / (n + k), 6) AS host_rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_rate, 0) <= {quality.MAX_HOST_RATE} AS kept, f.source, host_rate
FROM f LEFT JOIN r ON f.source = r.source""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.judge(_table(spark, folder, "documents"))


@_query("op2_html_extraction")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extraction.main_text(_table(spark, folder, "pages"))


@_query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    return langid.identify(_table(spark, folder, "documents"))


@_query("op4_url_filters")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url; labels reach a page by the document number in its path."""
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, urls.labelled_pages(pages, _table(spark, folder, "labels")))


@_query("op5_simhash_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.clusters(_table(spark, folder, "documents"))


@_query("op6_substring_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of documents that an earlier document holds already."""
    return chunks.repeated_passages(_table(spark, folder, "documents")).drop("rid")


@_query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after three edits derived from it."""
    return counting.count_edits(counting.sample_edits(_table(spark, folder, "documents")))


@_query("op8_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark questions, verbatim or with other slot values."""
    return leaks.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("rid")


def sharding_sql(limit: int) -> str:
    """Shards by the first 36 bits, which part rows with different ids."""
    return f"""
WITH r AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 9))::BIGINT AS h, strlen(coalesce(text, '')) + {shards.ROW_BYTES} AS n_bytes FROM documents),
d AS (SELECT doc_id, h, n_bytes, d, sum(n_bytes) OVER (PARTITION BY d, h >> (36 - d)) AS b, count(*) OVER (PARTITION BY d, h >> (36 - d)) AS n
      FROM r, unnest(range(0, 37)) u(d))
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(h >> (36 - d)), 36, '0'), d::INT) END AS shard, d::INT AS depth, n_bytes::BIGINT AS n_bytes,
       b::BIGINT AS shard_bytes, n::BIGINT AS shard_rows, b <= {limit} AS fits
FROM d WHERE b <= {limit} OR d = 36 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1"""


@_query("op9_sharding", sharding_sql(shards.LIMIT_BYTES))
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Shard of every document."""
    return shards.shard(_table(spark, folder, "documents"))


@_query("op10_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes decoded from them."""
    return bpe.digests(_table(spark, folder, "documents"))


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes: each byte is folded in, then eight shifts follow it."""
    byte = "('0x' || substr(hex(encode({t})), 2 * p - 1, 2))::BIGINT".format(t=text)
    steps = f"flatten([[{byte}, -1, -1, -1, -1, -1, -1, -1, -1] for p in range(1, strlen({text}) + 1)])"
    fold = "lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {fold}), 4294967295)"


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


@_query("op11_suffix_array_dedup", f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, substr(x, 2 * s - 1, {2 * repeats.LENGTH}) AS g FROM d, unnest(range(1, strlen(x) // 2 - {repeats.LENGTH - 2})) u(s)),
again AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
turn AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {repeats.LENGTH}, true)::INT AS new FROM again),
run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM turn),
span AS (SELECT doc_id, min(s) AS a, max(s) + {repeats.LENGTH} AS z FROM run GROUP BY doc_id, k),
gap AS (SELECT span.doc_id, a, z, substr(x, 2 * lag(z, 1, 1) OVER o - 1, 2 * (a - lag(z, 1, 1) OVER o)) AS piece, max(z) OVER (PARTITION BY doc_id) AS last
        FROM span JOIN d USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
left_ AS (SELECT doc_id, count(*) AS n, sum(z - a) AS gone, string_agg(piece, '' ORDER BY a) AS head, max(last) AS last FROM gap GROUP BY 1)
SELECT d.doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN x ELSE head || substr(x, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN left_ ON d.doc_id = left_.doc_id""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that stand in strings met earlier, and the digest of the rest."""
    return repeats.digests(_table(spark, folder, "documents"))


@_query("op12_spelling_variants", rf"""
WITH RECURSIVE
runs AS (SELECT doc_id, run FROM documents, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) u(run)),
sums AS (SELECT run, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs WHERE length(run) >= {spelling.MIN_LENGTH}),
cut AS (SELECT CASE WHEN h % {spelling.GARBLE} = 0 THEN left(run, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM sums),
w AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY 1 HAVING count(*) >= {spelling.MIN_COUNT}),
del AS (SELECT word, i, left(word, i - 1) || substring(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) u(i)),
near AS (SELECT a.word, b.word AS other FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT del.word, w.word FROM del JOIN w ON del.rest = w.word UNION SELECT w.word, del.word FROM del JOIN w ON del.rest = w.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS form, max(w.n) AS form_n FROM near JOIN w ON w.word = other GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.form_n >= {spelling.RATIO} * w.n THEN form END AS form,
             CASE WHEN best.form_n >= {spelling.RATIO} * w.n THEN form_n END AS form_n FROM w LEFT JOIN best ON w.word = best.word),
chain(word, root) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM f JOIN chain ON chain.word = f.word JOIN f e ON e.word = chain.root AND e.form IS NULL""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with its common form and its neighbours."""
    return spelling.variants(_table(spark, folder, "documents"))


@_query("op13_merkle_manifest", f"""
WITH RECURSIVE
d AS (SELECT *, CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t2 FROM documents),
leaf AS (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf('t2')} AS tampered FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size FROM leaf),
node(lvl, source, idx, size, h) AS (SELECT 0, source, idx, size, leaf FROM ranked UNION ALL
  SELECT lvl + 1, source, idx // 3, (max(size) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE size > 1 GROUP BY lvl, source, idx // 3),
sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS size FROM node WHERE size = 1),
top(lvl, idx, size, h) AS (SELECT 0, idx, size, h FROM sub UNION ALL
  SELECT lvl + 1, idx // 3, (max(size) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE size > 1 GROUP BY lvl, idx // 3),
low AS (SELECT r.source, r.idx AS leaf_idx, n.lvl, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx < r.idx // (3 ** n.lvl)::BIGINT), '') AS l,
          coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (n.idx > r.idx // (3 ** n.lvl)::BIGINT), '') AS r
        FROM ranked r JOIN node n ON r.source IS NOT DISTINCT FROM n.source AND n.size > 1 AND n.idx // 3 = r.idx // (3 ** (n.lvl + 1))::BIGINT GROUP BY 1, 2, 3),
high AS (SELECT s.source, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < s.idx // (3 ** t.lvl)::BIGINT), '') AS l,
           coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > s.idx // (3 ** t.lvl)::BIGINT), '') AS r
         FROM sub s JOIN top t ON t.size > 1 AND t.idx // 3 = s.idx // (3 ** (t.lvl + 1))::BIGINT GROUP BY 1, 2),
step AS (SELECT source, leaf_idx, lvl, l, r FROM low UNION ALL
  SELECT k.source, k.idx, 1000 + lvl, l, r FROM ranked k JOIN high ON k.source IS NOT DISTINCT FROM high.source),
path AS (SELECT source, leaf_idx, list([l, r] ORDER BY lvl) AS p FROM step GROUP BY 1, 2),
full_ AS (SELECT k.*, coalesce(p, []) AS p FROM ranked k LEFT JOIN path ON k.source IS NOT DISTINCT FROM path.source AND k.idx = leaf_idx),
fold AS (SELECT *, list_reduce(list_prepend([tampered, ''], p), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1] AS folded_root FROM full_)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(list_aggregate(flatten(p), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM fold JOIN sub ON fold.source IS NOT DISTINCT FROM sub.source JOIN top ON top.size = 1""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots, proof and check of every document."""
    return manifest.manifest(_table(spark, folder, "documents"))
