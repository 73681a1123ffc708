"""Search, report and alert operators as registered queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ownerlens import vocab as V
from ownerlens.functions import scoring as S
from ownerlens.operators import extract as X, links as L, reports as P, search as R
from ownerlens.plans import sqltext as Q
from ownerlens.plans.extract_queries import MENTIONS_SQL, mentions
from ownerlens.plans.feed_queries import report_articles
from ownerlens.plans.graph_queries import LINKED_SQL, linked
from ownerlens.plans.psc_queries import COUNTS_SQL
from ownerlens.plans.registry import query
from ownerlens.plans.text_queries import FULL, IMPORTANCE_SQL, SUMMARY_SQL, full_text
from ownerlens.session import materialise

c = F.col
WORD = "merger"


def _keyword_sql(limit):
    return (f"SELECT seq, published_at, row_number() OVER (ORDER BY published_at DESC, seq) AS r FROM articles_v "
            f"WHERE contains(lower(title), '{WORD}') OR contains(lower(raw_text), '{WORD}') ORDER BY r LIMIT {limit}")


def _vector_sql(limit):
    return f"""SELECT vec_id AS seq, d AS distance, row_number() OVER (ORDER BY d, vec_id) AS r FROM (SELECT vec_id,
  1.0 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings) x ORDER BY r LIMIT {limit}"""


def vectors(t):
    return t.embeddings.select(c("vec_id").alias("seq"), "embedding")


def query_vector(t):
    return t.embeddings.filter("vec_id = 0").select("embedding").scalar()


@query("srh01_keyword", f"SELECT seq FROM ({_keyword_sql(20)}) k")
def srh01(t):
    return R.keyword(t.articles_v, WORD.upper(), 20).select("seq")


@query("srh02_vector", f"SELECT seq, round(distance, 6) AS distance FROM ({_vector_sql(20)}) v")
def srh02(t):
    return R.vector(vectors(t), query_vector(t), 20).select("seq", F.round("distance", 6).alias("distance"))


_FUSED = f"""k AS ({_keyword_sql(40)}), v AS ({_vector_sql(40)}),
 f AS (SELECT seq, sum(1.0::DOUBLE / (r - 1 + 60)) AS score FROM (SELECT seq, r FROM k UNION ALL SELECT seq, r FROM v) u GROUP BY seq ORDER BY score DESC, seq LIMIT 20)"""


@query("win11_rank_fusion", f"WITH {_FUSED} SELECT seq, round(score, 9) AS score FROM f")
def win11(t):
    hits = R.fuse(R.keyword(t.articles_v, WORD, 40), R.vector(vectors(t), query_vector(t), 40), 20)
    return hits.select("seq", F.round("score", 9).alias("score"))


@query("srh03_hybrid", f"""WITH {_FUSED} SELECT 'hybrid' AS type, seq, round(score, 9) AS score FROM f
  UNION ALL SELECT 'latest', seq, 1.0::DOUBLE FROM (SELECT seq FROM articles_v ORDER BY published_at DESC, seq LIMIT 20) l""")
def srh03(t):
    some = R.hybrid(t.articles_v, vectors(t), WORD, query_vector(t), 20)
    none = R.hybrid(t.articles_v, vectors(t), "", None, 20)
    return some.unionByName(none).select("type", "seq", F.round("score", 9).alias("score"))


def _with_levels(t):
    return t.articles_v.withColumns({"summary": c("raw_text"), "risk_level": S.risk_bucket(c("risk_score"))})


_LEVEL = Q.case_floor("risk_score", V.RISK_FLOORS, "Low")


@query("srh04_concept", f"""WITH s AS (SELECT seq, CASE WHEN contains(lower(title), 'company') THEN 3 WHEN contains(lower(raw_text), 'company') THEN 1 ELSE 0 END
   + CASE WHEN contains(lower(title), 'merger') THEN 3 WHEN contains(lower(raw_text), 'merger') THEN 1 ELSE 0 END
   + CASE WHEN {_LEVEL} = 'High' THEN 2 ELSE 0 END AS score FROM articles_v) SELECT seq, score FROM s WHERE score > 0""")
def srh04(t):
    return R.concept(_with_levels(t), "High-risk company merger of").select("seq", "score")


_QUERIES = """q_v AS (SELECT entity_seq AS query_id, lower(name) AS q FROM dictionary_v UNION ALL SELECT -1 - entity_seq, lower(left(name, 3)) FROM dictionary_v)"""


@query("srh05_batch_search", f"""WITH {_QUERIES} SELECT query_id, seq, rank FROM (
  SELECT q.query_id, a.seq, row_number() OVER (PARTITION BY q.query_id ORDER BY a.published_at DESC, a.seq) AS rank
  FROM q_v q JOIN (SELECT seq, published_at, lower(concat(title, ' ', raw_text)) AS hay FROM articles_v) a ON contains(a.hay, q.q)) x WHERE rank <= 5""")
def srh05(t):
    d = t.dictionary_v
    queries = d.select(c("entity_seq").alias("query_id"), c("name").alias("query")).unionAll(
        d.select((F.lit(-1) - c("entity_seq")), F.left("name", F.lit(3))))
    text = F.concat_ws(" ", c("title"), c("raw_text"))
    return R.batch_keyword(t.articles_v, queries, text, 5).withColumn("rank", c("rank").cast("bigint"))


_NEAREST = """near_v AS (SELECT q.vec_id AS query_id, e.vec_id AS seq, round(1.0 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance
  FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0),
 vec_v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, seq) AS rank FROM near_v)"""


@query("srh05_batch_vector", f"WITH {_NEAREST} SELECT query_id, seq, round(distance, 6) AS distance, rank FROM vec_v WHERE rank <= 10")
def srh05_vector(t):
    rows = vectors(t)
    asked = rows.filter("seq % 50 = 0").select(c("seq").alias("query_id"), "embedding")
    return R.batch_vector(rows, asked, 10).select("query_id", "seq", F.round("distance", 6).alias("distance"), c("rank").cast("bigint").alias("rank"))


# Queries with words and a vector, some with one of them only.
_ASKED = """ask_v AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 150 = 50 THEN '' ELSE concat(CASE vec_id % 4 WHEN 0 THEN 'merger' WHEN 1 THEN 'Board' WHEN 2 THEN 'fraud' ELSE 'stake in' END) END AS query,
  CASE WHEN vec_id % 150 <> 100 THEN embedding END AS embedding FROM embeddings WHERE vec_id % 50 = 0)"""


@query("srh05_batch_hybrid", f"""WITH {_ASKED}, hay_v AS (SELECT seq, published_at, lower(concat(title, ' ', raw_text)) AS hay FROM articles_v),
 word_v AS (SELECT query_id, seq, row_number() OVER (PARTITION BY query_id ORDER BY published_at DESC, seq) AS rank FROM ask_v JOIN hay_v ON query <> '' AND contains(hay, lower(query))),
 near_v AS (SELECT a.query_id, e.vec_id AS seq, round(1.0 - list_cosine_similarity(e.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS distance FROM embeddings e JOIN ask_v a ON a.embedding IS NOT NULL),
 vec_v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, seq) AS rank FROM near_v),
 all_v AS (SELECT query_id, seq, rank FROM word_v WHERE rank <= 20 UNION ALL SELECT query_id, seq, rank FROM vec_v WHERE rank <= 20),
 sum_v AS (SELECT query_id, seq, round(sum(1.0::DOUBLE / (rank - 1 + 60)), 12) AS score FROM all_v GROUP BY 1, 2)
 SELECT query_id, seq, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM sum_v QUALIFY rank <= 10""")
def srh05_hybrid(t):
    k = c("vec_id")
    word = F.when(k % 150 == 50, "").when(k % 4 == 0, "merger").when(k % 4 == 1, "Board").when(k % 4 == 2, "fraud").otherwise("stake in")
    asked = t.embeddings.filter("vec_id % 50 = 0").select(k.alias("query_id"), word.alias("query"), F.when(k % 150 != 100, c("embedding")).alias("embedding"))
    hits = R.batch_hybrid(t.articles_v, vectors(t), asked, F.concat_ws(" ", c("title"), c("raw_text")), 10)
    return hits.select("query_id", "seq", F.round("score", 9).alias("score"), c("rank").cast("bigint").alias("rank"))


@query("srh05_batch_concept", f"""WITH d_v AS (SELECT entity_seq AS query_id, lower(concat(name, CASE type WHEN 'person' THEN ' company risk' WHEN 'company' THEN ' High merger, of high' ELSE ' notice notice' END)) AS q FROM dictionary_v WHERE type <> 'agency' OR length(name) > 8),
 tok_v AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest(string_split_regex(q, '[^a-z0-9'']+')) AS token FROM d_v) x WHERE length(token) > 2 AND token <> 'risk' GROUP BY 1, 2),
 art_v AS (SELECT seq, lower(title) AS low_title, lower(raw_text) AS low_text, lower({_LEVEL}) AS level FROM articles_v),
 one_v AS MATERIALIZED (SELECT seq, token, CASE WHEN contains(low_title, token) THEN 3 ELSE 1 END AS w FROM (SELECT DISTINCT token FROM tok_v WHERE token NOT IN {Q.inlist([x.lower() for x in V.RISK_LEVELS])}) k
   JOIN art_v ON contains(low_title, token) OR contains(low_text, token) UNION ALL SELECT seq, level, 2 FROM art_v),
 hit_v AS (SELECT query_id, seq, sum(w * times)::BIGINT AS score FROM tok_v JOIN one_v ON one_v.token = tok_v.token GROUP BY 1, 2)
 SELECT query_id, seq, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM hit_v QUALIFY rank <= 5""")
def srh05_concept(t):
    d = t.dictionary_v.filter("type <> 'agency' OR length(name) > 8")
    more = F.when(c("type") == "person", " company risk").when(c("type") == "company", " High merger, of high").otherwise(" notice notice")
    asked = d.select(c("entity_seq").alias("query_id"), F.concat("name", more).alias("query"))
    return R.batch_concept(_with_levels(t), asked, 5).select("query_id", "seq", "score", c("rank").cast("bigint").alias("rank"))


_RELATED = f"""txt_v AS (SELECT seq, url, category, lower(concat(title, ' ', raw_text)) AS txt FROM articles_v),
 one_v AS (SELECT * FROM txt_v WHERE seq = 3),
 tok_v AS (SELECT list_filter(list_distinct(string_split_regex(txt, '[^a-z0-9'']+')), lambda w: length(w) > 3 AND w NOT IN {Q.inlist(V.RELATED_STOPWORDS)}) AS toks, url, category FROM one_v),
 nm_v AS (SELECT coalesce(list(lower(name)), []) AS names FROM mention_v WHERE seq = 3),
 sc_v AS (SELECT a.seq, len(list_filter(t.toks, lambda w: contains(a.txt, w))) + 4 * len(list_filter(n.names, lambda w: contains(a.txt, w)))
    + CASE WHEN a.category IS NOT DISTINCT FROM t.category THEN 1 ELSE 0 END AS score FROM txt_v a, tok_v t, nm_v n WHERE a.url <> t.url)"""


@query("jn10_related_articles", f"WITH {MENTIONS_SQL}, {_RELATED} SELECT seq, CAST(score AS INTEGER) AS score FROM sc_v WHERE score >= 3 ORDER BY score DESC, seq LIMIT 5")
def jn10(t):
    rows = t.articles_v.withColumn("summary", c("raw_text"))
    return R.related(rows, t.dictionary_v, 3)


@query("jn11_entity_trace", """WITH e AS (SELECT 0 AS part, entity_seq AS pos, type AS kind, name AS label, concat('tracked in the knowledge graph · risk ', CASE WHEN type = 'company' THEN 'High' ELSE 'Low' END) AS note FROM dictionary_v WHERE contains(lower(name), 'the') ORDER BY entity_seq LIMIT 4),
 p AS (SELECT 1 AS part, seq AS pos, 'PSC register' AS kind, concat(person_name, ' → ', company) AS label, concat(CASE WHEN nature_of_control = '' THEN 'nature not disclosed' ELSE nature_of_control END, CASE WHEN percentage <> '' THEN concat(' · ', percentage) ELSE '' END) AS note
   FROM psc_v WHERE contains(lower(concat_ws(' ', person_name, company, vehicle)), 'the') ORDER BY seq LIMIT 8),
 a AS (SELECT 2 AS part, 0 AS pos, 'Coverage' AS kind, concat(count(*), ' articles mention this') AS label, concat(count(*) FILTER (risk_score >= 50), ' scored at elevated risk or above') AS note
   FROM articles_v WHERE contains(lower(concat_ws(' ', title, raw_text)), 'the'))
 SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM a) u ORDER BY part, pos LIMIT 8""")
def jn11(t):
    rows = t.articles_v.withColumn("summary", c("raw_text"))
    return R.trace(rows, t.dictionary_v.withColumn("risk", F.when(c("type") == "company", "High")), t.psc_v, "The")


# ------------------------------------------------------------------ reports


def scored(t, rows=None):
    """Articles with the fields the reports and alerts read."""
    rows = (rows if rows is not None else t.articles_v).withColumn("text", full_text())
    low = c("_low")
    rows = rows.withColumn("_low", S.lowered(c("text"))).withColumns({
        "risk_level": S.risk_in(low), "summaries": S.summaries(c("title"), c("raw_text"), "one_line", "executive"),
        "importance": S.importance_in(low, X.T.job_titles_in(low), c("seq") % 7, c("seq") % 6, F.coalesce("category", F.lit("")))})
    return rows.withColumns({
        "one_line": c("summaries.one_line"), "executive": c("summaries.executive"),
        "event_type": F.when(c("seq") % 12 == 3, "Appointment").when(c("seq") % 12 == 6, "Procurement").otherwise("Other"),
    }).drop("summaries", "_low")


_SCORED = f"""{SUMMARY_SQL}, full_v AS (SELECT *, lower({FULL}) AS low, {Q.fold(f'lower({FULL})')} AS folded FROM sum_v),
 risk_v AS (SELECT *, {Q.risk_level('folded')} AS risk_level, {Q.positions('folded')} AS pos FROM full_v),
 art_v AS (SELECT *, {IMPORTANCE_SQL.format(cat='category', low='low', pos='pos', people='(seq % 7)', orgs='(seq % 6)')} AS importance,
   CASE WHEN seq % 12 = 3 THEN 'Appointment' WHEN seq % 12 = 6 THEN 'Procurement' ELSE 'Other' END AS event_type FROM risk_v)"""
_SECTION = "CASE " + " ".join(
    f"WHEN {('coalesce(category, ' + Q.lit('') + ') = ' + Q.lit(V.SECTION_CATEGORY[n]) + ' AND ') if n in V.SECTION_CATEGORY else ''}{Q.has_any('low', V.SECTION_WORDS[n])} THEN '{n}'"
    for n in P.EVENT_SECTIONS) + " END"
_SECTIONED = f"""{_SCORED}, sec_v AS (SELECT *, {_SECTION} AS section, risk_level = 'Critical' OR importance >= 75 AS high_priority,
   risk_level IN ('High', 'Critical') OR {Q.has_any('low', V.CORRUPTION_WORDS)} AS corruption FROM art_v)"""


@query("rep01_sections", f"WITH {_SECTIONED} SELECT seq, section, high_priority, corruption FROM sec_v")
def rep01(t):
    return P.sections(scored(t)).select("seq", "section", "high_priority", "corruption")


_ENTRY = "concat('- **', title, '** (', source, ') - *', one_line, '*')"
_HEAD_TEXT = {n: (h, none) for n, h, none in V.REPORT_HEADINGS}
_DAILY = f"""{LINKED_SQL}, {_SECTIONED}, day_v AS (SELECT * FROM sec_v WHERE seq IN (SELECT seq FROM win_v)),
 tot_v AS (SELECT count(*) AS total, count(*) FILTER (high_priority) AS high, count(*) FILTER (corruption) AS corruption, {', '.join(f"count(*) FILTER (section = '{n}') AS {n}" for n in P.EVENT_SECTIONS)},
   (SELECT count(DISTINCT entity_id) FILTER (type = 'company') FROM linked_v) AS new_companies, (SELECT count(DISTINCT entity_id) FILTER (type = 'agency') FROM linked_v) AS new_agencies FROM day_v),
 n_v AS (SELECT type, name, count(*) AS n FROM linked_v GROUP BY 1, 2),
 kw_v AS (SELECT 'keyword' AS type, name, count(*) AS n FROM (SELECT category AS name FROM day_v WHERE category IS NOT NULL UNION ALL SELECT concat(risk_level, ' Risk') FROM day_v) k GROUP BY 2 ORDER BY n DESC, name LIMIT 5),
 top_v AS (SELECT * FROM (SELECT type, name, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, name) AS r FROM (SELECT * FROM n_v UNION ALL SELECT * FROM kw_v) z) y WHERE r <= 5),
 line_v(section, item, part, line) AS (
  SELECT 0, -1, i, x FROM (SELECT unnest(['# Daily Ownership & Company Report', '**Run time:** 10:00 AM', '## Summary', concat('- **Articles processed:** ', total), concat('- **New companies:** ', new_companies),
     concat('- **New agencies:** ', new_agencies), concat('- **Appointments:** ', appointments), concat('- **Company and board changes:** ', company_changes), concat('- **Procurement and tenders:** ', procurement),
     concat('- **High risk and corruption alerts:** ', corruption)]) AS x, unnest(range(10)) AS i FROM tot_v)
  UNION ALL SELECT * FROM (VALUES (1, -1, 0, '## High Priority Events'), (7, -1, 0, '## Corruption Risk Alerts'), (8, -1, 0, '## Trending Entities'), (9, -1, 0, '## Sources'),
     {', '.join(f"({i}, -1, 0, {Q.lit(_HEAD_TEXT[n][0])})" for i, n in enumerate(P.EVENT_SECTIONS, 2))}) v
  UNION ALL SELECT 1, -1, 1, {Q.lit(V.REPORT_NO_ALERTS)} FROM tot_v WHERE high = 0
  UNION ALL SELECT 7, -1, 1, {Q.lit(V.REPORT_NO_CORRUPTION)} FROM tot_v WHERE corruption = 0
  {' '.join(f"UNION ALL SELECT {i}, -1, 1, {Q.lit(_HEAD_TEXT[n][1])} FROM tot_v WHERE {n} = 0 UNION ALL SELECT {i}, seq, 0, {_ENTRY} FROM day_v WHERE section = '{n}'" for i, n in enumerate(P.EVENT_SECTIONS, 2))}
  UNION ALL SELECT 1, seq, i, x FROM (SELECT seq, unnest(range(5)) AS i, unnest([concat('### ', title), concat('- **Category:** ', coalesce(category, 'Other')), concat('- **Risk score:** ', printf('%.1f', importance * 0.8), ' (', risk_level, ')'),
     concat('- **Summary:** ', executive), concat('- **Source:** ', source)]) AS x FROM day_v WHERE high_priority)
  UNION ALL SELECT 7, seq, 0, concat('- **', title, '** (', source, ') - **Risk score: ', printf('%.1f', importance * 0.85), '** - *', executive, '*') FROM day_v WHERE corruption
  UNION ALL SELECT 8, CASE type WHEN 'company' THEN 1 WHEN 'agency' THEN 2 WHEN 'person' THEN 3 ELSE 4 END, r, concat('- ', type, ': ', name, ' (', n, ')') FROM top_v
  UNION ALL SELECT 9, seq, 0, concat('- [', source, '](', url, ') - ', title) FROM day_v)"""


@query("rep02_daily_report", f"WITH {_DAILY} SELECT section, item, CAST(part AS INTEGER) AS part, line FROM line_v")
def rep02(t):
    # The window's articles and their entities are used several times: written once.
    rows = materialise(scored(t, report_articles(t)), "report-articles")
    ties = materialise(linked(t), "report-entities")
    words = L.trending_keywords(rows).select(F.lit("keyword").alias("type"), "name", "n")
    trending = L.trending(ties).select("type", "name", "n").unionAll(words)
    return P.daily_report(rows, L.new_entities(ties), trending, "10:00 AM")


def run_records(t):
    return scored(t).select(
        "seq", "title", c("executive").alias("summary"), "risk_level", "event_type", F.lit(None).cast("string").alias("person"),
        F.when(c("seq") % 2 == 0, F.concat(F.lit("Company "), (c("seq") % 50).cast("string"))).alias("organization"),
        (c("seq") % 10 == 1).alias("has_procurement"))


_BRIEF = f"""{_SCORED}, rec_v AS (SELECT *, risk_level IN ('High', 'Critical') AS risky, event_type = 'Procurement' OR seq % 10 = 1 AS bought,
   concat('*   **', title, '**: ', CASE WHEN executive <> '' THEN executive ELSE '{{}}' END) AS item FROM art_v),
 oth_v AS (SELECT * FROM rec_v WHERE NOT risky ORDER BY seq LIMIT 8),
 fix_v AS (SELECT * FROM (VALUES (0, -1, 0, '# Daily Ownership & Company Brief'), (0, -1, 1, '**Generated on:** 2024-01-04 10:00:00'), (0, -1, 2, '## Summary Statistics'),
   (1, -1, 0, '### Key Developments'), (2, -1, 0, '### High Risk Alerts'), (3, -1, 0, '### Procurement & Board Changes')) v(section, item, part, line)),
 num_v AS (SELECT count(*) AS total, count(*) FILTER (risky) AS high, count(*) FILTER (event_type = 'Appointment') AS app, count(*) FILTER (bought) AS proc FROM rec_v)"""


@query("rep03_run_brief", f"""WITH {_BRIEF} SELECT * FROM fix_v
 UNION ALL SELECT 0, -1, 3, concat('- **Total Articles Processed:** ', total) FROM num_v UNION ALL SELECT 0, -1, 4, concat('- **High Risk Signals:** ', high) FROM num_v
 UNION ALL SELECT 0, -1, 5, concat('- **Appointments Logged:** ', app) FROM num_v UNION ALL SELECT 0, -1, 6, concat('- **Procurement Awards:** ', proc) FROM num_v
 UNION ALL SELECT 1, seq, 0, replace(item, '{{}}', {Q.lit(V.BRIEF_EVENT_SUMMARY)}) FROM oth_v
 UNION ALL SELECT 2, seq, 0, replace(item, '{{}}', {Q.lit(V.BRIEF_RISK_SUMMARY)}) FROM rec_v WHERE risky
 UNION ALL SELECT 3, seq, 0, concat('*   **Key Appointment**: Executive logged under ', CASE WHEN seq % 2 = 0 THEN concat('Company ', CAST(seq % 50 AS STRING)) ELSE 'Counterparty' END, '.') FROM rec_v WHERE event_type = 'Appointment'
 UNION ALL SELECT 4, seq, 0, concat('*   **Procurement**: ', title) FROM rec_v WHERE bought""")
def rep03(t):
    # Counted, listed and searched for the first few: scored and written once.
    return P.brief(materialise(run_records(t), "run-records"), "2024-01-04 10:00:00")


_TITLES = "(SELECT string_agg(f.title, ', ' ORDER BY f.ord) FROM flag_v f WHERE f.seq = a.seq)"
_MAYBE = "coalesce(nullif({}, ''), '{}')"
_BLOCKS = ", ".join([
    "concat('### ', person_name, ' — ', company)",
    f"concat('- **Stake:** ', {_MAYBE.format('percentage', 'not disclosed')}, ' (Direct: ', {_MAYBE.format('direct_pct', 'N/A')}, ', Indirect: ', {_MAYBE.format('indirect_pct', 'N/A')}, ')')",
    "concat('- **Vehicle:** ', CASE WHEN is_direct THEN 'Direct Ownership' ELSE vehicle END)",
    f"concat('- **Nature of control:** ', {_MAYBE.format('nature_of_control', 'not disclosed')})", "concat('- **PEP status:** ', pep_status)",
    f"concat('- **Red flags:** ', coalesce({_TITLES}, 'Clean Disclosure'))", f"concat('- **Filing reference:** ', {_MAYBE.format('filing_ref', 'not disclosed')})"])


@query("rep04_compliance_brief", f"""WITH {COUNTS_SQL}, tot_v AS (SELECT count(*) AS total, avg(pct) AS mean, count(*) FILTER (NOT is_direct) AS indirect, count(*) FILTER (n_flags > 0) AS flagged,
   count(*) FILTER (n_high > 0) AS high, count(*) FILTER (trim(filing_ref) <> '') / count(*) AS rate FROM ann_v)
 SELECT 0 AS section, CAST(-1 AS BIGINT) AS item, CAST(i AS INTEGER) AS part, x AS line FROM (SELECT unnest(range(8)) AS i, unnest(['# Persons with Significant Control: Audit Brief', '> **NOT FOR COMPLIANCE USE.** Contains illustrative seed records.', '## Summary',
   concat('- **Control records:** ', total), concat('- **Mean disclosed stake:** ', printf('%.1f', mean), '%'), concat('- **Held via a vehicle:** ', indirect),
   concat('- **With red flags:** ', flagged, ' (', high, ' high severity)'), concat('- **Citing a filing reference:** ', CAST(round(rate * 100) AS INTEGER), '%')]) AS x FROM tot_v)
 UNION ALL SELECT 1, seq, CAST(i AS INTEGER), x FROM (SELECT seq, unnest(range(7)) AS i, unnest([{_BLOCKS}]) AS x FROM ann_v a)""")
def rep04(t):
    return P.compliance_brief(t.psc_v)


@query("rep05_alerts", f"""WITH {_SCORED}, {MENTIONS_SQL} SELECT a.seq, concat(risk_level, ' Risk Alert: ', title) AS title,
  concat('A ', risk_level, ' risk event has been detected in article ''', title, ''' (Importance: ', printf('%.1f', importance), '). Summary: ', executive) AS message,
  event_type AS alert_type, CASE risk_level WHEN 'Critical' THEN 'Critical' WHEN 'High' THEN 'Warning' ELSE 'Info' END AS severity, m.entity_id
  FROM art_v a LEFT JOIN (SELECT seq, min(entity_seq) AS entity_id FROM mention_v GROUP BY seq) m USING (seq)
  WHERE risk_level IN ('High', 'Critical') OR importance >= 75""")
def rep05(t):
    return P.alerts(scored(t), mentions(t)).select("seq", "title", "message", "alert_type", "severity", "entity_id")
