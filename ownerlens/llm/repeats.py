"""Exact removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier: in a
document with a smaller id, or further left in its own. Four steps, none of which
sorts or collects the corpus:

1. Of every ``LENGTH`` bytes in a row one gram of ``GRAM`` bytes, the least by hash,
   is the anchor. Equal strings have equal anchors at equal places, so only strings
   with an anchor that occurs twice can be repeats. Anchors are counted by partial
   aggregates and joined back, one row per anchor on the one side.
2. A stretch of text around such an anchor holds all strings that have it. Stretches
   that are equal (by two hashes of 64 bits) go on as one, at their first place. If
   an anchor has one stretch only, that place keeps its strings: nothing is left to merge.
3. Anchors are dealt into buckets, and a bucket's stretches into shards. One task a
   shard builds its transform (``bwt.transform``); one task a bucket merges the
   shards' transforms by interleave refinement until rows have ``LENGTH`` bytes in
   common. In each block of such rows the earliest place keeps its string.
4. Strings at the anchors of step 1 that no block kept are repeats.

An anchor with more than ``HOT`` stretches is split: strings with the anchor at
nearby distances have a longer core in common, and the cores are dealt instead; at
the last of ``SPANS`` a core is the whole string. So no bucket grows with a key.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` keep all bytes;
rows of one id are ordered by a hash of their text; rows equal in id and text are one
document, reported for each of them; a null id comes after all others; an empty table
gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ownerlens.llm import bwt
from ownerlens.llm.batches import bounded
from ownerlens.operators.keys import global_rank
from ownerlens.session import materialise

LENGTH = 100
GRAM = 30
#: Bytes of text in a bucket, about, and shards it is dealt into.
BUCKET = 1 << 16
SHARDS = 2
#: Stretches an anchor may have before it is split, and distances a core spans then.
HOT = 2048
SPANS = (8, 1)
#: Rows per record batch that a task returns, and bytes of text hashed at once.
BATCH = 1 << 14
SLICE = 1 << 15

_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


#: Powers of the base, and of its inverse, for every place of a slice.
_POWERS, _INVERSE = _powers(_BASE, SLICE + (1 << 15)), _powers(pow(_BASE, -1, 2**64), SLICE + (1 << 15))


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, hash, first, n, off, whole): n strings from ``first`` on have the anchor ``off`` bytes after ``first``.

    ``data`` holds texts one after another, up to ``ends``; ``whole`` hashes all bytes of the strings.
    """
    n = len(data) - length + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)])))
    h = _mixed((sums[gram:] - sums[:-gram]) * _INVERSE[: len(data) - gram + 1])
    w = length - gram + 1
    low, size = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= w:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[:n], low[w - size : w - size + n]) & np.uint64(0xFFFFFFFF)
    # Strings that reach into the next text are none.
    use = np.ones(n + 1, bool)
    use[n] = False
    for e in ends[:-1].tolist():
        use[max(0, e - length + 1) : min(e, n)] = False
    new = use[:n].copy()
    new[1:] &= (low[1:] != low[:-1]) | ~use[: n - 1]
    first = np.flatnonzero(new)
    # A run of strings ends where the next begins, or where none is.
    stops = np.flatnonzero(new | ~use[:n])
    count = np.append(stops, n)[np.searchsorted(stops, first, "right")] - first
    at = low[first].astype(np.int64)
    whole = (sums[first + count + length - 1] - sums[first]) * _INVERSE[first]
    whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(_BASE) + count.astype(np.uint64)
    text = np.searchsorted(ends, first, "right")
    starts = np.concatenate(([0], ends[:-1]))
    return text, h[at].view(np.int64), first - starts[text], count, at - first, whole.view(np.int64)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SLICE`` bytes; a longer text is a range of its own."""
    a, held = 0, 0
    for b, size in enumerate(sizes):
        if held and held + size > SLICE:
            yield a, b
            a, held = b, 0
        held += size
    if held or a < len(sizes):
        yield a, len(sizes)


def all_anchors(texts: list[np.ndarray], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors`` of texts, a group of short ones or a slice of a long one at a time."""
    for a, b in _groups([len(t) for t in texts]):
        size = sum(len(t) for t in texts[a:b])
        if b - a == 1 and size > SLICE:
            for s in range(0, max(0, size - length + 1), SLICE):
                piece = texts[a][s : s + SLICE + length - 1]
                text, h, first, *rest = anchors(piece, np.array([len(piece)]), length, gram)
                yield text + a, h, first + s, *rest
        else:
            text, *rest = anchors(np.concatenate(texts[a:b]), np.cumsum([len(t) for t in texts[a:b]]), length, gram)
            yield text + a, *rest


def _bytes(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(column[k].as_buffer(), np.uint8)


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, tid (tells texts of one id apart) and the text's bytes."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return bounded(docs).select("doc_id", F.hash(text).alias("tid"), data.alias("data"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_doc"]) & (a["tid"] == b["_tid"])


def found_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, doc_id, tid, mark, whole) of all anchors; a mark packs first, n and off."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid = batch.column(1).to_numpy()
            for text, h, first, n, off, whole in all_anchors([_bytes(batch.column(2), k) for k in range(batch.num_rows)], length, gram):
                columns = [pa.array(h), batch.column(0).take(pa.array(text)), pa.array(tid[text]), pa.array(first << 32 | n << 16 | off), pa.array(whole)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "tid", "mark", "whole"])

    return rows.mapInArrow(find, "anchor bigint, doc_id bigint, tid int, mark bigint, whole bigint")


def marks(rows: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """(_doc, _tid, no, marks, sole, lone, crowd): documents with anchors that occur twice, numbered in order.

    A mark packs first, n and off of an anchor's strings. The other columns hold the
    marks whose stretch stands here first: ``sole`` those of anchors with no other
    stretch, ``crowd`` those of anchors with over ``hot`` stretches, ``lone`` the rest.
    """
    # Anchors are found twice rather than written: hashing is cheaper than the disk they would take.
    found = found_anchors(rows, length, gram)
    often = found.groupBy(F.col("anchor").alias("_a")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_a")
    # Joined the same way at every size, so that small runs tell of large ones.
    met = materialise(found.join(often.hint("merge"), F.col("anchor") == F.col("_a"), "left_semi"), "marks")
    # One row per stretch, at its first place. Grouped by a mix of both hashes so that equal stretches meet on the map side first.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tid", "mark")
    lone = met.groupBy(F.col("anchor").bitwiseXOR(F.col("whole")).alias("x"), F.col("whole").alias("y")).agg(F.min(place).alias("p"))
    lone = materialise(lone.select(F.col("x").bitwiseXOR(F.col("y")).alias("anchor"), F.col("p.doc_id").alias("doc_id"), F.col("p.tid").alias("tid"), F.col("p.mark").alias("mark")), "stretches")
    several = lone.groupBy(F.col("anchor").alias("_a")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    split = lone.join(several.hint("merge"), F.col("anchor") == F.col("_a"), "left")
    document = [F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid")]
    kinds = {"sole": F.col("c").isNull(), "lone": F.col("c") <= hot, "crowd": F.col("c") > hot}
    own = split.groupBy(*document).agg(*[F.collect_set(F.when(use, F.col("mark"))).alias(name) for name, use in kinds.items()])
    grouped = met.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_set("mark")).alias("marks"))
    none = F.array().cast("array<bigint>")
    both = grouped.join(own.hint("merge"), _same(grouped, own), "left").select(F.col("doc_id").alias("_doc"), F.col("tid").alias("_tid"), "marks", *[F.coalesce(name, none).alias(name) for name in kinds])
    return global_rank(both, [F.col("_doc").asc_nulls_last(), F.col("_tid").asc()], "no")


def stretches(met: DataFrame, which: str, stride: int, length: int) -> DataFrame:
    """(seg, off, at): the text of the strings of every mark in the column ``which``; ``at`` is its place in the whole corpus."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, data, lists = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            for k in range(batch.num_rows):
                packed = lists[k].values.to_numpy()
                text = data[k].as_buffer().to_pybytes() if len(packed) else b""
                first, n, off = packed >> 32, (packed >> 16) & 0xFFFF, packed & 0xFFFF
                for s in range(0, len(packed), BATCH):
                    part = slice(s, s + BATCH)
                    segs = [text[a:b] for a, b in zip(first[part].tolist(), (first + n + length - 1)[part].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(segs, pa.binary()), pa.array(off[part].astype(np.int32)), pa.array(no[k] * stride + first[part])], ["seg", "off", "at"])

    return met.select("no", "data", which).mapInArrow(cut, "seg binary, off int, at bigint")


def by_core(segs: DataFrame, span: int, length: int) -> DataFrame:
    """(key, seg, off, at): each stretch cut to strings whose anchor is one of ``span`` distances, keyed by the bytes they share."""
    off, n = F.col("off"), F.length("seg") - (length - 1)
    group = F.explode(F.sequence(F.floor((off - n + 1) / span).cast("int"), F.floor(off / span).cast("int")))
    cut = segs.select("seg", "off", "at", n.alias("n"), group.alias("g"))
    low = F.greatest(F.lit(0), F.col("off") - F.col("g") * span - span + 1)
    high = F.least(F.col("n") - 1, F.col("off") - F.col("g") * span)
    core = F.substr("seg", F.col("off") - F.col("g") * span + 1, F.lit(length - span + 1))
    cut = cut.withColumns({"low": low, "size": high - low + length, "key": F.xxhash64("g", core)})
    return cut.select("key", F.substr("seg", F.col("low") + 1, F.col("size")).alias("seg"), (F.col("off") - F.col("low")).cast("int").alias("off"), (F.col("at") + F.col("low")).alias("at"))


def _bucketed(keyed: DataFrame, base: int, buckets: int) -> DataFrame:
    bucket, shard = F.pmod(F.xxhash64("key"), F.lit(buckets)) + base, F.pmod(F.hash("seg"), F.lit(SHARDS))
    return keyed.select(bucket.cast("int").alias("bucket"), shard.cast("int").alias("shard"), "seg", "at")


def split_crowds(segs: DataFrame, base: int, spans: tuple[int, ...], length: int, hot: int, bucket: int) -> DataFrame:
    """Buckets of the strings of crowded anchors, dealt by longer and longer cores; equal pieces are one row, at their first place."""
    out = []
    for span in spans:
        pieces = by_core(segs, span, length).groupBy("key", "off", "seg").agg(F.min("at").alias("at"))
        pieces = materialise(pieces, f"cores-{span}")
        buckets = max(1, -(-(pieces.agg(F.sum(F.length("seg"))).first()[0] or 0) // bucket))
        if span == spans[-1]:
            out.append(_bucketed(pieces, base, buckets))
            break
        crowded = pieces.groupBy(F.col("key").alias("_k")).count().filter(F.col("count") > hot).select("_k")
        out.append(_bucketed(pieces.join(crowded, F.col("key") == F.col("_k"), "left_anti"), base, buckets))
        segs, base = pieces.join(crowded, F.col("key") == F.col("_k"), "left_semi").select("seg", "off", "at"), base + buckets
    return reduce(DataFrame.unionByName, out)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of one key after another; rows come sorted by their first ``keys`` columns."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        turn = np.zeros(batch.num_rows, bool)
        for c in columns:
            turn[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            here = tuple(int(c[a]) for c in columns)
            if here != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def transforms(parts: DataFrame) -> DataFrame:
    """(bucket, shard, symbols, sizes, rows, at): the transform of every shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, shard), table in _grouped(batches, 2):
            segs = table.column("seg").combine_chunks().to_pylist()
            made = bwt.transform(np.frombuffer(b"".join(segs), np.uint8), np.array([len(s) for s in segs]))
            columns = [[bucket], [shard], [made.symbols.tobytes()], [made.sizes.astype(np.int32)], [made.rows.astype(np.int32)], [table.column("at").to_numpy()]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "shard", "symbols", "sizes", "rows", "at"])

    rows = parts.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard").select("bucket", "shard", "seg", "at")
    return rows.mapInArrow(build, "bucket int, shard int, symbols binary, sizes array<int>, rows array<int>, at array<bigint>")


def kept(shards: DataFrame, length: int) -> DataFrame:
    """(at, n): stretches of places whose strings stand nowhere earlier, from the merged transforms of every bucket."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _grouped(batches, 1):
            parts, places = [], []
            for k in range(table.num_rows):
                row = {name: table.column(name)[k] for name in ("symbols", "sizes", "rows", "at")}
                numbers = {name: row[name].values.to_numpy().astype(np.int64) for name in ("sizes", "rows", "at")}
                parts.append(bwt.Transform(np.frombuffer(row["symbols"].as_buffer(), np.uint8), numbers["sizes"], numbers["rows"]))
                places.append(numbers["at"])
            at, n = bwt.first_holders(parts, places, length)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int32))], ["at", "n"])

    return shards.repartition("bucket").sortWithinPartitions("bucket", "shard").mapInArrow(merge, "at bigint, n int")


def without(data: bytes, packed: np.ndarray, keep: list, length: int) -> tuple[bytes, list[dict]]:
    """Bytes left, and the spans that are taken out: strings of the marks, but for those in ``keep``."""
    starts = np.zeros(len(data) + 1, np.int32)
    first, n = packed >> 32, (packed >> 16) & 0xFFFF
    np.add.at(starts, first, 1)
    np.add.at(starts, first + n, -1)
    for k in keep:
        starts[k["start"]] -= 1
        starts[k["start"] + k["n"]] += 1
    begins = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + length, -1)
    gone = np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]))
    turn = np.diff(gone)
    a, z = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    left = np.frombuffer(data, np.uint8)[gone[1:-1] == 0].tobytes()
    return left, [{"start": s, "size": e - s} for s, e in zip(a.tolist(), z.tolist())]


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, hot: int = HOT, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): bytes of every document, the repeated spans (start, size), and the bytes left."""
    if not 1 <= gram <= length < 1 << 15:
        raise ValueError("anchors are no longer than the strings")
    rows = _rows(docs, text)
    found = marks(rows, length, gram, hot)
    stride = (rows.agg(F.max(F.length("data"))).first()[0] or 0) + 1
    lone, crowd = found.agg(F.sum(F.size("lone")), F.sum(F.size("crowd"))).first()
    # A stretch has about this many bytes.
    buckets = max(1, -(-(lone or 0) * (3 * length - gram) // (2 * bucket)))
    met = rows.join(found.hint("merge"), _same(rows, found))
    parts = _bucketed(by_core(stretches(met, "lone", stride, length), length - gram + 1, length), 0, buckets)
    if crowd:
        few = found.filter(F.size("crowd") > 0)
        parts = parts.unionByName(split_crowds(stretches(rows.join(few, _same(rows, few)), "crowd", stride, length), buckets, spans, length, hot, bucket))
    runs = kept(transforms(parts), length).select(F.floor(F.col("at") / stride).alias("_no"), (F.col("at") % stride).cast("int").alias("start"), "n")
    runs = runs.groupBy("_no").agg(F.collect_list(F.struct("start", "n")).alias("keep"))
    sole = F.transform("sole", lambda m: F.struct(F.shiftright(m, 32).cast("int").alias("start"), F.shiftright(m, 16).bitwiseAND(0xFFFF).cast("int").alias("n")))
    plan = found.join(runs.hint("merge"), F.col("no") == F.col("_no"), "left").select("_doc", "_tid", "marks", F.concat(F.coalesce("keep", F.array().cast("array<struct<start: int, n: int>>")), sole).alias("keep"))

    @F.pandas_udf("kept binary, spans array<struct<start: int, size: int>>")
    def cut(data: pd.Series, packed: pd.Series, keep: pd.Series) -> pd.DataFrame:
        out = [(None, []) if p is None else without(d, np.asarray(p, np.int64), list(k), length) for d, p, k in zip(data, packed, keep)]
        return pd.DataFrame({"kept": [o[0] for o in out], "spans": [o[1] for o in out]})

    # Texts without a mark stay in the JVM.
    whole = rows.join(plan.hint("merge"), _same(rows, plan), "left")
    whole = whole.select("doc_id", "data", cut.asNondeterministic()(F.when(F.col("marks").isNotNull(), F.col("data")), "marks", "keep").alias("r"))
    return whole.select("doc_id", F.length("data").cast("bigint").alias("n_bytes"), "r.spans", F.coalesce("r.kept", "data").alias("kept"))


def digests(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["size"])
    return remove(docs, text, **options).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
