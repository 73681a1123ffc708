"""Substring de-duplication by content-defined anchors with a gear rolling hash.

A passage is repeated where ``MIN_WORDS`` words or more stand, word for word, in a
document with a smaller id. Two passes find all of them:

1. A gear hash rolls over the last 16 words. Of every ``MIN_WORDS`` words in a row,
   the run of ``ANCHOR`` words whose gear hash is the least (the last of equal ones)
   is an anchor. The choice depends on these words only, so a passage of that length
   has an anchor in common with its copy, whatever the words are and stand between.
2. Around anchors that occur in two documents, every window of ``MIN_WORDS`` words
   is hashed. A window that occurs in a document with a smaller id is a repeat;
   overlapping and touching repeats are one passage. Chance matches of anchors have
   no such window, and shared lines side by side have none across their border
   unless one document holds them in this order.

Digests are counted by partial aggregates with one row per digest and joined back,
so a passage in a third of all documents is one key on one side of a join that can
be split on the other.

Defined cases: words are compared as bytes, white space between them is not; null
and empty texts have no words; rows with one id are one document and do not repeat
each other; rows with a null id are never first, and are repeats of any row with an
id; an empty table gives an empty result; extra columns are kept by ``remove`` and
ignored elsewhere.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ownerlens.llm.batches import bounded
from ownerlens.session import materialise

MIN_WORDS = 51
#: Words of an anchor, at least the gear hash's 16.
ANCHOR = 26
#: Rows per record batch that a task returns.
BATCH = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _rolled(h: np.ndarray) -> np.ndarray:
    """Gear hash over the 16 values that end at each place (fewer at the start), in the place of the values."""
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def _word_starts(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    return np.flatnonzero(~space & np.concatenate(([True], space[:-1])))


_B = np.uint64(0x9E3779B97F4A7C1B)
_B_INVERSE = np.uint64(pow(int(_B), -1, 2**64))


def word_hashes(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` words in a row, from the words' hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, back = np.full(len(words), _B), np.full(n, _B_INVERSE)
    power[0] = back[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power), dtype=np.uint64)))
    h = (sums[size:] - sums[:n]) * np.cumprod(back)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def anchors(words: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """First words of the anchors: one at least in every ``min_words`` words in a row."""
    n, w = len(words) - ANCHOR + 1, min_words - ANCHOR + 1
    if n < w:
        return np.zeros(0, np.int64)
    rolled = _rolled(words.astype(np.uint32))[ANCHOR - 1 :].astype(np.uint64)
    low, size = (rolled << np.uint64(32)) | (np.uint64(2**32 - 1) - np.arange(n, dtype=np.uint64)), 1
    while 2 * size <= w:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[: n - w + 1], low[w - size : w - size + n - w + 1])
    return 2**32 - 1 - np.unique(low & np.uint64(2**32 - 1))[::-1].astype(np.int64)


def _windows(docs: DataFrame, size: int, chosen) -> DataFrame:
    """Rows (doc_id, rid, first, digest) of the windows of ``size`` words that begin at ``chosen(words, marks)``.

    ``docs`` holds doc_id, rid, text and, if it has a fourth column, the document's marks.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            sizes = [len(h[2]) for h in held]
            ids = pa.array([h[0] for h in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
            rids = np.repeat(np.array([h[1] for h in held], np.int32), sizes)
            first, digest = (np.concatenate([h[k] for h in held]) for k in (2, 3))
            columns = [ids, pa.array(rids), pa.array(first.astype(np.int32)), pa.array(digest.view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", "first", "digest"])

        for batch in batches:
            for k, (doc_id, rid, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                if not value.is_valid:
                    continue
                words = word_hashes(value.as_buffer().to_pybytes())
                first = chosen(words, batch.column(3)[k].values.to_numpy() if batch.num_columns > 3 else None)
                if not len(first):
                    continue
                held.append((doc_id, rid, first, window_hashes(words, size)[first]))
                count += len(first)
                if count >= BATCH:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(split, "doc_id bigint, rid int, first int, digest bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """(_d, holder): digests that occur in a document and in one with a larger or no id; ``holder`` is the smallest id."""
    nameless = F.max(F.col("doc_id").isNull())
    seen = rows.groupBy(F.col("digest").alias("_d")).agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"), nameless.alias("nameless"))
    return seen.filter((F.col("holder") < F.col("last")) | (F.col("nameless") & F.col("holder").isNotNull())).select("_d", "holder")


def repeated_passages(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, rid, first_word, n_words, first_doc_id): passages already in documents with a smaller id.

    Words are numbered from 0 in their document; ``first_doc_id`` is the smallest id
    that holds ``min_words`` words in a row of the passage.
    """
    if min_words < ANCHOR:
        raise ValueError(f"passages have {ANCHOR} words or more")

    def around(words: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a marked anchor."""
        n = len(words) - min_words + 1
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, np.maximum(marks + ANCHOR - min_words, 0), 1)
        np.add.at(steps, np.minimum(marks + 1, n), -1)
        return np.flatnonzero(np.cumsum(steps[:n]))

    rows = bounded(docs).select("doc_id", F.hash(text).alias("rid"), F.col(text).alias("text"))
    # Found twice rather than written: hashing is cheaper than the disk they would take.
    marked = _windows(rows, ANCHOR, lambda words, _: anchors(words, min_words))
    often = marked.groupBy(F.col("digest").alias("_d")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_d")
    # Joined the same way at every size, so that small runs tell of large ones.
    marks = marked.join(often.hint("merge"), F.col("digest") == F.col("_d"), "left_semi").groupBy(F.col("doc_id").alias("_m"), F.col("rid").alias("_r")).agg(F.collect_set("first").alias("marks"))
    met = rows.join(marks.hint("merge"), rows["doc_id"].eqNullSafe(F.col("_m")) & (rows["rid"] == F.col("_r"))).select("doc_id", "rid", "text", "marks")
    found = materialise(_windows(met, min_words, around), "passage-windows")
    again = found.join(_shared(found).hint("merge"), F.col("digest") == F.col("_d")).filter(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("holder")))
    # Equal rows bring a window more than once.
    document = Window.partitionBy("doc_id", "rid").orderBy("first")
    again = again.withColumn("new", F.coalesce(F.col("first") > F.lag("first").over(document) + min_words, F.lit(True)).cast("int"))
    runs = again.withColumn("run", F.sum("new").over(document.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "rid", "run").agg(
        F.min("first").alias("first_word"), (F.max("first") + min_words - F.min("first")).alias("n_words"), F.min("holder").alias("first_doc_id"))
    return runs.select("doc_id", "rid", "first_word", "n_words", "first_doc_id")


def remove(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the passages taken out of their texts; documents left without a word go, the rest keep all columns."""
    spans = passages.groupBy(F.col("doc_id").alias("_span_doc"), F.col("rid").alias("_span_rid")).agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("_spans"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            raw, at, kept = t.encode("utf-8"), 0, []
            starts = np.append(_word_starts(np.frombuffer(raw, np.uint8)), len(raw))
            for x in s:
                kept.append(raw[at : starts[x["first_word"]]])
                at = starts[x["first_word"] + x["n_words"]]
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8").rstrip())
        return pd.Series(out, dtype=object)

    met = docs.join(spans.hint("merge"), docs["doc_id"].eqNullSafe(spans["_span_doc"]) & (F.hash(docs[text]) == spans["_span_rid"]), "left")
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("d")
    # Marked so that the filter on the result does not make Spark run the function twice.
    cut = met.filter(spans["_spans"].isNotNull()).select(whole, without.asNondeterministic()(docs[text], spans["_spans"]).alias("left"))
    cut = cut.filter(F.col("left").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col("left").alias(c) if c == text else F.col("d")[c].alias(c) for c in docs.columns])
    return met.filter(spans["_spans"].isNull()).select(*[docs[c] for c in docs.columns]).unionByName(cut)
