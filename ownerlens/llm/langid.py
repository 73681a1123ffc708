"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit, over hashed byte
n-grams, tells the languages whose bit is set from the others. A text's bit margins
are decoded to the codeword of least logistic loss, each bit weighted by how well it
separated the training rows; a near tie is flagged as ambiguous.

Training counts n-grams per language over a bounded sample: of every language the
labelled rows whose hash of id and text is below its share of ``SAMPLE`` rows. Only
text and language enter the model, which is ``BUCKETS`` x bits numbers; bits grow
with the logarithm of the number of languages, all of which are learned.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
ambiguous; with no labelled row everything is ``und``; with one language every text
with a letter gets it; rows without a language train nothing; equal rows train
once and are predicted each; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownerlens.llm.batches import bounded
from ownerlens.session import materialise

UNKNOWN = "und"
#: Labelled rows per language that train the classifiers, about.
SAMPLE = 400
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
#: Bytes whose n-grams are scored at once, in a model of eight bits.
SLICE = 1 << 16
#: Languages up to which their shares go to every task.
FEW = 50_000
#: Languages whose counts a task holds at once, and numbers a task decodes at once.
HELD = 256
DECODED = 1 << 22
#: Languages up to which every split of the languages is a bit; beyond it, random splits.
EXHAUSTIVE = 6
BITS_PER_LANGUAGE = 4
SMOOTHING = 0.5
#: Difference of weighted loss below which the best two codewords count as tied.
TIE = 0.02

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each of the first len - n + 1 bytes."""
    m = len(data) - n + 1
    h = np.full(m, n, np.uint32)
    for k in range(n):
        h = (h ^ data[k : k + m]) * np.uint32(0x01000193)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def codewords(languages: int) -> np.ndarray:
    """languages x bits of +1 and -1: all splits of few languages, else distinct random ones (fixed seed)."""
    if languages <= EXHAUSTIVE:
        bits = 2 ** (languages - 1) - 1
        rows = [[1] * bits] + [[1 if (b >> (languages - 1 - i)) & 1 else -1 for b in range(bits)] for i in range(1, languages)]
        return np.array(rows, np.int8)
    rnd, bits = np.random.default_rng(7), BITS_PER_LANGUAGE * int(np.ceil(np.log2(languages)) + 4)
    while True:
        code = rnd.choice(np.array([-1, 1], np.int8), (languages, bits))
        if len(np.unique(code, axis=0)) == languages and (np.abs(code.sum(axis=0)) < languages).all():
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS x bits: log odds of a bit given an n-gram
    trust: np.ndarray  # weight of each bit in the loss

    def margins(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log odds of every bit over the n-grams of each text ``data[start:end]``; texts lie one after another."""
        bits = self.weights.shape[1]
        sums, counts = np.zeros((len(starts), bits)), np.zeros(len(starts))
        begin, stop = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
        step = max(1 << 14, SLICE * 8 // bits)
        for s in range(begin, stop, step):
            t = min(s + step, stop)
            low = _LOWER[data[s : min(t + max(GRAMS) - 1, stop)]]
            first, last = np.searchsorted(ends, s, "right"), np.searchsorted(starts, t, "left")
            for n in GRAMS:
                score = self.weights[grams(low, n)[: t - s]] if len(low) >= n else np.zeros((0, bits))
                a = np.clip(starts[first:last] - s, 0, len(score))
                b = np.clip(ends[first:last] - n + 1 - s, 0, len(score))
                some = np.flatnonzero(b > a)
                if not len(some):
                    continue
                # Sums between the cuts a0 b0 a1 b1 ...; every other one lies across two texts.
                cuts = np.stack((a[some], b[some]), axis=1).ravel()
                score = np.concatenate((score, np.zeros((1, bits), score.dtype)))
                sums[first:last][some] += np.add.reduceat(score, cuts, axis=0, dtype=np.float64)[::2]
                counts[first:last][some] += (b - a)[some]
        return sums / np.maximum(counts, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score in 0..1 and whether the best two are tied."""
        if len(self.languages) == 1:
            n = len(margins)
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        loss = np.empty((len(margins), len(self.languages)))
        step = max(1, DECODED // self.code.size)
        for s in range(0, len(margins), step):
            part = margins[s : s + step, None, :]
            loss[s : s + step] = (np.logaddexp(0, -part * self.code[None] * 4) * self.trust).sum(axis=2) / self.trust.sum()
        best = loss.argmin(axis=1)
        two = np.partition(loss, 1, axis=1)
        share = np.exp(-8 * (loss - two[:, :1]))
        return best, 1 / share.sum(axis=1), two[:, 1] - two[:, 0] < TIE


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and null mask of a string column."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:], np.asarray(column.is_null())


def training_rows(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """(lang, text): about ``per_language`` different rows of every language, those whose hash is below its share."""
    known = bounded(docs).filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    share = known.groupBy(F.col("lang").alias("_l")).agg(F.least(F.lit(1.0), per_language / F.count(F.lit(1))).alias("_s"))
    share = materialise(share, "languages")
    if share.count() <= FEW:
        share = F.broadcast(share)  # so that no text moves
    key = F.xxhash64("doc_id", "text")
    # Hashes are uniform, so a share of their range is that share of the rows and no language is sorted or collected.
    rows = known.join(share, F.col("lang") == F.col("_l")).filter(key / F.lit(2.0**64) + 0.5 <= F.col("_s"))
    return rows.select("lang", "text", key.alias("_k")).dropDuplicates(["lang", "_k"]).select("lang", "text")


def task_counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the n-grams of (lang, text), for each task.

    The sample of a language, about ``SAMPLE`` texts, is counted in one task: dealt over
    many tasks, nearly every n-gram of every text would be a row of its own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, have in sums.items():
                at = np.flatnonzero(have)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": have[at]})
            sums.clear()

        for batch in batches:
            data, starts, ends, _ = _buffers(batch.column(1))
            for lang, a, b in zip(batch.column(0).to_pylist(), starts, ends):
                have = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for n in GRAMS:
                    if b - a >= n:
                        have += np.bincount(grams(_LOWER[data[a:b]], n), minlength=BUCKETS)
                if len(sums) >= HELD:
                    yield from flush()
        yield from flush()

    return rows.repartition("lang").mapInArrow(count, "lang string, bucket int, n bigint")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the n-grams of (lang, text)."""
    return task_counts(rows).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_language: int = SAMPLE) -> Model:
    """Fit the bit classifiers on a bounded sample of ``docs`` (doc_id, text, lang).

    What reaches the driver is a number per language and bit, and per bucket and bit;
    bits grow with the logarithm of the languages.
    """
    counted = materialise(gram_counts(training_rows(docs, per_language)), "gram-counts")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    code, number = codewords(len(languages)), {x: k for k, x in enumerate(languages)}
    bits = code.shape[1]
    # Share of a bucket in a language: (n + SMOOTHING) / scale.
    scale = np.array([totals[x] for x in languages]) + SMOOTHING * BUCKETS
    set_, least = (code > 0).astype(float), SMOOTHING / scale
    members = np.stack((set_.sum(axis=0), len(languages) - set_.sum(axis=0)))
    floor = np.stack((least @ set_, least @ (1 - set_)))

    def numbered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        lang = rows["lang"].map(number).to_numpy(np.int64)
        return lang, rows["n"].to_numpy() / scale[lang]

    def odds(sums: np.ndarray) -> np.ndarray:
        """Log odds of a bucket (last axis bits) from its shares summed over languages with the bit and without."""
        mean = (sums + floor[:, None]) / members[:, None]
        return np.log(mean[0]) - np.log(mean[1])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict[int, int] = {}
        sums = np.zeros((2, 1024, bits))
        for rows in batches:
            lang, share = numbered(rows)
            for s in range(0, len(rows), SLICE // bits + 1):
                part = slice(s, s + SLICE // bits + 1)
                at = np.array([place.setdefault(x, len(place)) for x in rows["bucket"].to_numpy()[part].tolist()])
                while len(place) > sums.shape[1]:
                    sums = np.concatenate((sums, np.zeros_like(sums)), axis=1)
                np.add.at(sums[0], at, share[part, None] * set_[lang[part]])
                np.add.at(sums[1], at, share[part, None] * (1 - set_[lang[part]]))
        if place:
            found = odds(sums[:, : len(place)]).astype("<f4")
            yield pd.DataFrame({"bucket": list(place), "weights": [w.tobytes() for w in found]})

    weights = np.tile(odds(np.zeros((2, 1, bits))).astype(np.float32), (BUCKETS, 1))
    for r in counted.repartition("bucket").mapInPandas(weigh, "bucket int, weights binary").collect():
        weights[r["bucket"]] = np.frombuffer(r["weights"], "<f4")
    everywhere = weights.sum(axis=0, dtype=np.float64)

    def separate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(languages), bits))
        for rows in batches:
            lang, share = numbered(rows)
            buckets = rows["bucket"].to_numpy()
            for s in range(0, len(rows), SLICE // bits + 1):
                part = slice(s, s + SLICE // bits + 1)
                np.add.at(sums, lang[part], share[part, None] * weights[buckets[part]])
        met = np.flatnonzero(sums.any(axis=1))
        if not len(met):
            return
        yield pd.DataFrame({"lang": [languages[k] for k in met], "mean": [sums[k].tolist() for k in met]})

    met = counted.repartition("lang").mapInPandas(separate, "lang string, mean array<double>").select(
        "lang", F.posexplode("mean").alias("bit", "x")).groupBy("lang", "bit").agg(F.sum("x").alias("x"))
    mean = np.outer(least, everywhere)
    for r in met.toLocalIterator():
        mean[number[r["lang"]], r["bit"]] += r["x"]
    trust = np.maximum(1e-3, (code * mean).min(axis=0))
    return Model(languages, code, weights, trust)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred, score and ambiguous; only the text is looked at."""

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def label(texts: pd.Series) -> pd.DataFrame:
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        data, starts, ends, null = _buffers(column)
        known = ~null & np.fromiter((t is not None and any(map(str.isalpha, t)) for t in texts), bool, len(texts))
        if not model.languages:
            known[:] = False
            best, score, tied = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.ones(len(texts), bool)
        else:
            best, score, tied = model.decode(model.margins(data, starts, ends))
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        return pd.DataFrame({"lang_pred": names[np.where(known, best, len(model.languages))], "score": np.where(known, score, 0.0), "ambiguous": tied | ~known})

    # Marked so that a filter on the result does not make Spark run the function twice.
    labels = bounded(docs).select(F.struct(*keep).alias("k"), label.asNondeterministic()(F.col("text")).alias("r"))
    return labels.select("k.*", "r.lang_pred", "r.score", "r.ambiguous")


def identify(docs: DataFrame) -> DataFrame:
    """Train on rows whose crc32 of the id's text is not 1 modulo 3, and predict every row.

    A null id has no remainder; such rows train nothing and are not held out.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs.filter(rest != 1))
    marked = docs.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model, ("doc_id", "held_out"))
