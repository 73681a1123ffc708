"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised inside a sentence) and
units turn into typed placeholders, all else is lower-cased without outer
punctuation. Windows of ``WINDOW`` tokens of the benchmark's templates are
hash-joined with the documents' windows. Along one alignment of document and
template, equal benchmark slots must hold equal values; a document is contaminated
when consistent alignments cover ``COVERAGE`` of a template's windows, so a question
with other numbers or names is caught and a chance mixture of them is not.

Items with one template and one pattern of equal slots are one class, named by its
smallest item id, so variants of a question do not multiply the pairs and none is
bound by another's chance equalities. Document windows are tested against a
fixed-size Bloom filter of the benchmark's hashes inside the task; only those that
pass are joined. The filter's size does not depend on either table; false positives
fall out in the join.

Defined cases: null and empty texts, on either side, have no windows and match
nothing; an item shorter than a window is one window of its own length; windows with
fewer literals than ``LITERALS`` (or all their tokens, if shorter) count like others
but are compared in plain form: lower-cased words with names as words or, if numbers
and units leave too few literals even so, all words as they are. Items with names
are also compared as a whole in plain form, so that copies in other case are found;
repeated rows are reported once per id; a null id is reported as null; an empty
table gives an empty result; extra columns are ignored, and kept by ``clean``.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownerlens.llm.batches import bounded
from ownerlens.session import materialise

WINDOW = 5
COVERAGE = 0.8
LITERALS = 3
#: Bits of the filter; two probes per window.
FILTER_BITS = 1 << 24
#: Words remembered per task; the memo starts anew when full.
MEMO = 100_000

UNITS = frozenset("""mm cm m km in ft mi mg g kg t oz lb lbs ml cl l ms s sec secs min mins h hr hrs kb mb gb tb hz khz mhz ghz w kw mw kwh v a pa bar
inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms ton tons
tonne tonnes liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros
cent cents pound pounds percent degrees""".split())
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|€|£|\$)?")
_MEASURE = re.compile(r"[-+]?\d[\d.,]*([a-zµ]+)")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%€£$]+$")
_M = np.uint64(0x9E3779B97F4A7C15)
_NAME = xxhash.xxh3_64_intdigest("<name>")


def _kind(word: str) -> tuple[str, str, bool]:
    """Lower-cased core of a word, its placeholder ('' if none) and whether the core is capitalised."""
    if word.isalpha():
        core = word
    elif word[-1] in ".,;:!?" and word[:-1].isalpha():
        core = word[:-1]
    else:
        core = _EDGE.sub("", word)
    low = core.lower()
    if not core.isalpha():
        if _NUMBER.fullmatch(low):
            return low, "<num>", False
        if (m := _MEASURE.fullmatch(low)) and m[1] in UNITS:
            return low, "<measure>", False
    if low in UNITS and len(low) > 1:
        return low, "<unit>", False
    return low, "", core[:1].isupper()


def token(word: str, initial: bool) -> tuple[str, str | None]:
    """Template token of a word and, for a placeholder, the slot's value."""
    low, kind, capital = _kind(word)
    if kind:
        return kind, low
    return ("<name>", low) if capital and not initial else (low, None)


class Canonical:
    """Texts to template tokens, by number; per word and position in the sentence it is worked out once."""

    #: Flags of a word: a placeholder at the start of a sentence, inside one, and whether it ends one.
    FIRST, INSIDE, ENDS = 1, 2, 4

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.size = 1 << 12
        self.first, self.inside, self.lower = (np.zeros(self.size, np.uint64) for _ in range(3))
        self.flags = np.zeros(self.size, np.uint8)

    def _add(self, word: str) -> int:
        i = self.ids[word] = len(self.ids)
        if i == self.size:
            self.size *= 2
            self.first, self.inside, self.lower, self.flags = (np.resize(x, self.size) for x in (self.first, self.inside, self.lower, self.flags))
        low, kind, capital = _kind(word)
        h = xxhash.xxh3_64_intdigest(kind or low)
        self.first[i], self.inside[i] = h, _NAME if capital else h
        self.lower[i] = xxhash.xxh3_64_intdigest(low) if kind else h
        ends = word[-1] in ".!?:;" or word.rstrip("\"')”»")[-1:] in (".", "!", "?")
        self.flags[i] = (self.FIRST | self.INSIDE if kind else self.INSIDE if capital else 0) | (self.ENDS if ends else 0)
        return i

    def forms(self, text: str) -> tuple[list[str], np.ndarray, tuple, tuple, np.ndarray]:
        """Words, whether each begins a sentence, (token hashes, whether a placeholder) with names and without, word hashes."""
        words = text.split()
        if len(self.ids) > MEMO:
            self.ids.clear()
        get, add = self.ids.get, self._add
        at = np.array([i if (i := get(w)) is not None else add(w) for w in words], np.int64)
        flags = self.flags[at]
        initial = np.ones(len(at), bool)
        initial[1:] = flags[:-1] & self.ENDS
        slot = (flags & np.where(initial, self.FIRST, self.INSIDE).astype(np.uint8)) > 0
        first = self.first[at]
        return words, initial, (np.where(initial, first, self.inside[at]), slot), (first, (flags & self.FIRST) > 0), self.lower[at]

    def __call__(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words, token hashes, whether each is a placeholder, whether each begins a sentence."""
        words, initial, (hashes, slot), _, _ = self.forms(text)
        return words, hashes, slot, initial


def windows(hashes: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the windows of ``size`` tokens with enough literals."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, free = np.full(n, size, np.uint64), np.zeros(n, np.int64)
    for k in range(size):
        h = (h ^ hashes[k : k + n]) * _M
        h ^= h >> np.uint64(29)
        free += ~slot[k : k + n]
    use = np.flatnonzero(free >= min(LITERALS, size))
    return use, h[use]


def plain_windows(plain: tuple[np.ndarray, np.ndarray], lower: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words, names as words; numbers and units too where few literals are left."""
    h = windows(lower, np.zeros(len(lower), bool), size)[1]
    at, rich = windows(*plain, size)
    h[at] = rich
    return h


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (h >> np.uint64(8)) & mask, (h >> np.uint64(36)) & mask


def item_windows(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(item, n, size, pos, hash, groups): windows of each class; ``groups`` numbers the slots' values.

    Slots of one class share a group where all its items have equal values there. An
    item with names has a second key, with all windows in plain form; both bear the
    name of the template class.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canonical()
        for batch in batches:
            rows = []
            for item, t in zip(batch["item_id"], batch["text"]):
                words, initial, (hashes, slot), plain, lower = canon.forms(t or "")
                if not words:
                    continue
                size = min(WINDOW, len(words))
                at, h = windows(hashes, slot, size)
                exact = plain_windows(plain, lower, size)
                n = len(exact)
                values = [token(w, i)[1] for w, i in zip(words, initial)]
                unnamed = [v if p else None for v, p in zip(values, plain[1].tolist())]
                group = {v: g for g, v in enumerate(dict.fromkeys(v for v in values if v is not None))}
                found = [(a, x, values[a : a + size]) for a, x in zip(at.tolist(), h.view(np.int64).tolist())]
                poor = np.setdiff1d(np.arange(n), at)
                pattern = [group[v] for v in values if v is not None]
                inside, v = token(words[0], False)
                if found and found[0][0] == 0 and v is not None and values[0] is None:
                    # In a document the first word may stand inside a sentence, where it is a name.
                    other, mark = hashes[:size].copy(), slot[:size].copy()
                    other[0], mark[0] = xxhash.xxh3_64_intdigest(inside), True
                    pattern.append(group.setdefault(v, len(group)))
                    found += [(0, x, [v, *values[1:size]]) for x in windows(other, mark, size)[1].view(np.int64).tolist()]
                whole = [(a, x, unnamed[a : a + size]) for a, x in enumerate(exact.view(np.int64).tolist())]
                found += [whole[a] for a in poor]
                number = lambda kind, *parts: xxhash.xxh3_64_intdigest(kind + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)) - 2**63
                root = number(b"t", hashes, np.array(pattern, np.int64), exact[poor])
                keyed = [(root, found)]
                if (h != exact[at]).any():
                    keyed.append((number(b"p", exact, np.array([group[v] for v in unnamed if v is not None], np.int64)), whole))
                for key, windows_ in keyed:
                    for a, x, own in windows_:
                        own = [v for v in own if v is not None]
                        rows.append((item, root, key, n, size, a, x, [group[v] for v in own], own))
            yield pd.DataFrame(rows, columns=["item", "root", "key", "n", "size", "pos", "hash", "groups", "own"])

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col(text).alias("text"))
    found = rows.mapInPandas(split, "item bigint, root bigint, key bigint, n int, size int, pos int, hash bigint, groups array<int>, own array<string>")
    found = materialise(found, "all-item-windows")
    kept = found.groupBy(F.col("key").alias("_k")).agg(F.min("item").alias("_i"))
    names = found.groupBy(F.col("root").alias("_r")).agg(F.min("item").alias("name"))
    mine = found.join(kept, (F.col("key") == F.col("_k")) & F.col("item").eqNullSafe(F.col("_i"))).join(names, F.col("root") == F.col("_r"))
    return mine.dropDuplicates(["key", "hash", "pos"]).select(F.col("name").alias("item"), "key", "n", "size", "pos", "hash", "groups", "own")


def document_windows(docs: DataFrame, sizes: list[int], bits: np.ndarray, text: str = "text") -> DataFrame:
    """(doc_id, rid, size, at, hash, values) of the windows that pass the filter."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canonical()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            for doc_id, rid, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = value.as_py()
                if not t:
                    continue
                words, initial, named, plain, lower = canon.forms(t)
                for size in sizes:
                    h = plain_windows(plain, lower, size)
                    at, x = windows(*named, size)
                    other = x != h[at]
                    # Windows with names go in both forms.
                    at, h, whole = np.concatenate((np.arange(len(h)), at[other])), np.concatenate((h, x[other])), len(h)
                    p, q = _probes(h)
                    near = (bits[p >> np.uint64(3)] >> (p & np.uint64(7)) & 1) & (bits[q >> np.uint64(3)] >> (q & np.uint64(7)) & 1)
                    for k in np.flatnonzero(near):
                        a = int(at[k])
                        values = [v for i in range(a, a + size) if (v := token(words[i], bool(k < whole or initial[i]))[1]) is not None]
                        for column, x in zip(rows, (doc_id, rid, size, a, int(h[k : k + 1].view(np.int64)[0]), values)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "rid", "size", "at", "hash", "values"])

    rows = bounded(docs).select("doc_id", F.xxhash64(text).alias("rid"), F.col(text).alias("text"))
    return rows.mapInArrow(split, "doc_id bigint, rid bigint, size int, at int, hash bigint, values array<string>")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, rid, item_id, coverage, verbatim) for every document and template class it holds.

    ``verbatim`` tells whether the slots have the values of the class's smallest item
    or, with an item's names as words, those of the smallest item with these names.
    """
    items = materialise(item_windows(benchmark), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW numbers
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    probe = [F.shiftrightunsigned("hash", s).bitwiseAND(FILTER_BITS - 1) for s in (8, 36)]
    for batch in items.select(F.explode(F.array(*probe)).alias("b")).distinct().toLocalIterator():  # at most FILTER_BITS numbers
        bits[batch["b"] >> 3] |= np.uint8(1 << (batch["b"] & 7))
    found = document_windows(docs, sizes, bits, text)
    pairs = found.join(items.select("key", "item", "n", "pos", "groups", "own", F.col("hash").alias("_h"), F.col("size").alias("_s")), (F.col("hash") == F.col("_h")) & (F.col("size") == F.col("_s")))
    pairs = pairs.withColumn("diag", F.col("at") - F.col("pos"))
    pairs = materialise(pairs.select("doc_id", "rid", "key", "item", "n", "pos", "diag", "groups", "values", (F.col("values") == F.col("own")).alias("same")), "leak-pairs")
    line = ["doc_id", "rid", "key", "diag"]
    slots = pairs.select(*line, F.explode(F.arrays_zip("groups", "values")).alias("s")).groupBy(*line, F.col("s.groups").alias("g"))
    broken = slots.agg(F.min("s.values").alias("a"), F.max("s.values").alias("z")).filter("a <> z").select(*[F.col(c).alias(f"_{c}") for c in line]).distinct()
    on = F.lit(True)
    for c in line:
        on = on & pairs[c].eqNullSafe(F.col(f"_{c}"))
    whole = pairs.join(broken, on, "left_anti").groupBy("doc_id", "rid", "key").agg(
        F.min("item").alias("item_id"), F.first("n").alias("n"), F.count_distinct("pos").alias("k"), F.count_distinct(F.when(F.col("same"), F.col("pos"))).alias("v"))
    enough = whole.filter(F.col("k") >= COVERAGE * F.col("n"))
    return enough.groupBy("doc_id", "rid", "item_id").agg(F.max(F.round(F.col("k") / F.col("n"), 6)).alias("coverage"), F.max(F.col("v") == F.col("k")).alias("verbatim"))


def clean(docs: DataFrame, leaks: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    bad = leaks.select(F.col("doc_id").alias("_leak_doc"), F.col("rid").alias("_leak_rid")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_leak_doc"]) & (F.xxhash64(docs[text]) == bad["_leak_rid"]), "left_anti")
