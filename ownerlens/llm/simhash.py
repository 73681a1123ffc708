"""Near-duplicates by SimHash: fingerprints, a binary trie self-join, components.

Fingerprints within a budget of differing bits are linked. With the 64 bits cut into
budget + e blocks, two such fingerprints agree on e whole blocks, so each fingerprint
goes into one trie per choice of e blocks, with their bits first. In such a trie only
the node pairs (x, x) at the blocks' depth can hold a pair that agrees on them; below,
pairs of nodes are traversed together (``trie.connect``). Every link is found in at
least one trie. ``SIMHASH`` copies a row five times, ``WIDE`` 45 times.

Equal fingerprints are merged before the join, so a group of copies is one key. A
node with more than ``MAX_NODE`` keys is dealt into chunks, and pairs of chunks are
separate tasks: beyond 8,192 x ``MAX_NODE`` keys, 540 million, work grows with the
square of a node. Tasks return at most one link per key, never all pairs of a group.

``one_of_each`` looks wider and then holds texts against each other: components of
``WIDE`` fingerprints are candidates, and ``confirmed`` keeps a document apart unless
its five-word shingles are 0.8 like those of the document its group forms around.

Defined cases: null and empty texts have no words and fingerprint zero, linked like
any other, and are alike; repeated rows and repeated ids are rows of their own; a
component whose ids are all null has a null component_id; an empty table gives an
empty result; extra columns are ignored, and kept by ``one_of_each``.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ownerlens.llm.batches import bounded
from ownerlens.llm.components import components
from ownerlens.llm.trie import connect
from ownerlens.operators.keys import top_per_key
from ownerlens.session import materialise

SEED = 42
MAX_NODE = 1 << 16
#: Shingles whose bits are counted at once.
COUNTED = 1 << 14
#: Words of a shingle and likeness by which near copies are confirmed.
WORDS = 5
ALIKE = 0.8
#: Documents of a component that the others are held against in the first round; doubled every round.
CENTRES = 4


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, whether repeats count, bits that may differ, and blocks of equal bits that a trie starts with."""

    shingle: int = 4
    repeats: bool = True
    budget: int = 4
    equal: int = 1

    @property
    def tries(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """For every trie its starting depth and the 64 bits' pieces (shift, width) in the trie's order."""
        n = self.budget + self.equal
        sizes = [64 // n + (k < 64 % n) for k in range(n)]
        pieces = [(64 - sum(sizes[: k + 1]), sizes[k]) for k in range(n)]
        return [(sum(sizes[k] for k in first), [pieces[k] for k in first] + [pieces[k] for k in range(n) if k not in first]) for first in combinations(range(n), self.equal)]


SIMHASH = Scheme()
#: Of 64 bits near copies at 0.8 differ in 8 or fewer in nine cases of ten with this scheme, in 11 with the other.
WIDE = Scheme(shingle=2, repeats=False, budget=8, equal=2)


def turn(keys: np.ndarray, pieces: list[tuple[int, int]]) -> np.ndarray:
    """Keys with their pieces in the given order."""
    out = np.zeros_like(keys)
    for shift, width in pieces:
        out = (out << np.uint64(width)) | ((keys >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def turn_back(keys: np.ndarray, pieces: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros_like(keys), 64
    for shift, width in pieces:
        at -= width
        out |= ((keys >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(shift)
    return out


def fingerprint(text: str | None, scheme: Scheme = SIMHASH) -> int:
    """64 bits, each set where it is set in over half the shingles' hashes; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(scheme.shingle, n)
    ones, seen = np.zeros(64, np.int64), set()
    digest, count = xxhash.xxh64_intdigest, n - k + 1
    for s in range(0, n - k + 1, COUNTED):
        t = min(n - k + 1, s + COUNTED)
        a, b = starts[s:t].tolist(), (ends[s + k - 1 : t + k - 1] - 1).tolist()
        found = [digest(line[x:y], SEED) for x, y in zip(a, b)]
        if not scheme.repeats:
            found = list(set(found) - seen)
            seen.update(found)
            count = len(seen)
        h = np.array(found, ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", scheme: Scheme = SIMHASH) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) and rid (a hash of the text) for every row."""

    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, scheme) for t in texts], np.uint64).view(np.int64))

    return bounded(docs).select("doc_id", prints(F.col(text)).alias("fp"), F.xxhash64(text).alias("rid"))


def _tries(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """Each fingerprint once per trie: trie number, node at the starting depth, key with the trie's blocks first."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["fp"].to_numpy().view(np.uint64)
            for k, (depth, pieces) in enumerate(scheme.tries):
                turned = turn(keys, pieces)
                yield pd.DataFrame({"trie": np.int32(k), "node": (turned >> np.uint64(64 - depth)).view(np.int64), "key": turned.view(np.int64)})

    return fps.select("fp").mapInPandas(spread, "trie int, node bigint, key bigint")


def _tasks(rows: DataFrame, max_node: int) -> DataFrame:
    """Rows with the pair (i, j) of chunks they are compared in; one pair (0, 0) unless the node is large."""
    large = rows.groupBy(F.col("trie").alias("_t"), F.col("node").alias("_n")).count().filter(F.col("count") > max_node)
    k = F.ceil(F.coalesce("count", F.lit(1)) / max_node).cast("int")
    rows = rows.join(large, (F.col("trie") == F.col("_t")) & (F.col("node") == F.col("_n")), "left")
    rows = rows.select("trie", "node", "key", k.alias("k"), F.pmod(F.xxhash64("key"), k).cast("int").alias("c"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select("trie", "node", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), (F.col("c") > F.col("x")).alias("second"), "key")


def _join(scheme: Scheme):
    """Trie joins of whole tasks; rows arrive sorted by task, side and key."""
    tries = scheme.tries

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        task = rows[["trie", "node", "i", "j"]].to_numpy()
        keys, second = rows["key"].to_numpy().view(np.uint64), rows["second"].to_numpy()
        new = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]).any(axis=1)])
        end = np.r_[new[1:], len(rows)]
        cut = new + np.add.reduceat((~second).astype(np.int64), new)
        own = task[new, 2] == task[new, 3]
        b0, b1 = np.where(own, new, cut), np.where(own, cut, end)
        u, v = [], []
        for k in np.unique(task[new, 0]).tolist():
            t = np.flatnonzero((task[new, 0] == k) & (new < cut) & (b0 < b1) & ((end - new > 1) | ~own))
            if not len(t):
                continue
            lo, hi = int(new[t[0]]), int(end[t[-1]])
            part = keys[lo:hi]
            depth, pieces = tries[k]
            root = connect(part, new[t] - lo, cut[t] - lo, b0[t] - lo, b1[t] - lo, depth, scheme.budget)
            moved = np.flatnonzero(root != np.arange(len(root)))
            u.append(turn_back(part[moved], pieces))
            v.append(turn_back(part[root[moved]], pieces))
        if not u:
            return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
        return pd.DataFrame({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for rows in batches:
            if not len(rows):
                continue
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = rows.iloc[-1]
            open_ = (rows["node"] == last["node"]) & (rows["trie"] == last["trie"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])
            held = rows[open_].reset_index(drop=True)
            if len(held) < len(rows):
                yield links(rows[~open_].reset_index(drop=True))
        if held is not None:
            yield links(held)

    return join


def links(fps: DataFrame, max_node: int = MAX_NODE, scheme: Scheme = SIMHASH) -> DataFrame:
    """(u, v): links that connect all fingerprints within the budget, at most one per key and task."""
    tasks = _tasks(_tries(fps, scheme), max_node)
    sorted_ = tasks.repartition("trie", "node", "i", "j").sortWithinPartitions("trie", "node", "i", "j", "second", F.col("key").bitwiseXOR(F.lit(-(2**63))))
    return sorted_.mapInPandas(_join(scheme), "u bigint, v bigint")


def labelled(docs: DataFrame, text: str = "text", max_node: int = MAX_NODE, scheme: Scheme = SIMHASH) -> DataFrame:
    """doc_id, fp, rid, root (the component's key) and component_id for every row."""
    prints = materialise(with_fingerprints(docs, text, scheme), "fingerprints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    classes = components(links(groups.select("fp"), max_node, scheme))
    rooted = groups.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "fingerprint-roots")
    least = rooted.groupBy(F.col("root").alias("_r")).agg(F.min("first").alias("component_id"))
    labels = rooted.join(least, F.col("root") == F.col("_r")).select(F.col("fp").alias("_f"), "root", "component_id")
    return prints.join(labels, F.col("fp") == F.col("_f")).select("doc_id", "fp", "rid", "root", "component_id")


def clusters(docs: DataFrame, text: str = "text", max_node: int = MAX_NODE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable, for every row."""
    return labelled(docs, text, max_node).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's different shingles of ``WORDS`` words; one stands for all texts without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(WORDS, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)), np.uint64)).view(np.int64)


def confirmed(members: DataFrame, alike: float = ALIKE, centres: int = CENTRES) -> DataFrame:
    """(rid, centre): texts with the text their group forms around, itself included.

    ``members`` holds (root, rid, fp, grams): texts of components of two or more. Each
    round the members nearest to the majority of their component's fingerprints are
    centres; a text joins the first centre that its shingles are alike to. Those left
    over are members of the next round, with twice as many centres, so a component of
    one family ends in a round and no component is compared as all its pairs.
    """
    rest, met = members, []
    bits = [F.sum(F.shiftright("fp", b).bitwiseAND(1)).alias(f"b{b}") for b in range(64)]
    while True:
        # Counts of set bits, one row per component.
        counts = rest.groupBy(F.col("root").alias("_r")).agg(F.count(F.lit(1)).alias("n"), *bits)
        middle = reduce(Column.bitwiseOR, [F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)])
        counts = counts.select("_r", "n", middle.alias("middle"))
        placed = rest.join(counts, F.col("root") == F.col("_r")).withColumn("off", F.bit_count(F.col("fp").bitwiseXOR(F.col("middle"))))
        # A component with one member left has nothing to be held against.
        many = placed.filter("n > 1").select("root", "rid", "fp", "grams", "off")
        first = top_per_key(many.select("root", "rid", "off", "grams"), ["root"], [F.col("off"), F.col("rid")], centres, "place")
        heads = first.select(F.col("root").alias("_c"), F.col("rid").alias("head"), F.col("grams").alias("_g"), "place")
        both = F.size(F.array_intersect("grams", "_g"))
        near = (F.least(F.size("grams"), F.size("_g")) >= alike * F.greatest(F.size("grams"), F.size("_g"))) & (both >= alike * (F.size("grams") + F.size("_g") - both))
        pairs = many.join(heads, F.col("root") == F.col("_c")).filter((F.col("rid") == F.col("head")) | near)
        # A centre that is like an earlier one joins it; what had joined the later one still stands for itself in the next round.
        best = materialise(pairs.groupBy("rid").agg(F.min(F.struct("place", "head")).alias("b")).select(F.col("rid").alias("_rid"), F.col("b.head").alias("centre")), "centres")
        open_ = best.filter("_rid = centre").select(F.col("centre").alias("_open"))
        held = materialise(best.join(open_, F.col("centre") == F.col("_open"), "left_semi"), "near")
        met.append(held)
        rest = materialise(many.join(held, F.col("rid") == F.col("_rid"), "left_anti").select("root", "rid", "fp", "grams"), "members")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, met).select(F.col("_rid").alias("rid"), "centre")
        centres *= 2


def near_groups(docs: DataFrame, text: str = "text", scheme: Scheme = WIDE) -> DataFrame:
    """(doc_id, rid, n, group): rows by id and text, how often they occur, and the group of near copies, confirmed by shingles."""
    rows = materialise(labelled(docs, text, scheme=scheme).groupBy("root", "fp", "rid", "doc_id").agg(F.count(F.lit(1)).alias("n")), "labelled")
    texts = rows.groupBy("rid").agg(F.min("root").alias("root"), F.min("fp").alias("fp"))
    several = texts.groupBy(F.col("root").alias("_r")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("_r")
    wanted = materialise(texts.join(several, F.col("root") == F.col("_r"), "left_semi"), "candidates")

    @F.pandas_udf("array<bigint>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t) for t in texts], dtype=object)

    own = bounded(docs).select(F.xxhash64(text).alias("_h"), F.col(text).alias("_t"))
    # One text of each hash; the hash alone would bring every copy.
    own = own.join(wanted.select("rid"), F.col("_h") == F.col("rid"), "left_semi").groupBy("_h").agg(F.first("_t").alias("_t"))
    members = materialise(wanted.join(own.select("_h", grams("_t").alias("grams")), F.col("rid") == F.col("_h")).select("root", "rid", "fp", "grams"), "members")
    near = confirmed(members)
    met = rows.join(near.select(F.col("rid").alias("_n"), "centre"), F.col("rid") == F.col("_n"), "left")
    return met.select("doc_id", "rid", "n", F.coalesce("centre", "rid").alias("group"))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of every group of near copies: the smallest id, then the smallest text hash; all columns kept."""
    rows = near_groups(docs, text)
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "n")).alias("b"))
    best = materialise(best.select(F.col("b.doc_id").alias("_kept_doc"), F.col("b.rid").alias("_kept_rid"), F.col("b.n").alias("_kept_rows")), "survivors")
    on = lambda best: docs["doc_id"].eqNullSafe(best["_kept_doc"]) & (F.xxhash64(docs[text]) == best["_kept_rid"])
    # Only rows that occur more than once have to be compared as wholes.
    single, several = best.filter(best["_kept_rows"] == 1), best.filter(best["_kept_rows"] > 1)
    return docs.join(single, on(single), "left_semi").unionByName(docs.join(several, on(several), "left_semi").dropDuplicates(["doc_id", text]))
