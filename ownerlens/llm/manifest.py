"""Merkle manifest of a table: a tree of digests per source, and one over the sources.

Nodes are rows (tree, idx, size, hash). At every level each node is equijoined with
its siblings, found by shifting its slot within the run of ``FAN_OUT`` (for two, the
other index is idx XOR 1); the slot-zero row of a run then emits the parent. A level
is a third of the one below, so all levels together cost half of the first. Paths
(the siblings to the left and right at every level) go down the same tree level by
level, so a row is joined once with its parent's path and not once a level.

Trees are numbered by one distributed sort, no source is collected, and levels are
written to the shared folder, so a hot source is as many keys as it has runs.

Defined cases: a null field is ``-``; a null source is a tree of its own, the first;
rows of one source with a null id come first; rows with one id ascend by leaf; equal
rows are leaves of their own; a row whose id is null is not tampered with; a null
text has no line breaks to lose; an empty table gives an empty result; extra columns
are ignored.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ownerlens.operators.keys import global_rank
from ownerlens.session import materialise

FAN_OUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_RESULT = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of a row, with ``text`` in the place of its text."""
    return digest(*[field(text if name == "text" else F.col(name)) for name in fields])


def tampered_text() -> Column:
    """Text of a row after tampering: rows with an even check sum of the id lose their line breaks."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def linked(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, idx, hash, ...) with their run and the siblings left and right of them, joined by shifted index."""
    out = nodes.withColumns({"run": F.floor(F.col("idx") / FAN_OUT).cast("bigint"), "slot": (F.col("idx") % FAN_OUT).cast("int")})
    for k in range(1, FAN_OUT):
        other = nodes.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("hash").alias(f"_h{k}"))
        at = F.col("run") * FAN_OUT + (F.col("slot") + k) % FAN_OUT
        out = out.join(other, (F.col("tree") == F.col("_t")) & (at == F.col("_i")), "left").drop("_t", "_i")

    def side(left: bool) -> Column:
        # The node k slots on, cyclically, stands before this one if its slot has wrapped round.
        order = range(1, FAN_OUT)
        wrapped = [F.when((F.col("slot") + k >= FAN_OUT) == F.lit(left), F.col(f"_h{k}")) for k in order]
        return F.concat_ws("", *wrapped)

    return out.withColumns({"l": side(True), "r": side(False)}).drop(*[f"_h{k}" for k in range(1, FAN_OUT)])


def grow(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees, each written once, and (tree, hash) of their roots.

    ``nodes`` holds tree, idx (from 0), size (the tree's nodes) and hash; ``largest`` is the largest size.
    """
    levels, roots = [], []
    while True:
        roots.append(nodes.filter("size = 1").select("tree", "hash"))
        if largest <= 1:
            return levels, reduce(DataFrame.unionByName, roots)
        level = materialise(linked(nodes.filter("size > 1")), f"manifest-{len(levels)}")
        levels.append(level)
        size = F.ceil(F.col("size") / FAN_OUT).cast("bigint")
        nodes = level.filter("slot = 0").select("tree", F.col("run").alias("idx"), size.alias("size"), digest(F.col("hash"), F.col("r")).alias("hash"))
        largest = -(-largest // FAN_OUT)


def paths(levels: list[DataFrame]) -> DataFrame | None:
    """(tree, idx, path) of the lowest level's nodes; a path lists (l, r) from there to the tree's root."""
    above = None
    for level in reversed(levels):
        own = level.select("tree", "idx", "run", F.array(F.struct("l", "r")).alias("own"))
        if above is None:
            above = own.select("tree", "idx", F.col("own").alias("path"))
            continue
        up = above.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("path").alias("_p"))
        met = own.join(up, (F.col("tree") == F.col("_t")) & (F.col("run") == F.col("_i")), "left")
        above = met.select("tree", "idx", F.when(F.col("_p").isNull(), F.col("own")).otherwise(F.concat("own", "_p")).alias("path"))
    return above


def folded(start: Column, path: Column) -> Column:
    """Root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda at, step: digest(step["l"], at, step["r"]))


def _with_paths(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``rows`` (tree, idx, ...) with their path inside the tree; a lone node has an empty one."""
    none = F.array().cast("array<struct<l: string, r: string>>")
    found = paths(levels)
    if found is None:
        return rows.withColumn("path", none)
    found = found.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), F.col("path").alias("_p"))
    met = rows.join(found, (F.col("tree") == F.col("_t")) & (F.col("idx") == F.col("_i")), "left")
    return met.withColumn("path", F.coalesce("_p", none)).drop("_t", "_i", "_p")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and tampered (the leaf after tampering) of every row."""
    rows = docs.select(*[F.col(c) for c in FIELDS])
    return rows.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), leaf(tampered_text()).alias("tampered"))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots, proof and check of every row, as (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    ranked = global_rank(leaves(docs), order)
    sources = ranked.groupBy("source").agg(F.min("rank").alias("tree"), F.count(F.lit(1)).alias("size"))
    sources = materialise(sources, "manifest-sources")
    largest = sources.agg(F.max("size")).first()[0]
    if largest is None:
        return docs.sparkSession.createDataFrame([], _RESULT)
    of = sources.select(F.col("source").alias("_s"), "tree", "size")
    rows = ranked.join(of, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "tree", (F.col("rank") - F.col("tree")).alias("idx"), "size", F.col("leaf").alias("hash"), "tampered")
    rows = materialise(rows, "manifest-leaves")

    levels, subroots = grow(rows.select("tree", "idx", "size", "hash"), largest)
    # Trees are numbered by their first row's place, so their order is that of the sources.
    top = global_rank(subroots, F.col("tree"))
    count = sources.count()
    crown = top.select(F.lit(0).cast("bigint").alias("tree"), (F.col("rank") - 1).alias("idx"), F.lit(count).cast("bigint").alias("size"), "hash", F.col("tree").alias("of"))
    crowned = _with_paths(crown, grow(crown.drop("of"), count)[0])
    heads = crowned.select(F.col("of").alias("_tree"), F.col("hash").alias("subroot"), F.col("path").alias("_top"), folded(F.col("hash"), F.col("path")).alias("root"))

    met = _with_paths(rows, levels).join(heads, F.col("tree") == F.col("_tree"))
    met = met.withColumn("path", F.concat("path", "_top"))
    proof = F.sha2(F.array_join(F.transform("path", lambda step: F.concat(step["l"], step["r"])), ""), 256)
    out = met.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
