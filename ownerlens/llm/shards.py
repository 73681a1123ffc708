"""Sharding by extendible hashing, in DataFrame functions only.

A directory is addressed by the leading bits of a 60-bit hash. A bucket whose rows
exceed the byte limit is split on its next bit, and only such buckets; the others
keep their depth. The hash is 36 bits of the id's digest, then 12 of the text's,
then 12 dealt by row: rows of one id part by text, and equal rows by the last bits.

Defined cases: a null text or id counts as empty; a bucket that is still too large
at 60 bits is kept and marked ``fits = false``, and so is one row above the limit
at the 36 bits of its id, since no further bit parts it; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ownerlens.session import materialise

BITS = 60
#: Bits of the id's digest; what follows parts rows of one digest.
ID_BITS = 36
STEP = 6
#: Bytes of a row besides its text (two 64-bit numbers).
ROW_BYTES = 16
LIMIT_BYTES = 16 * 2**20


def _digits(c: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, n), 16, 10).cast("bigint")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, 60-bit hash and bytes of every row."""
    dealt = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(0xFFF)
    h = F.shiftleft(_digits(F.col("doc_id"), 9), 24) + F.shiftleft(_digits(F.col("text"), 3), 12) + dealt
    return docs.select("doc_id", h.alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("bigint").alias("n_bytes"))


def _cells(alive: DataFrame, base: int, limit: int) -> DataFrame:
    """For each prefix of base + STEP bits in use: the depth at which it fits, and its bucket.

    The aggregate leaves at most 2^STEP cells per bucket that is being split, so
    the windows below see that many rows per key, whatever the input's size.
    """
    deep = base + STEP
    cells = alive.groupBy(F.shiftright("h", BITS - deep).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    for d in range(base, deep + 1):
        w = Window.partitionBy(F.shiftright("cell", deep - d))
        cells = cells.withColumn(f"b{d}", F.sum("b").over(w)).withColumn(f"n{d}", F.sum("n").over(w))
    fit = F.coalesce(*[F.when(F.col(f"b{d}") <= limit, F.lit(d)) for d in range(base, deep + 1)])
    cells = cells.withColumn("fit", fit)
    at = F.coalesce("fit", F.lit(deep))
    pick = lambda k: reduce(lambda rest, d: F.when(at == d, F.col(f"{k}{d}")).otherwise(rest), range(base, deep + 1), F.lit(None))
    prefix = reduce(lambda rest, d: F.when(at == d, F.shiftright("cell", deep - d)).otherwise(rest), range(base, deep + 1), F.lit(None))
    alone = F.lit(deep >= ID_BITS) & (pick("n") == 1)
    return cells.select("cell", F.col("fit").isNotNull().alias("fits"), (F.col("fit").isNotNull() | alone).alias("settled"), at.alias("depth"),
                        prefix.alias("prefix"), pick("b").alias("shard_bytes"), pick("n").alias("shard_rows"))


def directory(rows: DataFrame, limit: int = LIMIT_BYTES) -> list[DataFrame]:
    """Cells of each round of splits; round k looks at STEP more bits of what did not fit before."""
    rounds: list[DataFrame] = []
    alive, base = rows.select("h", "n_bytes"), 0
    while True:
        cells = materialise(_cells(alive, base, limit), f"directory-{base}")
        base += STEP
        rounds.append(cells)
        if base == BITS or cells.filter(~F.col("settled")).isEmpty():
            return rounds
        alive = alive.join(cells.filter(~F.col("settled")).select(F.col("cell").alias("_c")), F.shiftright("h", BITS - base) == F.col("_c"), "left_semi")


def shard(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """One row per document: its shard (the bucket's bits), depth, and the shard's bytes and rows."""
    rows = materialise(hashed(docs), "shard-rows")
    parts, rest = [], rows
    rounds = directory(rows, limit)
    for k, cells in enumerate(rounds):
        last = k == len(rounds) - 1
        met = rest.join(cells, F.shiftright("h", BITS - STEP * (k + 1)) == F.col("cell"))
        parts.append(met if last else met.filter("settled"))
        rest = met.filter("not settled").select(*rows.columns)
    out = reduce(DataFrame.unionByName, parts)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return out.select("doc_id", bits.alias("shard"), "depth", "n_bytes", "shard_bytes", "shard_rows", "fits")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write whole documents, one folder per shard; ids must be unique. A column ``shard`` of theirs gives way to the shard's bits."""
    where = shard(docs, limit).select(F.col("doc_id").alias("_id"), "shard")
    met = docs.join(where, docs["doc_id"].eqNullSafe(where["_id"])).select(*[docs[c] for c in docs.columns if c != "shard"], where["shard"])
    met.repartition("shard").write.partitionBy("shard").mode("errorifexists").parquet(path)
