"""Key-based building blocks shared by the registers, feeds and graph.

All of them tolerate one key holding a large share of the rows: first/latest/
top-k per key are cut down on the map side (Spark's WindowGroupLimit) before
the shuffle, counts are partially aggregated, and a running number over the
whole table never needs a single partition.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ownerlens.session import materialise

c = F.col


def _cols(keys: Sequence[str | Column]) -> list[Column]:
    return [c(k) if isinstance(k, str) else k for k in keys]


def top_per_key(df: DataFrame, keys, order, k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key.

    ``row_number() <= k`` right above the window lets Spark drop all but ``k``
    rows per key and map task before the exchange, so a hot key is harmless.
    """
    name = rank or "_rank"
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(c(name) <= k)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys, order=("seq",)) -> DataFrame:
    return top_per_key(df, keys, [c(o) if isinstance(o, str) else o for o in order], 1)


def latest_per_key(df: DataFrame, keys, order: str = "seq") -> DataFrame:
    return top_per_key(df, keys, [c(order).desc()], 1)


def global_rank(df: DataFrame, order: Column | Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in a total ``order``, fully distributed.

    The rows are sorted by range once and written with their place inside their
    partition; each partition's offset follows from the sizes of those before it,
    one row per partition.
    """
    keys = [order] if isinstance(order, Column) else list(order)
    placed = df.orderBy(*keys).withColumns({
        "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    rows = materialise(placed, "ranked")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "_part").withColumn(name, c("_offset") + c("_at") + 1).drop("_part", "_at", "_offset")


def known_anti_join(candidates: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not in the store; a NULL key is never known."""
    return candidates.join(store.select(key).distinct(), key, "left_anti")


def new_by_key(candidates: DataFrame, store: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Unknown keys only, the first arrival of each.

    Reduced to one row per key before the anti join, so copies of one key never
    travel further than their map task.
    """
    return known_anti_join(first_per_key(candidates, [key], (order,)), store, key)


def zero_filled(counts: DataFrame, key: str, values: Sequence[str], n: str = "n") -> DataFrame:
    """``counts`` completed with a zero row for every expected value."""
    spark = counts.sparkSession
    levels = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(key))
    return levels.join(counts, key, "left").select(key, F.coalesce(n, F.lit(0)).cast("bigint").alias(n))
