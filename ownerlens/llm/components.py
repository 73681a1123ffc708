"""Connected components of an edge table, by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownerlens.session import materialise


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours, a partial aggregate."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least_neighbour(both).select(F.col("u").alias("_u"), "m")
    # Neighbours above the node hang on its least neighbour; one row per node joins, so hot nodes can be split.
    return both.filter("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    low = down.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    hung = down.join(low, F.col("u") == F.col("_u"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From (u, v): one row (node, root) per node of an edge, root being the least node of its component.

    Rounds are written to the shared folder; they end when the edges, all of them
    (node, root) by then, no longer change. No links: no rows. Self links are ignored.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        now = materialise(_small_star(_large_star(now)), "links")
        here = mark(now)
        if here == seen:
            break
        seen = here
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
