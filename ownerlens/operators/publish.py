"""Publishing a run in two steps: its tables are written first, one pointer row makes them visible.

A run writes below ``run=<number>``; readers follow the newest pointer. A run whose
every extraction failed leaves no pointer, so neither its tables nor its URLs are
seen; rows that failed go to a dead-letter table that the next run reads first. Each
write goes to a folder named by the run, so a repeated run rewrites itself and
nothing else.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ownerlens.operators.extract import dead_letters, run_health
from ownerlens.operators.keys import first_per_key
from ownerlens.operators.registers import read_snapshot, snapshots, write_snapshot
from ownerlens.session import materialise

c = F.col


def pending(articles: DataFrame, root: str, run: int) -> DataFrame:
    """What a run has to extract: the dead letters of the run before, then new articles with unseen URLs, one of each URL."""
    spark = articles.sparkSession
    rows = articles.withColumn("_first", F.lit(1))
    letters = read_snapshot(spark, os.path.join(root, "dead"), before=run)
    if letters is not None:
        rows = letters.select(*articles.columns, F.lit(0).alias("_first")).unionByName(rows)
    seen = seen_urls(spark, root, run)
    if seen is not None:
        rows = rows.join(seen, "url", "left_anti")
    return first_per_key(rows, ["url"], ("_first", "seq")).drop("_first")


def seen_urls(spark: SparkSession, root: str, run: int) -> DataFrame | None:
    """URLs of all published rows before a run; those of a run without a pointer are not among them."""
    seen, pointers = snapshots(spark, os.path.join(root, "seen"), run), snapshots(spark, os.path.join(root, "pointer"), run)
    if seen is None or pointers is None:
        return None
    return seen.join(pointers.select("run"), "run", "left_semi").select("url").distinct()


def publish(rows: DataFrame, root: str, run: int, columns: list[str]) -> DataFrame:
    """Write one run of extracted ``rows`` (``columns`` and extraction) and return its health.

    Filtered articles are rows like others: their URLs stay seen. The pointer comes last.
    """
    rows = materialise(rows, "publish")
    health = run_health(rows).withColumn("run", F.lit(run))
    verdict = health.first()["verdict"]  # one row
    write_snapshot(dead_letters(rows).select(*columns), os.path.join(root, "dead"), run)
    if verdict != "nothing published":
        done = rows.filter(c("extraction").isNotNull())
        write_snapshot(done.withColumn("run", F.lit(run)), os.path.join(root, "articles"), run)
        write_snapshot(done.select("url", F.lit(run).alias("run")), os.path.join(root, "seen"), run)
        write_snapshot(rows.sparkSession.range(1).select(F.lit(run).alias("run"), F.lit(verdict).alias("verdict")), os.path.join(root, "pointer"), run)
    return health


def finished(spark: SparkSession, root: str) -> set[int]:
    """Numbers of the runs that have a pointer."""
    pointers = snapshots(spark, os.path.join(root, "pointer"), 1 << 62)
    return set() if pointers is None else {r["run"] for r in pointers.select("run").collect()}


def published(spark: SparkSession, root: str) -> DataFrame | None:
    """Articles of every run that has a pointer."""
    everything, pointers = snapshots(spark, os.path.join(root, "articles"), 1 << 62), snapshots(spark, os.path.join(root, "pointer"), 1 << 62)
    if everything is None or pointers is None:
        return None
    return everything.join(pointers.select("run"), "run", "left_semi")
