"""Structured Streaming over landed article files."""
from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ownerlens import schemas, vocab as V
from ownerlens.functions.dates import parse_feed_date
from ownerlens.operators import psc, registers

c = F.col
EDITION = ("4 hours", "4 hours", "2 hours")
LOOK_BACK = ("24 hours", "4 hours", "2 hours")


def landed_articles(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of landed JSON articles; ``published_at`` is NULL where unreadable."""
    reader = spark.readStream.schema(schemas.RAW_ARTICLE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).withColumn("published_at", parse_feed_date(c("published_at_raw")).cast("timestamp"))


def distinct_urls(stream: DataFrame, ts: str = "published_at", horizon: str = f"{V.FRESHNESS_HOURS} hours") -> DataFrame:
    """First sighting of a URL; state is dropped once the freshness window has passed."""
    return stream.filter(c(ts).isNotNull()).withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["url"])


def run_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process what has landed and stop: the scheduled run of the reference cadence."""
    query = (
        stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query


def for_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows (partial counts, where rows are counted first) that came behind the watermark and were left out, over the batches the query remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def observed(query: StreamingQuery, name: str) -> dict[str, int]:
    """Sums of an observation over the batches the query remembers."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        row = progress["observedMetrics"].get(name)
        for metric, value in (row.asDict() if row else {}).items():
            total[metric] = total.get(metric, 0) + value
    return total


def route_dated(stream: DataFrame, path: str, checkpoint: str) -> dict[str, int]:
    """Dated rows to one part of a table, undated ones to a quarantine part, in one pass over each batch.

    The table is partitioned by ``kind`` below a folder per batch, so a replayed batch
    overwrites itself.  Returns how many rows of either kind went by, counted while
    they were written.
    """
    undated = c("published_at").isNull()
    routed = stream.withColumn("kind", F.when(undated, "undated").otherwise("dated")).observe(
        "routed", F.count_if(~undated).alias("dated"), F.count_if(undated).alias("undated"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(os.path.join(path, f"batch={batch_id}"))

    return observed(for_each_batch(routed, write, checkpoint), "routed")


def windowed_counts(rows: DataFrame, ts: str, spec: tuple[str, str, str], late: str | None = None) -> DataFrame:
    """Rows per window; works on a table and, with ``late`` as watermark, on a stream.

    On a stream in append mode a window is told once, when the watermark has passed
    its end; rows that come later still are left out and counted (``late_rows``).
    """
    source = rows.withWatermark(ts, late) if late else rows
    return source.groupBy(F.window(ts, *spec).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def upsert_companies(stream: DataFrame, root: str, checkpoint: str, buckets: int = registers.BUCKETS) -> None:
    """Company register in buckets: batch ``k`` merges into the buckets it touches, as they were before ``k``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        registers.merge_buckets(batch.filter(F.trim(F.coalesce("company", F.lit(""))) != ""), root, batch_id, F.lower(F.trim("company")), registers.upsert_companies, buckets)

    for_each_batch(stream, write, checkpoint)


def upsert_holdings(stream: DataFrame, root: str, checkpoint: str, buckets: int = registers.BUCKETS) -> None:
    """Ownership register in buckets: new disclosures only, earlier sighting wins."""
    key = F.concat_ws("\x1f", *psc.identity())

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        return psc.deduplicate(batch if before is None else before.unionByName(batch))

    def write(batch: DataFrame, batch_id: int) -> None:
        registers.merge_buckets(batch, root, batch_id, key, merge, buckets)

    for_each_batch(stream, write, checkpoint)


def alert_stream(stream: DataFrame) -> DataFrame:
    """Stateless: rows at high risk or importance."""
    return stream.filter(c("risk_level").isin("High", "Critical") | (c("importance") >= 75)).withColumn(
        "severity", F.when(c("risk_level") == "Critical", "Critical").when(c("risk_level") == "High", "Warning").otherwise("Info"))
