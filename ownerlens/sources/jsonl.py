"""JSON-lines corpora with their file and line, so problems can be reported."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

c = F.col


def parse_lines(lines: DataFrame, schema) -> DataFrame:
    """``(file, line_no, value)`` → the parsed record; blank and ``//`` lines are skipped.

    ``valid`` is false where a line is not a JSON object.
    """
    text = F.trim(c("value"))
    kept = lines.withColumn("value", text).filter((c("value") != "") & ~F.startswith(c("value"), F.lit("//")))
    probe = F.try_parse_json(c("value"))
    return kept.select(
        "file", "line_no", F.from_json("value", schema).alias("record"),
        (probe.isNotNull() & F.startswith(c("value"), F.lit("{"))).alias("valid"), "value",
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)`` of text files that Spark may split.

    A line's number is its place inside its file block plus the lines of the
    blocks before it, so a large file is still read by many tasks.
    """
    lines = spark.read.text(path).select(
        c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("_id")
    return lines.withColumn("_n", F.row_number().over(inside)).join(offsets, ["file", "block"]).select(
        "file", (c("before") + c("_n")).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return parse_lines(numbered_lines(spark, path), schema)
