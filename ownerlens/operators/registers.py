"""Register tables: upserts, numbering, versions, schema migration, exports."""
from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ownerlens import vocab as V
from ownerlens.functions import scoring as S, text as T
from ownerlens.operators.keys import global_rank, new_by_key
from ownerlens.session import materialise

c = F.col

# ------------------------------------------------------------- numbering


def number_articles(new: DataFrame, store: DataFrame, order: str = "seq") -> DataFrame:
    """New articles with ids continuing after the highest id in the store."""
    highest = store.agg(F.coalesce(F.max(T.whole_id(c("id"))), F.lit(0))).scalar()
    return global_rank(new, c(order), "_n").withColumn("id", highest + c("_n")).drop("_n")


def add_articles(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """Unknown URLs only, first arrival wins, numbered."""
    return number_articles(new_by_key(candidates, store, "url"), store)


# ------------------------------------------------------------- companies


def upsert_companies(mentions: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Company register after a batch of mentions ``(seq, company, seen_at, industry, risk_level)``.

    First casing is kept, mentions add up, the latest non-empty industry and
    risk win.  Everything is a mergeable aggregate, so a company holding a
    third of all mentions is combined map-side; the previous snapshot joins in
    as one more row per company that sorts before every mention.
    """
    rows = mentions.filter(T.strip(F.coalesce(c("company"), F.lit(""))) != "").select(
        c("seq").cast("bigint").alias("seq"), F.trim(c("company")).alias("company"), F.lit(1).cast("bigint").alias("n"),
        c("seen_at"), T.non_empty(c("industry")).alias("industry"), T.non_empty(c("risk_level")).alias("risk_level"),
    )
    if snapshot is not None:
        rows = rows.unionByName(snapshot.select(
            F.lit(-1).cast("bigint").alias("seq"), "company", c("mention_count").cast("bigint").alias("n"),
            c("last_seen").alias("seen_at"), T.non_empty(c("industry")).alias("industry"),
            T.non_empty(c("risk_level")).alias("risk_level"),
        ))
    return rows.groupBy(F.lower("company").alias("_key")).agg(
        F.min_by("company", "seq").alias("company"),
        F.sum("n").alias("mention_count"),
        F.max("seen_at").alias("last_seen"),
        F.coalesce(F.max_by("industry", F.when(c("industry").isNotNull(), c("seq"))), F.lit("General")).alias("industry"),
        F.coalesce(F.max_by("risk_level", F.when(c("risk_level").isNotNull(), c("seq"))), F.lit("Low")).alias("risk_level"),
    ).drop("_key")


# ------------------------------------------------------------- versions


def _version_path(root: str, version: int) -> str:
    return os.path.join(root, f"version={version:012d}")


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions; a directory listing, not data."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        success = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(success):
            done.append(int(name.split("=")[1]))
    return sorted(done)


def read_snapshot(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The latest finished version (older than ``before`` when given)."""
    known = [v for v in _versions(spark, root) if before is None or v < before]
    return spark.read.parquet(_version_path(root, known[-1])) if known else None


def snapshots(spark: SparkSession, root: str, before: int) -> DataFrame | None:
    """The rows of all finished versions older than ``before``."""
    known = [v for v in _versions(spark, root) if v < before]
    return spark.read.parquet(*[_version_path(root, v) for v in known]) if known else None


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write one version.  Replaying the same version rewrites the same rows from
    the same predecessor, so a retried batch changes nothing."""
    path = _version_path(root, version)
    df.write.mode("overwrite").parquet(path)
    return path


# ------------------------------------------------------------- buckets

#: Buckets of a register by hash of its key.
BUCKETS = 64


def _placed(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """Version that holds each bucket, by the newest finished pointer; at most as many numbers as buckets."""
    pointer = read_snapshot(spark, os.path.join(root, "pointer"), before)
    return {} if pointer is None else {r["bucket"]: r["held"] for r in pointer.collect()}


def _bucket_path(root: str, version: int, bucket: int) -> str:
    return os.path.join(_version_path(os.path.join(root, "rows"), version), f"bucket={bucket}")


def read_buckets(spark: SparkSession, root: str, wanted: Sequence[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The register, or some of its buckets, as it stands (before a version when given)."""
    placed = _placed(spark, root, before)
    paths = [_bucket_path(root, version, bucket) for bucket, version in sorted(placed.items()) if wanted is None or bucket in wanted]
    return spark.read.parquet(*paths) if paths else None


def merge_buckets(batch: DataFrame, root: str, version: int, key: Column, merge: Callable[[DataFrame, DataFrame | None], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Merge a batch into the buckets of a register that it touches, and return these.

    ``key`` is an expression over batch and register alike; ``merge(batch, rows held)``
    gives the new rows.  Only touched buckets are read and rewritten, below this version;
    the pointer written last says which version holds each bucket.  A repeated batch
    reads what stood before its version and rewrites itself.  Buckets that neither
    this pointer nor the one before names are dropped.
    """
    spark = batch.sparkSession
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    batch = materialise(batch, "register-batch")
    touched = sorted(r[0] for r in batch.select(place.alias("b")).distinct().collect())  # at most `buckets` numbers
    placed = _placed(spark, root, version)
    if touched:
        merged = merge(batch, read_buckets(spark, root, touched, version))
        merged.withColumn("bucket", place).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(_version_path(os.path.join(root, "rows"), version))
    now = placed | {bucket: version for bucket in touched}
    rows = [(bucket, held) for bucket, held in sorted(now.items())]
    write_snapshot(spark.createDataFrame(rows, "bucket int, held bigint"), os.path.join(root, "pointer"), version)
    _drop_unnamed(spark, root, version, [set(placed.items()), set(now.items())])
    return touched


def _drop_unnamed(spark: SparkSession, root: str, version: int, named: list[set[tuple[int, int]]]) -> None:
    """Remove bucket folders of versions up to this one that none of the pointers names."""
    keep = set().union(*named)
    path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(root, "rows"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    for folder in fs.listStatus(path):
        held = int(folder.getPath().getName().split("=")[1])
        for part in fs.listStatus(folder.getPath()) if held <= version else []:
            name = part.getPath().getName()
            if name.startswith("bucket=") and (int(name.split("=")[1]), held) not in keep:
                fs.delete(part.getPath(), True)


# ------------------------------------------------------------- schema by name


def column_changes(held: Sequence[str], target: Sequence[str]) -> dict[str, str]:
    """What a migration by name does: each column it fills anew, then each it drops.

    Empty where only order or outer blanks of the names differ.
    """
    names = dict.fromkeys(filter(None, map(str.strip, held)))
    fresh = {name: "added" for name in target if name not in names}
    return fresh | {name: "removed" for name in names if name not in target}


def migrate(df: DataFrame, target: list[str]) -> DataFrame:
    """Rows under the target columns: matched by name, missing or NULL becomes ''."""
    by_name = {name.strip(): name for name in df.columns}

    def pick(name: str) -> Column:
        if name not in by_name:
            return F.lit("").alias(name)
        return F.coalesce(c(f"`{by_name[name]}`").cast("string"), F.lit("")).alias(name)

    return df.select(*[pick(t) for t in target])


def append_rows(df: DataFrame, register: str, path: str) -> None:
    migrate(df, V.REGISTER_COLUMNS[register]).write.mode("append").parquet(path)


def read_register(spark: SparkSession, register: str, path: str, fmt: str = "parquet") -> DataFrame:
    """A register as text columns, NULL read as ''."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return migrate(reader.format(fmt).load(path), V.REGISTER_COLUMNS[register])


# ------------------------------------------------------------- exports


def published_feed(articles: DataFrame, limit: int = 60) -> DataFrame:
    """Newest first by arrival; filtered and off-topic rows are not published."""
    return (
        articles.filter(F.coalesce(c("status"), F.lit("")) != "Filtered")
        .filter(~S.is_off_topic(c("title"), c("summary")))
        .orderBy(c("seq").desc())
        .limit(limit)
    )


def on_topic(rows: DataFrame, *names: str) -> DataFrame:
    """Entity rows none of whose names is sport or entertainment."""
    out = rows
    for name in names:
        out = out.filter(~S.is_off_topic(c(name)))
    return out


def legacy_content(reports: DataFrame) -> DataFrame:
    """Report text kept under an unnamed legacy column moves to ``content``."""
    return reports.withColumn("content", F.coalesce(T.non_empty(c("content")), c("legacy"), F.lit(""))).drop("legacy")


def guarded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[T.csv_guard(c(n)).alias(n) for n in columns])


def has_seed_rows(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.bool_or(F.lower(c("source")) == "seed"), F.lit(False)).alias("is_demo"))


def mark_demo(records: DataFrame) -> DataFrame:
    """Every exported row says whether the export contains seeded rows."""
    return records.withColumn("export_is_demo", has_seed_rows(records).scalar())


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    guarded(df, columns).write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"').option("lineSep", "\r\n").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


_RUN = re.compile(r"^report_(\d{8}_\d{6})$")


def archive_report(lines: DataFrame, root: str, run_ts: str) -> str:
    """One folder per run, named by its timestamp; earlier runs are never overwritten."""
    name = f"report_{run_ts}"
    if not _RUN.match(name):
        raise ValueError("run_ts must look like 20240104_101500")
    path = os.path.join(root, f"run={run_ts}")
    lines.write.mode("overwrite").parquet(path)
    return path


def latest_archive(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest run, found by partition value."""
    runs = spark.read.parquet(root)
    return runs.filter(c("run") == runs.agg(F.max("run")).scalar())


def empty_run_record(candidates: DataFrame, store: DataFrame, as_of: str, key: str = "url") -> DataFrame:
    """A report row for a run with nothing to do: no row when there is new work."""
    fetched = candidates.agg(F.count(F.lit(1))).scalar()
    fresh = candidates.join(store.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1))).scalar()
    message = F.when(fetched == 0, "No articles were fetched this cycle.").otherwise("No significant change.")
    return candidates.sparkSession.range(1).select(
        F.lit(as_of).alias("date"), F.lit(0).alias("total_articles"), F.lit(0).alias("high_risk"),
        F.lit(0).alias("appointments"), F.lit(0).alias("procurement"), message.alias("generated"),
        fresh.alias("_new"),
    ).filter("_new = 0").drop("_new")
