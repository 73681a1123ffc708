"""Counts and rankings over articles, alerts and reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ownerlens import vocab as V
from ownerlens.functions import scoring as S, text as T
from ownerlens.operators.keys import first_per_key, top_per_key, zero_filled

c = F.col


def dashboard_totals(articles: DataFrame, companies: DataFrame, elevated: int = 50,
                     event_categories: tuple[str, ...] = ("Government",)) -> DataFrame:
    return articles.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_if(c("category").isin(*event_categories)).alias("total_events"),
        F.count_if(F.coalesce(c("risk_score"), F.lit(0)) >= elevated).alias("total_alerts"),
    ).withColumn("total_entities", companies.agg(F.count(F.lit(1))).scalar())


def risk_counts(articles: DataFrame) -> DataFrame:
    counts = articles.groupBy(S.risk_bucket(c("risk_score")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, "level", V.RISK_LEVELS)


def category_counts(articles: DataFrame, missing: str = "Other") -> DataFrame:
    return articles.groupBy(F.coalesce(T.non_empty(c("category")), F.lit(missing)).alias("category")).agg(
        F.count(F.lit(1)).alias("n"))


def dedupe_by_title(articles: DataFrame) -> DataFrame:
    """Per title key the highest-risk copy (first of equals), at the place the key was first seen."""
    keyed = articles.withColumn("_key", T.title_key(c("title"))).filter(c("_key") != "")
    risk = F.coalesce(c("risk_score"), F.lit(0))
    best = top_per_key(keyed, ["_key"], [risk.desc(), c("seq")], 1)
    seen = keyed.groupBy("_key").agg(F.min("seq").alias("first_seq"))
    return best.join(seen, "_key").drop("_key")


def run_counts(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c("risk_level").isin("High", "Critical")).alias("high_risk"),
        F.count_if(c("event_type") == "Appointment").alias("appointments"),
        F.count_if((c("event_type") == "Procurement") | F.coalesce(c("has_procurement"), F.lit(False))).alias("procurement"),
    )


def newest_first(articles: DataFrame) -> DataFrame:
    return articles.orderBy(c("seq").desc())


def latest_alerts(articles: DataFrame, limit: int = 10, elevated: int = 50, critical: int = 75) -> DataFrame:
    return (
        articles.filter(F.coalesce(c("risk_score"), F.lit(0)) >= elevated)
        .orderBy(c("seq").desc())
        .limit(limit)
        .select("seq", F.concat(F.lit("Risk Alert: "), c("title")).alias("title"),
                F.when(c("risk_score") >= critical, "Critical").otherwise("Warning").alias("severity"))
    )


def ranked_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy((F.lower("severity") == "critical").desc(), c("risk_score").desc(), "seq")


def alert_counters(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.lower("severity") == "critical").alias("critical"), F.count(F.lit(1)).alias("elevated"))


def by_risk(articles: DataFrame) -> DataFrame:
    return articles.orderBy(F.coalesce(c("risk_score"), F.lit(0)).desc(), "seq")


def report_window(articles: DataFrame, as_of: Column, hours: int = 24, fewest: int = 5, fallback: int = 25) -> DataFrame:
    """Articles of the last day, or the latest few when the day has too few.

    The count that decides is a scalar subquery; the fallback branch is a
    top-k, so neither branch sorts the table.
    """
    recent = articles.filter(c("published_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    n = recent.agg(F.count(F.lit(1)))
    latest = articles.orderBy(c("published_at").desc_nulls_last(), "seq").limit(fallback)
    return recent.filter(n.scalar() >= fewest).unionByName(latest.filter(n.scalar() < fewest))


def latest_report(reports: DataFrame) -> DataFrame:
    return reports.orderBy(c("seq").desc()).limit(1)


def report_of_date(reports: DataFrame) -> DataFrame:
    """The first report of every date."""
    return first_per_key(reports, ["date"])


def editions(reports: DataFrame) -> DataFrame:
    """Selectable editions: only those whose text is held, newest first."""
    return (
        reports.filter(T.strip(F.coalesce(c("content"), F.lit(""))) != "")
        .select(
            "seq",
            F.concat(F.lit("report_"), F.replace(F.coalesce(c("date"), F.lit("")), F.lit("-"), F.lit("")), F.lit(".md")).alias("filename"),
            F.concat_ws(" ", c("date"), F.element_at(F.split(F.coalesce(c("generated"), F.lit("12:00")), " "), -1)).alias("created_at"),
            "content",
        )
        .orderBy(c("created_at").desc(), "seq")
    )


def sampled(inputs: DataFrame, key: str, one_in: int = 10) -> DataFrame:
    """A repeatable one-in-N sample keyed on content, not on a random draw."""
    if one_in <= 0:
        return inputs.limit(0)
    bucket = F.conv(F.left(F.md5(c(key)), F.lit(8)), 16, 10).cast("bigint") % one_in
    return inputs.filter(bucket == 0)
