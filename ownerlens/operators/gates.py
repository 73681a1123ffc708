"""Feed gates and article projections.

Every gate is a narrow filter or projection: no shuffle, so Spark fuses a
chain of them into one stage and pushes what it can into the scan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ownerlens import vocab as V
from ownerlens.functions import scoring as S, text as T

c = F.col


def as_ntz(value) -> Column:
    """A point in time given as text or as a Column."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp_ntz")


def drop_stubs(articles: DataFrame) -> DataFrame:
    return articles.filter(~T.is_navigation_stub(c("title"), c("source")))


def keep_country(articles: DataFrame) -> DataFrame:
    return articles.filter(S.mentions_country(c("url"), c("title"), c("raw_text")))


def keep_fresh(articles: DataFrame, as_of, hours: int = V.FRESHNESS_HOURS) -> DataFrame:
    """Rows published within the window; undated rows are not in it."""
    return articles.filter(c("published_at") >= as_ntz(as_of) - F.make_dt_interval(hours=F.lit(hours)))


def undated(articles: DataFrame) -> DataFrame:
    return articles.filter(c("published_at").isNull())


def relevance_gate(articles: DataFrame) -> DataFrame:
    """Irrelevant or off-topic rows stay in the store, marked and at zero risk."""
    out = ~F.coalesce(c("relevant"), F.lit(False)) | S.is_off_topic(c("title"), c("summary"))
    return (
        articles.withColumn("_out", out)
        .withColumn("status", F.when(c("_out"), "Filtered").otherwise("Unread"))
        .withColumn("category", F.when(c("_out"), "Non-Relevant").otherwise(F.coalesce(c("category"), F.lit("Other"))))
        .withColumn("risk_score", F.when(c("_out"), 0).otherwise(c("risk_score")))
        .drop("_out")
    )


def keep_english(rows: DataFrame, text: Column, seeded: Column | None = None) -> DataFrame:
    keep = S.detect_language(text) == "en"
    return rows.filter(keep if seeded is None else keep | seeded)


def is_violent(text: Column) -> Column:
    return T.has_any(F.lower(text), V.VIOLENCE_STEMS)


def news_listing(articles: DataFrame, high: int = 50) -> DataFrame:
    level = F.when(F.coalesce(c("risk_score"), F.lit(0)) >= high, "High").otherwise("Low")
    return articles.select(
        c("seq").alias("id"), "title", "source", "url", "category", "risk_score",
        level.alias("risk_level"), "summary",
    )


def normalise_articles(articles: DataFrame) -> DataFrame:
    """Defaults for missing article fields, and the level derived from the score."""
    score = F.coalesce(c("risk_score"), F.lit(10))
    have = set(articles.columns)

    def pick(name: str, default: str) -> Column:
        return F.coalesce(T.non_empty(c(name)), F.lit(default)) if name in have else F.lit(default)

    level = T.non_empty(c("risk_level")) if "risk_level" in have else F.lit(None).cast("string")
    return articles.select(
        "seq", c("title"), pick("source", "Unknown").alias("source"), pick("url", "#").alias("url"),
        pick("category", "Other").alias("category"), score.alias("risk_score"),
        F.coalesce(level, S.risk_bucket(score)).alias("risk_level"), pick("sentiment", "Neutral").alias("sentiment"),
        F.coalesce(T.non_empty(T.clean_summary(F.coalesce(T.non_empty(c("summary")), c("title")))),
                   F.lit("No summary available.")).alias("summary"),
        pick("engine", "").alias("engine"), "published_at",
    )


def feed_alerts(articles: DataFrame, elevated: int = 50, critical: int = 75) -> DataFrame:
    """Alert rows for elevated scores."""
    return articles.filter(F.coalesce(c("risk_score"), F.lit(0)) >= elevated).select(
        "seq", F.concat(F.lit("Risk Alert: "), c("title")).alias("title"),
        F.when(c("risk_score") >= critical, "Critical").otherwise("Warning").alias("severity"),
        "risk_score", "published_at",
    )


def feed_filter(articles: DataFrame, category: str = "", risk: str = "", text: str = "") -> DataFrame:
    out = articles
    if category:
        out = out.filter(F.lower(F.coalesce(c("category"), F.lit(""))) == category.lower())
    if risk:
        out = out.filter(F.lower(c("risk_level")) == risk.lower())
    if text:
        needle = F.lit(text.lower())
        out = out.filter(F.contains(F.lower(c("title")), needle) | F.contains(F.lower(c("summary")), needle))
    return out


def funnel(articles: DataFrame, as_of, distinct: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    """How many rows survive each gate, in one pass over the articles.

    ``distinct`` holds the distinct stories among the fresh ones, where these were looked for;
    ``flags`` the articles' ``gate_flags``, where these are written already.
    """
    flags = gate_flags(articles, as_of) if flags is None else flags
    counts = flags.agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(~c("live")).alias("stubs"),
        F.count_if(c("local")).alias("country"), F.count_if(c("local") & ~c("dated")).alias("undated"),
        F.count_if(c("fresh")).alias("fresh"),
    )
    if distinct is None:
        return counts
    return counts.withColumn("distinct_stories", distinct.agg(F.count(F.lit(1))).scalar())


def gate_flags(articles: DataFrame, as_of) -> DataFrame:
    """``(seq, live, local, dated, fresh)``: which gates each article passes, each after the one before."""
    live = ~T.is_navigation_stub(c("title"), c("source"))
    local = live & S.mentions_country(c("url"), c("title"), c("raw_text"))
    dated = local & c("published_at").isNotNull()
    fresh = dated & (c("published_at") >= as_ntz(as_of) - F.make_dt_interval(hours=F.lit(V.FRESHNESS_HOURS)))
    return articles.select("seq", live.alias("live"), local.alias("local"), dated.alias("dated"), F.coalesce(fresh, F.lit(False)).alias("fresh"))
