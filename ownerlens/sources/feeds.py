"""Landed feed payloads as one article table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ownerlens.functions import text as T
from ownerlens.functions.dates import parse_feed_date
from ownerlens.operators.keys import first_per_key

c = F.col

# How each JSON payload names things: where its items are, and per article field
# the candidate paths (first non-empty wins) with a default.
PAYLOADS = {
    "newsapi": {
        "schema": "articles array<struct<title:string,url:string,source:struct<name:string>,publishedAt:string,content:string,description:string>>",
        "items": "articles",
        "fields": {"title": ["title"], "url": ["url"], "source": ["source.name"], "published_at_raw": ["publishedAt"],
                   "raw_text": ["content", "description"]},
        "defaults": {"source": "NewsAPI", "raw_text": ""},
    },
    "gnews": {
        "schema": "articles array<struct<title:string,url:string,source:struct<name:string>,publishedAt:string,content:string,description:string>>",
        "items": "articles",
        "fields": {"title": ["title"], "url": ["url"], "source": ["source.name"], "published_at_raw": ["publishedAt"],
                   "raw_text": ["content", "description"]},
        "defaults": {"source": "GNews", "raw_text": ""},
    },
    "guardian": {
        "schema": "response struct<results:array<struct<webTitle:string,webUrl:string,webPublicationDate:string,fields:struct<bodyText:string>>>>",
        "items": "response.results",
        "fields": {"title": ["webTitle"], "url": ["webUrl"], "source": [], "published_at_raw": ["webPublicationDate"],
                   "raw_text": ["fields.bodyText", "webTitle"]},
        "defaults": {"source": "The Guardian"},
    },
    "newsdata": {
        "schema": "results array<struct<title:string,link:string,source_id:string,pubDate:string,content:string,description:string>>",
        "items": "results",
        "fields": {"title": ["title"], "url": ["link"], "source": ["source_id"], "published_at_raw": ["pubDate"],
                   "raw_text": ["content", "description", "title"]},
        "defaults": {"source": "NewsData"},
    },
}


def _field(paths: Sequence[str], default: str | None) -> Column:
    options = [T.non_empty(c(f"item.{p}")) for p in paths]
    if default is not None:
        options.append(F.lit(default))
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def articles_from_payloads(payloads: DataFrame, provider: str) -> DataFrame:
    """One article per item of every payload row."""
    spec = PAYLOADS[provider]
    items = payloads.select(F.posexplode(c(spec["items"])).alias("pos", "item"))
    fields = [_field(paths, spec["defaults"].get(name)).alias(name) for name, paths in spec["fields"].items()]
    return items.select("pos", *fields, F.lit(False).alias("is_rss"))


def read_payloads(spark: SparkSession, path: str, provider: str) -> DataFrame:
    rows = spark.read.schema(PAYLOADS[provider]["schema"]).option("multiLine", True).json(path)
    return articles_from_payloads(rows, provider)


def articles_from_items(items: DataFrame, order: str = "seq") -> DataFrame:
    """RSS items: decoded text, summary falls back to the title, one row per URL."""
    title = F.coalesce(T.decode_entities(c("title")), F.lit(""))
    rows = items.select(
        order, title.alias("title"), c("link").alias("url"),
        F.coalesce(c("source"), F.lit("Google News")).alias("source"),
        F.coalesce(c("pubDate"), F.lit("")).alias("published_at_raw"),
        F.coalesce(T.decode_entities(T.non_empty(c("description"))), title).alias("raw_text"),
        F.lit(True).alias("is_rss"),
    )
    return first_per_key(rows, ["url"], (order,))


RSS_SCHEMA = (
    "channel struct<item:array<struct<title:string,link:string,pubDate:string,description:string,"
    "source:struct<_VALUE:string,_url:string>>>>"
)


def articles_from_feeds(bodies: DataFrame) -> DataFrame:
    """Articles of fetched RSS documents ``(feed, body)``: one row per response.

    Arrival order is the feed, then the position in it.
    """
    parsed = bodies.select("feed", F.from_xml("body", RSS_SCHEMA).alias("rss"))
    items = parsed.select("feed", F.posexplode("rss.channel.item").alias("pos", "item")).select(
        F.struct("feed", "pos").alias("arrival"), "item.title", "item.link", "item.pubDate", "item.description",
        c("item.source._VALUE").alias("source"))
    return articles_from_items(items, "arrival")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Landed RSS files, one fetched response each; a response is small, so it is read whole."""
    files = spark.read.option("wholetext", True).text(path)
    return articles_from_feeds(files.select(c("_metadata.file_path").alias("feed"), c("value").alias("body")))


def combine(parts: Sequence[DataFrame], pos: str = "pos") -> DataFrame:
    """All sources under one schema.  ``source_rank`` and the position within the
    source give the arrival order; no global counter is drawn."""
    out = None
    for rank, part in enumerate(parts):
        ranked = part.withColumn("source_rank", F.lit(rank)).withColumn("arrival_pos", c(pos))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out


def dated(articles: DataFrame) -> DataFrame:
    return articles.withColumn("published_at", parse_feed_date(c("published_at_raw")))
