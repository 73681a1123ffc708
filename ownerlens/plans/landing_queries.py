"""Sources, sinks and streams over files landed from the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ownerlens import schemas
from ownerlens.functions import scoring as S
from ownerlens.operators import registers as R
from ownerlens.plans import sqltext as Q
from ownerlens.plans.feed_queries import _MENTIONS, mentions
from ownerlens.plans.psc_queries import PSC_FIRST_SQL
from ownerlens.plans.registry import query
from ownerlens.plans.text_queries import FEED_DATE_SQL, STAMP_SQL, stamp
from ownerlens.session import scratch_path
from ownerlens.sources import feeds, jsonl
from ownerlens.streaming import feed

c = F.col
_URL = "concat('https://src', CAST(doc_id % 7 AS STRING), '.example/', CAST(doc_id AS STRING))"
_TITLE = "concat('R&amp;D at A & B ', CAST(doc_id AS STRING))"


def rss_bodies(t):
    """One RSS response per pair of documents, holding both, with a repeated first item."""
    k = c("doc_id")
    item = F.struct(
        F.expr(_TITLE).alias("title"), F.expr(_URL).alias("link"),
        F.when(k % 5 != 0, "Mon, 01 Jan 2024 10:00:00 GMT").alias("pubDate"),
        F.when(k % 3 != 0, F.concat(F.lit("<b>x</b> &quot;"), F.translate("text", "\n", " "))).alias("description"),
        F.when(k % 4 != 0, F.struct(c("source").alias("_VALUE"), F.lit("https://p.example").alias("_url"))).alias("source"))
    xml = F.to_xml(item, {"rowTag": "item"})
    body = F.concat(F.lit("<rss><channel><title>feed</title>"), xml, xml, F.lit("</channel></rss>"))
    return t.documents.select(k.alias("feed"), body.alias("body"))


@query("src01_rss_items", f"""SELECT {_URL} AS url, replace({_TITLE}, '&amp;', '&') AS title, CASE WHEN doc_id % 4 <> 0 THEN source ELSE 'Google News' END AS source,
  CASE WHEN doc_id % 5 <> 0 THEN 'Mon, 01 Jan 2024 10:00:00 GMT' ELSE '' END AS published_at_raw,
  trim(CASE WHEN doc_id % 3 <> 0 THEN concat('<b>x</b> "', replace(text, chr(10), ' ')) ELSE replace({_TITLE}, '&amp;', '&') END) AS raw_text FROM documents""")
def src01(t):
    return feeds.articles_from_feeds(rss_bodies(t)).select("url", "title", "source", "published_at_raw", F.trim("raw_text").alias("raw_text"))


_PAYLOAD_ROWS = {
    "newsapi": lambda k: F.struct(F.array(F.struct(
        F.expr(_TITLE).alias("title"), F.expr(_URL).alias("url"), F.struct(F.when(k % 4 != 0, c("source")).alias("name")).alias("source"),
        F.lit("2024-01-01T10:00:00Z").alias("publishedAt"), F.when(k % 3 == 0, "").otherwise(c("text")).alias("content"),
        F.when(k % 6 != 0, "summary").alias("description"))).alias("articles")),
    "guardian": lambda k: F.struct(F.struct(F.array(F.struct(
        F.expr(_TITLE).alias("webTitle"), F.expr(_URL).alias("webUrl"), F.lit("2024-01-01T10:00:00Z").alias("webPublicationDate"),
        F.struct(F.when(k % 3 != 0, c("text")).alias("bodyText")).alias("fields"))).alias("results")).alias("response")),
    "newsdata": lambda k: F.struct(F.array(F.struct(
        F.expr(_TITLE).alias("title"), F.expr(_URL).alias("link"), F.when(k % 4 != 0, c("source")).alias("source_id"),
        F.lit("2024-01-01 10:00:00").alias("pubDate"), F.when(k % 3 == 0, "").otherwise(c("text")).alias("content"),
        F.when(k % 6 != 0, "summary").alias("description"))).alias("results")),
}
_PAYLOAD_ROWS["gnews"] = _PAYLOAD_ROWS["newsapi"]
_DESC = "CASE WHEN doc_id % 6 <> 0 THEN 'summary' ELSE {} END"
_PAYLOAD_SQL = {
    "newsapi": ("CASE WHEN doc_id % 4 <> 0 THEN source ELSE 'NewsAPI' END", f"CASE WHEN doc_id % 3 <> 0 THEN text ELSE {_DESC.format(Q.lit(''))} END"),
    "gnews": ("CASE WHEN doc_id % 4 <> 0 THEN source ELSE 'GNews' END", f"CASE WHEN doc_id % 3 <> 0 THEN text ELSE {_DESC.format(Q.lit(''))} END"),
    "guardian": ("'The Guardian'", f"CASE WHEN doc_id % 3 <> 0 THEN text ELSE {_TITLE} END"),
    "newsdata": ("CASE WHEN doc_id % 4 <> 0 THEN source ELSE 'NewsData' END", f"CASE WHEN doc_id % 3 <> 0 THEN text ELSE {_DESC.format(_TITLE)} END"),
}

for _name, _provider in {"src02_newsapi": "newsapi", "src03_gnews": "gnews", "src04_guardian": "guardian", "src05_newsdata": "newsdata"}.items():
    _src, _txt = _PAYLOAD_SQL[_provider]

    @query(_name, f"SELECT {_URL} AS url, {_TITLE} AS title, {_src} AS source, {_txt} AS raw_text, FALSE AS is_rss FROM documents")
    def _payload_query(t, provider=_provider):
        path = scratch_path(t.spark, provider)
        t.documents.select(F.to_json(_PAYLOAD_ROWS[provider](c("doc_id"))).alias("value")).write.text(path)
        rows = t.spark.read.schema(feeds.PAYLOADS[provider]["schema"]).json(path)
        return feeds.articles_from_payloads(rows, provider).select("url", "title", "source", "raw_text", "is_rss")


@query("src08_jsonl", """SELECT count(*) FILTER (doc_id % 11 <> 3) AS valid, count(*) FILTER (doc_id % 11 = 3) AS invalid, CAST(count(*) * 3 AS BIGINT) AS max_line,
  CAST(sum(CASE WHEN doc_id % 11 <> 3 THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM documents""")
def src08(t):
    """A file with comments, blank lines and broken lines between the records."""
    path = scratch_path(t.spark, "corpus")
    record = F.to_json(F.struct(c("text").alias("article_text"), F.lit("t").alias("title")))
    line = F.when(c("doc_id") % 11 == 3, '{"title": ').otherwise(record)
    body = F.concat(F.lit("// note\n"), line, F.lit("\n  "))
    t.documents.select(body.alias("value")).write.text(path)
    rows = jsonl.read_jsonl(t.spark, path, schemas.CORPUS)
    lines = jsonl.numbered_lines(t.spark, path)
    per_file = lines.groupBy("file").agg(F.max("line_no").alias("m")).agg(F.sum("m")).scalar()
    return rows.agg(
        F.count_if("valid").alias("valid"), F.count_if(~c("valid")).alias("invalid"), per_file.alias("max_line"),
        F.sum(F.when(c("valid"), F.length("record.article_text"))).alias("chars"))


@query("snk01_append_rows", """SELECT agency, contractor, CAST(CAST(floor(amount) AS BIGINT) AS STRING) AS amount, '' AS project, '' AS source FROM procurement_v UNION ALL
  SELECT agency, contractor, '' , '', '' FROM procurement_v""")
def snk01(t):
    path = scratch_path(t.spark, "procurement")
    R.append_rows(t.procurement_v.withColumn("amount", c("amount").cast("bigint")), "procurement", path)
    R.append_rows(t.procurement_v.select("contractor", "agency", "seq"), "procurement", path)
    return R.read_register(t.spark, "procurement", path)


@query("snk08_report_archive", "SELECT '20240104_140000' AS run, count(*) AS lines FROM psc_v")
def snk08(t):
    root = scratch_path(t.spark, "archive")
    lines = t.psc_v.select(F.lit(1).alias("section"), c("seq").alias("item"), F.lit(0).alias("part"), c("person_name").alias("line"))
    R.archive_report(lines.filter("item % 2 = 0"), root, "20240104_100000")
    R.archive_report(lines, root, "20240104_140000")
    return R.latest_archive(t.spark, root).groupBy(c("run").cast("string").alias("run")).agg(F.count(F.lit(1)).alias("lines"))


# ------------------------------------------------------------------ streams


def land_articles(t):
    """Documents landed as raw JSON articles, some undated."""
    path = scratch_path(t.spark, "landed")
    t.dates_v.select(
        F.concat(F.lit("Title "), c("seq").cast("string")).alias("title"),
        F.concat(F.lit("https://a.example/"), (c("seq") - c("seq") % 3).cast("string")).alias("url"), F.lit("feed").alias("source"),
        c("published").alias("published_at_raw"), F.lit("text").alias("raw_text"), F.lit(True).alias("is_rss")).write.json(path)
    return path


def _stream_table(t, stream, name):
    path = scratch_path(t.spark, name)
    feed.run_available(stream, path, scratch_path(t.spark, name + "-state"))
    return t.spark.read.schema(stream.schema).parquet(path)


@query("st01_continuous_ingest", f"SELECT concat('Title ', CAST(seq AS STRING)) AS title, {STAMP_SQL.format(FEED_DATE_SQL)} AS published_at FROM dates_v")
def st01(t):
    rows = _stream_table(t, feed.landed_articles(t.spark, land_articles(t)), "ingest")
    return rows.select("title", stamp(c("published_at")).alias("published_at"))


@query("st02_url_dedup", f"SELECT DISTINCT concat('https://a.example/', CAST(seq - seq % 3 AS STRING)) AS url FROM dates_v WHERE {FEED_DATE_SQL} IS NOT NULL")
def st02(t):
    return _stream_table(t, feed.distinct_urls(feed.landed_articles(t.spark, land_articles(t))), "distinct").select("url")


@query("st03_undated_quarantine", f"SELECT CASE WHEN {FEED_DATE_SQL} IS NULL THEN 'undated' ELSE 'dated' END AS kind, count(*) AS n FROM dates_v GROUP BY 1")
def st03(t):
    path = scratch_path(t.spark, "routed")
    feed.route_dated(feed.landed_articles(t.spark, land_articles(t)), path, scratch_path(t.spark, "route-state"))
    return t.spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("st04_edition_windows", """WITH t AS (SELECT ts, ts - INTERVAL 2 HOURS AS s FROM events),
 four AS (SELECT time_bucket(INTERVAL 4 HOURS, s, TIMESTAMP '2000-01-01') + INTERVAL 2 HOURS AS w FROM t)
 SELECT 'edition' AS kind, strftime(w, '%Y-%m-%d %H:%M:%S') AS starts, count(*) AS n FROM four GROUP BY 1, 2
 UNION ALL SELECT 'look back', strftime(w - k * INTERVAL 4 HOURS, '%Y-%m-%d %H:%M:%S'), count(*) FROM four, (SELECT unnest(range(6)) AS k) r GROUP BY 1, 2""")
def st04(t):
    rows = t.events.select("ts")

    def show(kind, spec):
        return feed.windowed_counts(rows, "ts", spec).select(F.lit(kind).alias("kind"), stamp(c("w.start")).alias("starts"), "n")

    return show("edition", feed.EDITION).unionAll(show("look back", feed.LOOK_BACK))


_LATE = "event_id % 10 = 0"


@query("st04_stream_windows", f"""WITH t AS (SELECT ts, {_LATE} AS late, time_bucket(INTERVAL 4 HOURS, ts - INTERVAL 2 HOURS, TIMESTAMP '2000-01-01') + INTERVAL 6 HOURS AS e FROM events),
 m AS (SELECT max(ts) FILTER (NOT late) - INTERVAL 4 HOURS AS one, max(ts) - INTERVAL 4 HOURS AS two FROM t)
 SELECT strftime(e - INTERVAL 4 HOURS, '%Y-%m-%d %H:%M:%S') AS starts, count(*) AS n FROM t, m WHERE e <= two AND (NOT late OR e > one) GROUP BY 1""")
def st04_stream(t):
    """Editions told by a stream: nine tenths of the events land first, the rest when the watermark has passed most of them."""
    landing, told, state = (scratch_path(t.spark, n) for n in ("events", "editions", "edition-state"))
    rows = t.events.select(c("ts").cast("timestamp").alias("ts"), "event_id")
    stream = None
    for part in (f"NOT {_LATE}", _LATE):
        rows.filter(part).write.mode("append").parquet(landing)
        stream = feed.windowed_counts(t.spark.readStream.schema(rows.schema).parquet(landing), "ts", feed.EDITION, "4 hours")
        feed.run_available(stream, told, state)
    return t.spark.read.schema(stream.schema).parquet(told).select(stamp(c("w.start")).alias("starts"), "n")


@query("st05_register_upsert", f"""WITH {_MENTIONS} SELECT arg_min(trim(company), seq) AS company, count(*) AS mention_count,
   coalesce(arg_max(industry, seq) FILTER (industry IS NOT NULL), 'General') AS industry, coalesce(arg_max(risk_level, seq) FILTER (risk_level IS NOT NULL), 'Low') AS risk_level
   FROM mentions_v WHERE trim(company) <> '' GROUP BY lower(trim(company))""")
def st05(t):
    """Two landings, two runs of the same stream: each merges into the last version."""
    landing, root, state = (scratch_path(t.spark, n) for n in ("mentions", "companies", "upsert-state"))
    rows = mentions(t)
    for part in ("seq < 10000", "seq >= 10000"):
        rows.filter(part).write.mode("append").parquet(landing)
        feed.upsert_companies(t.spark.readStream.schema(rows.schema).parquet(landing), root, state)
    return R.read_buckets(t.spark, root).select("company", "mention_count", "industry", "risk_level")


@query("st05_holdings_upsert", PSC_FIRST_SQL)
def st05_holdings(t):
    """Disclosures in three landings, the last one a copy of the first."""
    landing, root, state = (scratch_path(t.spark, n) for n in ("disclosures", "holdings", "holding-state"))
    rows = t.psc_v
    for part in ("seq % 2 = 0", "seq % 2 = 1", "seq % 2 = 0"):
        rows.filter(part).write.mode("append").parquet(landing)
        feed.upsert_holdings(t.spark.readStream.schema(rows.schema).parquet(landing), root, state)
    return R.read_buckets(t.spark, root).select("seq")


@query("st06_alert_stream", f"""SELECT seq, CASE WHEN risk_score >= 75 THEN 'Critical' WHEN risk_score >= 50 THEN 'Warning' ELSE 'Info' END AS severity FROM articles_v WHERE risk_score >= 50 OR seq % 50 = 0""")
def st06(t):
    path = scratch_path(t.spark, "scored")
    rows = t.articles_v.select("seq", S.risk_bucket(c("risk_score")).alias("risk_level"), F.when(c("seq") % 50 == 0, 80.0).otherwise(10.0).alias("importance"))
    rows.write.parquet(path)
    stream = feed.alert_stream(t.spark.readStream.schema(rows.schema).parquet(path))
    return _stream_table(t, stream, "alerts").select("seq", "severity")
