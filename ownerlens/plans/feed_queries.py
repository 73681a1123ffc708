"""Feed, register, count and export operators as registered queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ownerlens import vocab as V
from ownerlens.functions import scoring as S
from ownerlens.operators import dedup, gates, registers as R, stats
from ownerlens.operators.keys import first_per_key, known_anti_join, new_by_key, top_per_key
from ownerlens.plans import sqltext as Q
from ownerlens.plans.greedy import WORD_CLOSE, WORD_ITEMS, greedy_sql
from ownerlens.plans.registry import query
from ownerlens.session import materialise
from ownerlens.plans.text_queries import AS_OF, COUNTRY_SQL, STAMP_SQL, TITLE_KEY_SQL, _SUFFIX_V, _with_suffix, stamp

c = F.col


def store(t):
    """Articles an earlier run has stored."""
    return t.articles_v.filter((c("seq") - c("seq") % 2) % 3 == 0)


_STORE = "store_v AS (SELECT * FROM articles_v WHERE (seq - seq % 2) % 3 = 0)"
_NEW = """new_v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM articles_v) x
  WHERE rn = 1 AND url NOT IN (SELECT url FROM store_v))"""


@query("jn01_new_urls", f"WITH {_STORE}, {_NEW} SELECT seq, url FROM new_v")
def jn01(t):
    return new_by_key(t.articles_v, store(t), "url").select("seq", "url")


@query("set02_except_known", f"WITH {_STORE} SELECT seq, url FROM articles_v WHERE url NOT IN (SELECT url FROM store_v)")
def set02(t):
    return known_anti_join(t.articles_v, store(t), "url").select("seq", "url")


@query("win01_article_ids", f"""WITH {_STORE}, {_NEW} SELECT url, (SELECT max(seq) FROM store_v) + row_number() OVER (ORDER BY seq) AS id FROM new_v""")
def win01(t):
    stored = store(t).withColumn("id", F.concat(c("seq").cast("string"), F.lit(".0")))
    return R.add_articles(t.articles_v, stored).select("url", "id")


@query("win02_first_per_key", "SELECT url, min(seq) AS seq FROM articles_v GROUP BY url")
def win02(t):
    return first_per_key(t.articles_v, ["url"]).select("url", "seq")


@query("win03_newest_first", "SELECT seq, title FROM articles_v")
def win03(t):
    return stats.newest_first(t.articles_v).select("seq", "title")


@query("win04_latest_alerts", """SELECT seq, concat('Risk Alert: ', title) AS title, CASE WHEN risk_score >= 75 THEN 'Critical' ELSE 'Warning' END AS severity
  FROM articles_v WHERE risk_score >= 50 ORDER BY seq DESC LIMIT 10""")
def win04(t):
    return stats.latest_alerts(t.articles_v)


@query("win05_alert_ranking", """SELECT seq, risk_score, CASE WHEN risk_score >= 75 THEN 'Critical' ELSE 'Warning' END AS severity
  FROM articles_v WHERE risk_score >= 50 ORDER BY risk_score >= 75 DESC, risk_score DESC, seq""")
def win05(t):
    return stats.ranked_alerts(gates.feed_alerts(t.articles_v)).select("seq", "risk_score", "severity")


@query("win07_feed_by_risk", "SELECT seq, risk_score FROM articles_v ORDER BY risk_score DESC, seq")
def win07(t):
    return stats.by_risk(t.articles_v).select("seq", "risk_score")


_WINDOW = """ (SELECT count(*) FROM articles_v WHERE published_at >= {ts} - INTERVAL 24 HOURS) """


def _window_sql(ts):
    n = _WINDOW.format(ts=ts)
    return f"""SELECT * FROM articles_v WHERE {n} >= 5 AND published_at >= {ts} - INTERVAL 24 HOURS
 UNION ALL SELECT * FROM (SELECT * FROM articles_v WHERE {n} < 5 ORDER BY published_at DESC, seq LIMIT 25) l"""


_MAX_TS = "(SELECT max(published_at) FROM articles_v)"
REPORT_WINDOW_SQL = _window_sql(_MAX_TS)


def report_articles(t):
    """Articles of the day before the newest article.

    Their ids are found first, without texts; only their documents are joined whole.
    """
    heads = t.headlines()
    last = heads.agg(F.max("published_at")).scalar()
    ids = materialise(stats.report_window(heads, last).select(c("seq").alias("doc_id")).distinct(), "window")
    # An id may have rows outside the window, so the window is cut again.
    return stats.report_window(t.view("articles_v", documents=t.documents.join(ids, "doc_id", "left_semi")), last)


@query("win08_report_window", f"""WITH w AS ({REPORT_WINDOW_SQL}), late AS ({_window_sql(f"({_MAX_TS} + INTERVAL 10 DAYS)")})
  SELECT 'day' AS branch, seq FROM w UNION ALL SELECT 'fallback', seq FROM late""")
def win08(t):
    rows = t.articles_v
    last = rows.agg(F.max("published_at")).scalar()
    late = stats.report_window(rows, last + F.expr("INTERVAL 10 DAYS"))
    return report_articles(t).select(F.lit("day").alias("branch"), "seq").unionByName(
        late.select(F.lit("fallback").alias("branch"), "seq"))


_REPORTS = """reports_v AS (SELECT conv_id * 1000 + turn AS seq, concat('2024-', lpad(CAST(1 + conv_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + turn % 28 AS STRING), 2, '0')) AS date,
  concat('2024-01-01 ', lpad(CAST(conv_id % 24 AS STRING), 2, '0'), ':', lpad(CAST(turn % 60 AS STRING), 2, '0')) AS generated,
  CASE WHEN conv_id % 3 = 0 THEN '' ELSE text END AS content, CASE WHEN conv_id % 6 = 0 THEN text END AS legacy FROM conversations)"""


def reports(t):
    pad = lambda col: F.lpad(col.cast("string"), 2, "0")
    conv, turn = c("conv_id"), c("turn")
    return t.conversations.select(
        (conv * 1000 + turn).alias("seq"),
        F.concat(F.lit("2024-"), pad(1 + conv % 12), F.lit("-"), pad(1 + turn % 28)).alias("date"),
        F.concat(F.lit("2024-01-01 "), pad(conv % 24), F.lit(":"), pad(turn % 60)).alias("generated"),
        F.when(conv % 3 == 0, "").otherwise(c("text")).alias("content"),
        F.when(conv % 6 == 0, c("text")).alias("legacy"),
    )


@query("win09_report_lookup", f"""WITH {_REPORTS} SELECT 'latest' AS kind, seq, content FROM reports_v WHERE seq = (SELECT max(seq) FROM reports_v)
  UNION ALL SELECT 'first of date', seq, content FROM reports_v QUALIFY row_number() OVER (PARTITION BY date ORDER BY seq) = 1""")
def win09(t):
    r = reports(t)
    return stats.latest_report(r).select(F.lit("latest").alias("kind"), "seq", "content").unionByName(
        stats.report_of_date(r).select(F.lit("first of date").alias("kind"), "seq", "content"))


@query("rep06_editions", f"""WITH {_REPORTS} SELECT seq, concat('report_', replace(date, '-', ''), '.md') AS filename, concat(date, ' ', split_part(generated, ' ', 2)) AS created_at
  FROM reports_v WHERE trim(content) <> ''""")
def rep06(t):
    return stats.editions(reports(t)).select("seq", "filename", "created_at")


@query("snk05_legacy_content", f"""WITH {_REPORTS} SELECT seq, coalesce(nullif(content, ''), legacy, '') AS content FROM reports_v""")
def snk05(t):
    return R.legacy_content(reports(t)).select("seq", "content")


@query("win10_type_caps", "SELECT type, entity_seq FROM dictionary_v QUALIFY row_number() OVER (PARTITION BY type ORDER BY entity_seq) <= 20")
def win10(t):
    return top_per_key(t.dictionary_v, ["type"], [c("entity_seq")], 20).select("type", "entity_seq")


@query("win13_sampling", "SELECT doc_id FROM documents WHERE CAST(concat('0x', left(md5(text), 8)) AS BIGINT) % 10 = 0")
def win13(t):
    return stats.sampled(t.documents, "text", 10).select("doc_id")


# ------------------------------------------------------------------ counts


@query("agg01_dashboard", """SELECT count(*) AS total_articles, count(*) FILTER (category = 'Government') AS total_events,
  count(*) FILTER (risk_score >= 50) AS total_alerts, (SELECT count(*) FROM dictionary_v) AS total_entities FROM articles_v""")
def agg01(t):
    return stats.dashboard_totals(t.articles_v, t.dictionary_v)


@query("agg02_risk_counts", f"""WITH n AS (SELECT {Q.case_floor('risk_score', V.RISK_FLOORS, 'Low')} AS level, count(*) AS n FROM articles_v GROUP BY 1)
  SELECT level, coalesce(n, 0) AS n FROM (SELECT unnest(['Low', 'Medium', 'High', 'Critical']) AS level) l LEFT JOIN n USING (level)""")
def agg02(t):
    return stats.risk_counts(t.articles_v)


@query("agg03_category_counts", "SELECT coalesce(category, 'Other') AS category, count(*) AS n FROM articles_v GROUP BY 1")
def agg03(t):
    return stats.category_counts(t.articles_v)


def mentions(t):
    """Company mentions in varying case, with sometimes empty attributes."""
    k = c("o_orderkey")
    name = F.concat(F.lit("Company "), (k % 150).cast("string"))
    return t.orders.select(
        k.alias("seq"),
        F.when(k % 40 == 3, "").when(k % 7 == 0, F.upper(F.concat(F.lit(" "), name))).otherwise(name).alias("company"),
        c("o_orderdate").alias("seen_at"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Industry "), (k % 5).cast("string"))).alias("industry"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.element_at(F.array(*[F.lit(x) for x in V.RISK_LEVELS]), (k % 4 + 1).cast("int"))).alias("risk_level"),
    )


_MENTIONS = """mentions_v AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 40 = 3 THEN '' WHEN o_orderkey % 7 = 0
   THEN upper(concat(' Company ', CAST(o_orderkey % 150 AS STRING))) ELSE concat('Company ', CAST(o_orderkey % 150 AS STRING)) END AS company,
  o_orderdate AS seen_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Industry ', CAST(o_orderkey % 5 AS STRING)) END AS industry,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ['Low', 'Medium', 'High', 'Critical'][o_orderkey % 4 + 1] END AS risk_level FROM orders)"""


@query("agg04_company_register", f"""WITH {_MENTIONS} SELECT arg_min(trim(company), seq) AS company, count(*) AS mention_count,
   {STAMP_SQL.format('max(seen_at)')} AS last_seen, coalesce(arg_max(industry, seq) FILTER (industry IS NOT NULL), 'General') AS industry,
   coalesce(arg_max(risk_level, seq) FILTER (risk_level IS NOT NULL), 'Low') AS risk_level FROM mentions_v WHERE trim(company) <> '' GROUP BY lower(trim(company))""")
def agg04(t):
    """Two batches: the second is merged into the snapshot of the first."""
    rows = mentions(t)
    snapshot = R.upsert_companies(rows.filter("seq < 10000"))
    return R.upsert_companies(rows.filter("seq >= 10000"), snapshot).withColumn("last_seen", stamp(c("last_seen")))


@query("agg06_title_dedup", f"""WITH {_SUFFIX_V}, k AS (SELECT *, {TITLE_KEY_SQL} AS key FROM suffix_v)
  SELECT seq, risk_score, min(seq) OVER (PARTITION BY key) AS first_seq FROM k WHERE key <> ''
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY risk_score DESC, seq) = 1""")
def agg06(t):
    return stats.dedupe_by_title(_with_suffix(t)).select("seq", "risk_score", "first_seq")


@query("agg10_run_counts", """SELECT count(*) AS total, count(*) FILTER (risk_score >= 50) AS high_risk, count(*) FILTER (seq % 12 = 3) AS appointments,
  count(*) FILTER (seq % 12 = 6 OR seq % 10 = 1) AS procurement FROM articles_v""")
def agg10(t):
    rows = t.articles_v.select(
        S.risk_bucket(c("risk_score")).alias("risk_level"),
        F.when(c("seq") % 12 == 3, "Appointment").when(c("seq") % 12 == 6, "Procurement").otherwise("Other").alias("event_type"),
        (c("seq") % 10 == 1).alias("has_procurement"))
    return stats.run_counts(rows)


@query("agg19_alert_counters", "SELECT count(*) FILTER (risk_score >= 75) AS critical, count(*) AS elevated FROM articles_v WHERE risk_score >= 50")
def agg19(t):
    return stats.alert_counters(gates.feed_alerts(t.articles_v))


_FUNNEL = f"""f AS (SELECT *, lower(concat_ws(chr(10), title, raw_text)) AS low, {Q.fold("lower(concat_ws(chr(10), title, raw_text))")} AS folded,
   lower({Q.squeeze('title')}) AS nt, lower({Q.squeeze('source')}) AS ns, CASE WHEN seq % 10 = 0 THEN NULL ELSE published_at END AS pub FROM articles_v),
 g AS (SELECT NOT {Q.stub('nt', 'ns')} AS live, {COUNTRY_SQL.format(low='low', fold='folded')} AS is_local, pub, seq, title FROM f)"""


_STORIES = greedy_sql(f"""{_FUNNEL}, ok_v AS (SELECT seq, title FROM g WHERE live AND is_local AND pub >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS),
 {WORD_ITEMS.replace('articles_v', 'ok_v')}""", WORD_CLOSE)


@query("agg20_funnel", _STORIES + f""" SELECT count(*) AS "raw", count(*) FILTER (NOT live) AS stubs, count(*) FILTER (live AND is_local) AS country,
  count(*) FILTER (live AND is_local AND pub IS NULL) AS undated, count(*) FILTER (live AND is_local AND pub >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS) AS fresh,
  (SELECT count(*) FROM kept_v) AS distinct_stories FROM g""")
def agg20(t):
    """The whole funnel of a run, to its distinct stories by the words of their titles."""
    rows = t.articles_v.withColumn("published_at", F.when(c("seq") % 10 != 0, c("published_at")))
    # Whole texts are joined and searched once; the titles of what is fresh are read twice.
    flags = materialise(gates.gate_flags(rows, AS_OF), "gate-flags")
    fresh = t.headlines().select("seq", "title").join(flags.filter("fresh").select("seq"), "seq", "left_semi")
    return gates.funnel(rows, AS_OF, dedup.word_set_titles(materialise(fresh, "fresh-titles")), flags)


# ------------------------------------------------------------------ sources, sinks


@query("src06_combine_sources", """SELECT CAST(seq % 3 AS INTEGER) AS source_rank, seq AS arrival_pos, seq, title, CASE WHEN seq % 3 = 0 THEN 'feed' WHEN seq % 3 = 1 THEN 'api' ELSE 'archive' END AS origin FROM articles_v""")
def src06(t):
    from ownerlens.sources import feeds

    parts = [t.articles_v.filter(c("seq") % 3 == i).select("seq", "title", F.lit(n).alias("origin"))
             for i, n in enumerate(("feed", "api", "archive"))]
    return feeds.combine(parts, pos="seq").select("source_rank", "arrival_pos", "seq", "title", "origin")


@query("set01_union", "SELECT seq, title, url, CASE WHEN seq % 2 = 0 THEN lang END AS lang FROM articles_v")
def set01(t):
    from ownerlens.sources import feeds

    even = t.articles_v.filter("seq % 2 = 0").select("seq", "title", "url", "lang")
    odd = t.articles_v.filter("seq % 2 = 1").select("seq", "url", "title")
    return feeds.combine([even, odd], pos="seq").select("seq", "title", "url", "lang")


@query("src07_register_rows", """SELECT CAST(seq AS STRING) AS id, coalesce(title, '') AS title, coalesce(category, '') AS category, '' AS engine FROM articles_v""")
def src07(t):
    return R.migrate(t.articles_v.withColumn("id", c("seq")), V.REGISTER_COLUMNS["articles"]).select("id", "title", "category", "engine")


@query("snk02_schema_migration", """SELECT agency, contractor, CAST(CAST(floor(amount) AS BIGINT) AS STRING) AS amount, '' AS project, '' AS source,
  'project:added source:added seq:removed' AS changes FROM procurement_v""")
def snk02(t):
    old = t.procurement_v.select(c("contractor").alias(" contractor "), c("amount").cast("bigint").alias("amount"), "agency", "seq")
    target = V.REGISTER_COLUMNS["procurement"]
    changes = " ".join(f"{name}:{what}" for name, what in R.column_changes(old.columns, target).items())
    return R.migrate(old, target).withColumn("changes", F.lit(changes))


@query("snk03_published_feed", f"""WITH {Q.off_topic_ctes('articles_v', 'seq', 'title', "raw_text")}
 SELECT seq FROM topic_v WHERE seq % 5 <> 0 AND topic IS NULL ORDER BY seq DESC LIMIT 60""")
def snk03(t):
    rows = t.articles_v.withColumns({"status": F.when(c("seq") % 5 == 0, "Filtered").otherwise("Unread"), "summary": c("raw_text")})
    return R.published_feed(rows).select("seq")


@query("snk04_entity_export", f"""WITH {Q.off_topic_ctes('names_v', 'seq, name', 'name', 'NULL')} SELECT seq, name FROM topic_v WHERE topic IS NULL""")
def snk04(t):
    return R.on_topic(t.names_v, "name").select("seq", "name")


_GUARD_IN = "CASE seq % 6 WHEN 0 THEN concat('=', title) WHEN 1 THEN concat('+', title) WHEN 2 THEN concat('-', title) WHEN 3 THEN concat('@', title) WHEN 4 THEN concat(chr(9), title) ELSE title END"


@query("snk06_csv_guard", f"""WITH g AS (SELECT seq, {_GUARD_IN} AS title, category FROM articles_v) SELECT CAST(seq AS STRING) AS seq,
  CASE WHEN regexp_matches(title, '^[=+\\-@\\t\\r]') THEN concat('''', title) ELSE title END AS title, coalesce(category, '') AS category FROM g""")
def snk06(t):
    return R.guarded(t.articles_v.withColumn("title", F.expr(_GUARD_IN)), ["seq", "title", "category"])


@query("snk07_demo_marking", "SELECT seq, source, (SELECT bool_or(lower(source) = 'seed') FROM psc_v) AS export_is_demo FROM psc_v")
def snk07(t):
    return R.mark_demo(t.psc_v).select("seq", "source", "export_is_demo")


@query("snk09_empty_run", f"""SELECT 'nothing new' AS run, '{AS_OF}' AS date, 'No significant change.' AS generated WHERE (SELECT count(*) FROM articles_v) > 0
  UNION ALL SELECT 'nothing fetched', '{AS_OF}', 'No articles were fetched this cycle.' FROM (SELECT count(*) n FROM articles_v WHERE lang = 'xx') z WHERE n = 0""")
def snk09(t):
    rows = t.articles_v
    again = R.empty_run_record(rows, rows, AS_OF).select(F.lit("nothing new").alias("run"), "date", "generated")
    outage = R.empty_run_record(rows.filter("lang = 'xx'"), rows, AS_OF).select(F.lit("nothing fetched").alias("run"), "date", "generated")
    fresh = R.empty_run_record(rows, rows.filter("seq % 2 = 0 AND seq % 4 = 0"), AS_OF).select(F.lit("has work").alias("run"), "date", "generated")
    return again.unionByName(outage).unionByName(fresh)
