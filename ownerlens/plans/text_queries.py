"""Scalar operators and filters as registered queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ownerlens import vocab as V
from ownerlens.functions import dates as D, holdings as H, scoring as S, text as T
from ownerlens.operators import gates
from ownerlens.plans import sqltext as Q
from ownerlens.plans.registry import query

c = F.col
AS_OF = "2024-01-04 00:00:00"


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


STAMP_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S')"

_ISO = r"trim(split_part(replace(coalesce(published, ''), 'Z', ''), '.', 1))"
_RFC = r"'(?i)^(?:[a-z]+,?\s+)?(\d{1,2}) ([a-z]{3})[a-z]* (\d{4}) (\d{1,2}:\d{1,2}:\d{1,2})(?:\s.*)?$'"
FEED_DATE_SQL = (
    f"coalesce(try_strptime({_ISO}, '%Y-%m-%dT%H:%M:%S'), try_strptime({_ISO}, '%Y-%m-%d %H:%M:%S'), "
    f"try_strptime(regexp_replace(coalesce(published, ''), {_RFC}, '\\1 \\2 \\3 \\4'), '%d %b %Y %H:%M:%S'))"
)


@query("fn01_feed_date", f"SELECT seq, {STAMP_SQL.format(FEED_DATE_SQL)} AS parsed FROM dates_v")
def fn01(t):
    return t.dates_v.select("seq", stamp(D.parse_feed_date(c("published"))).alias("parsed"))


@query("fn02_normalise_title", f"SELECT seq, lower({Q.squeeze('title')}) AS title FROM articles_v")
def fn02(t):
    return t.articles_v.select("seq", T.normalise_title(c("title")).alias("title"))


_STUB_CASES = """
 raw_v AS (SELECT seq, source, CASE seq % 9 WHEN 0 THEN concat(source, ' - ', source) WHEN 1 THEN concat('Contact  Us | ', source)
      WHEN 2 THEN concat(upper(source), ' Home – ', source) WHEN 3 THEN 'Sitemap' WHEN 4 THEN '  ' WHEN 5 THEN concat(title, ' — ', source)
      WHEN 6 THEN concat('Home of ', source) WHEN 7 THEN source ELSE title END AS title FROM articles_v)"""


def _stub_cases(t):
    s = c("source")
    title = (
        F.when(c("seq") % 9 == 0, F.concat(s, F.lit(" - "), s))
        .when(c("seq") % 9 == 1, F.concat(F.lit("Contact  Us | "), s))
        .when(c("seq") % 9 == 2, F.concat(F.upper(s), F.lit(" Home – "), s))
        .when(c("seq") % 9 == 3, "Sitemap")
        .when(c("seq") % 9 == 4, "  ")
        .when(c("seq") % 9 == 5, F.concat(c("title"), F.lit(" — "), s))
        .when(c("seq") % 9 == 6, F.concat(F.lit("Home of "), s))
        .when(c("seq") % 9 == 7, s)
        .otherwise(c("title"))
    )
    return t.articles_v.select("seq", "source", title.alias("title"))


_NORM = f"norm_v AS (SELECT seq, lower({Q.squeeze('title')}) AS t, lower({Q.squeeze('source')}) AS s FROM raw_v)"


@query("fn03_navigation_stub", f"WITH {_STUB_CASES}, {_NORM} SELECT seq, {Q.stub('t', 's')} AS stub FROM norm_v")
def fn03(t):
    return _stub_cases(t).select("seq", T.is_navigation_stub(c("title"), c("source")).alias("stub"))


@query("flt01_drop_stubs", f"WITH {_STUB_CASES}, {_NORM} SELECT seq FROM norm_v WHERE NOT {Q.stub('t', 's')}")
def flt01(t):
    return gates.drop_stubs(_stub_cases(t)).select("seq")


def _drop_sql(x, names):
    pat = "|".join(rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in names)
    return f"regexp_replace({x}, '(?is)<!--.*?-->|{pat}', '', 'g')"


# The named references that the tables hold; the operator knows all of HTML5.
_REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·")]


def _entities_sql(x):
    for name, char in _REFERENCES:
        x = f"replace({x}, {Q.lit(name)}, {Q.lit(char)})"
    return f"replace({x}, '&amp;', '&')"


_CLEAN = _entities_sql(f"regexp_replace({_drop_sql('html', ['script', 'style'])}, '(?s)<!?/?[a-zA-Z][^>]*>', '', 'g')")


@query("fn04_clean_html", f"""SELECT page_id, md5(body) AS body_md5, length(body) AS chars FROM (
  SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex({_CLEAN}, '\\r\\n|\\r|\\n|  '),
     lambda x: {Q.strip('x')}), lambda x: x <> ''), chr(10)) AS body FROM pages)""")
def fn04(t):
    body = T.clean_html(c("html"))
    return t.pages.select("page_id", F.md5(body).alias("body_md5"), F.length(body).cast("bigint").alias("chars"))


_BODY_DROP = _drop_sql("html", ["script", "style", "nav", "header", "footer", "aside", "form"])
_BODY_SQL = f"""
 cut_v AS (SELECT page_id, regexp_replace({_BODY_DROP}, '(?i)<p([\\s>/])', chr(1) || '\\1', 'g') AS t FROM pages),
 part_v AS (SELECT page_id, list_transform((string_split(t, chr(1)))[2:],
     lambda p: regexp_replace(p, '(?is)^[^>]*>|</(?:p|article|body|html)\\s*>.*$', '', 'g')) AS ps FROM cut_v),
 body_v AS (SELECT page_id, array_to_string(list_filter(list_transform(ps, lambda p: array_to_string(list_filter(list_transform(
     string_split_regex(p, '(?s)<[^>]*>'), lambda n: {Q.strip(_entities_sql('n'))}), lambda n: n <> ''), ' ')), lambda p: length(p) > 40), chr(10)) AS body FROM part_v)"""


@query("fn05_article_body", f"WITH {_BODY_SQL} SELECT page_id, md5(body) AS body_md5, length(body) AS chars FROM body_v")
def fn05(t):
    body = T.article_body(c("html"))
    return t.pages.select("page_id", F.md5(body).alias("body_md5"), F.length(body).cast("bigint").alias("chars"))


@query("fn06_body_gate", """SELECT doc_id, CASE WHEN length(text) < 400 THEN 'too_short' WHEN length(text) > 60000 THEN 'too_long'
  ELSE 'ok' END AS verdict FROM documents""")
def fn06(t):
    return t.documents.select("doc_id", T.body_verdict(c("text")).alias("verdict"))


_LOW = Q.fold("lower(text)")


@query("fn07_language", f"""WITH f AS (SELECT doc_id, {_LOW} AS t FROM documents),
 n AS (SELECT doc_id, len(regexp_extract_all(t, '\\b[a-z]+\\b')) AS words, len(regexp_extract_all(t, {Q.words(V.ENGLISH_STOPWORDS)})) AS en FROM f)
 SELECT doc_id, CASE WHEN words = 0 THEN 'unknown' WHEN en / words > 0.10 THEN 'en' ELSE 'other' END AS language FROM n""")
def fn07(t):
    return t.documents.select("doc_id", S.detect_language(c("text")).alias("language"))


def full_text():
    return F.concat_ws(". ", c("title"), c("raw_text"))


FULL = "concat_ws('. ', title, raw_text)"
_FULL_V = f"full_v AS (SELECT *, lower({FULL}) AS low, {Q.fold(f'lower({FULL})')} AS folded FROM articles_v)"


@query("fn08_sentiment", f"WITH {_FULL_V} SELECT seq, {Q.sentiment('low')} AS sentiment FROM full_v")
def fn08(t):
    return t.articles_v.select("seq", S.sentiment(full_text()).alias("sentiment"))


@query("fn09_risk_level", f"WITH {_FULL_V} SELECT seq, {Q.risk_level('folded')} AS risk_level FROM full_v")
def fn09(t):
    return t.articles_v.select("seq", S.risk_level(full_text()).alias("risk_level"))


@query("fn10_category", f"WITH {_FULL_V} SELECT seq, {Q.category('low')} AS category FROM full_v")
def fn10(t):
    return t.articles_v.select("seq", S.category(full_text()).alias("category"))


IMPORTANCE_SQL = (
    "greatest(0.0, least(100.0, 30.0 + CASE WHEN {cat} = 'Government' THEN 15.0 ELSE 0.0 END"
    f" + CASE WHEN {{cat}} = 'Government' AND {Q.has_any('{low}', V.GOVERNMENT_LEVEL_WORDS)} THEN 15.0 ELSE 0.0 END"
    f" + CASE WHEN list_has_any(list_transform({{pos}}, lambda x: lower(x)), [{', '.join(Q.lit(x.lower()) for x in V.SENIOR_TITLES)}]) THEN 15.0 ELSE 0.0 END"
    " + least({people} * 2.0, 10.0) + least({orgs} * 3.0, 15.0)"
    f" + CASE WHEN {Q.has_any('{low}', V.BREAKING_WORDS)} THEN 10.0 ELSE 0.0 END))::DOUBLE"
)


@query("fn11_importance", f"""WITH {_FULL_V}, p AS (SELECT *, {Q.positions('folded')} AS pos FROM full_v)
 SELECT seq, {IMPORTANCE_SQL.format(cat='category', low='low', pos='pos', people='(seq % 7)', orgs='(seq % 6)')} AS importance FROM p""")
def fn11(t):
    return t.articles_v.select(
        "seq",
        S.importance(full_text(), T.job_titles(full_text()), c("seq") % 7, c("seq") % 6,
                     F.coalesce(c("category"), F.lit(""))).alias("importance"),
    )


SUMMARY_SQL = f"""
 sent_v AS (SELECT *, {Q.sentence_list('raw_text')} AS s FROM articles_v),
 dated_v AS (SELECT *, list_slice(list_filter(s, lambda x: regexp_matches({Q.fold('x')},
     '(?i)\\b(?:(?:19|20)\\d{{2}}|{'|'.join(V.MONTH_WORDS + V.DAY_WORDS)})\\b')), 1, 3) AS d FROM sent_v),
 sum_v AS (SELECT *, CASE WHEN len(s) > 0 THEN left(s[1], 200) ELSE title END AS one_line,
     array_to_string(list_slice(s, 1, 2), ' ') AS executive, array_to_string(list_slice(s, 1, 5), ' ') AS detailed,
     CASE WHEN len(s) = 0 THEN '' ELSE concat(' ', chr(10), '- ', array_to_string(CASE WHEN len(d) > 0 THEN d ELSE list_slice(s, 1, 3) END,
        concat(' ', chr(10), '- '))) END AS timeline FROM dated_v)"""


@query("fn12_summaries", f"WITH {SUMMARY_SQL} SELECT seq, one_line, executive, detailed, timeline FROM sum_v")
def fn12(t):
    return t.articles_v.select("seq", S.summaries(c("title"), c("raw_text")).alias("s")).select("seq", "s.*")


@query("fn13_job_titles", f"WITH {_FULL_V} SELECT seq, array_to_string({Q.positions('folded')}, '|') AS positions FROM full_v")
def fn13(t):
    return t.articles_v.select("seq", F.array_join(T.job_titles(full_text()), "|").alias("positions"))


def _strip_titles_sql(x):
    for title in V.JOB_TITLES:
        x = f"regexp_replace({x}, '(?i)\\b{title}\\b\\s*', '', 'g')"
    return f"trim({x})"


@query("fn14_person_name", f"""SELECT seq, CASE WHEN length({_strip_titles_sql('name')}) > 2 THEN {_strip_titles_sql('name')} END AS person FROM names_v""")
def fn14(t):
    return t.names_v.select("seq", T.strip_job_titles(c("name")).alias("person"))


@query("fn15_organisation_type", f"""SELECT seq, CASE WHEN {Q.has_any('lower(name)', V.AGENCY_WORDS)} THEN 'agency' ELSE 'company' END AS type,
  CASE WHEN {Q.has_any('lower(name)', V.AGENCY_WORDS_FALLBACK)} THEN 'agency' ELSE 'company' END AS fallback_type FROM names_v""")
def fn15(t):
    return t.names_v.select(
        "seq", T.organisation_type(c("name")).alias("type"),
        T.organisation_type(c("name"), V.AGENCY_WORDS_FALLBACK).alias("fallback_type"),
    )


_NAME = f"lower({Q.squeeze('name')})"
FURNITURE_SQL = f"({{n}} = '' OR {{n}} IN {Q.inlist(V.PAGE_FURNITURE)} OR {Q.has_any('{n}', V.OUTLET_MARKERS)})"


@query("fn16_publication", f"SELECT seq, {FURNITURE_SQL.format(n=_NAME)} AS is_publication FROM names_v")
def fn16(t):
    return t.names_v.select("seq", T.is_publication_or_furniture(c("name")).alias("is_publication"))


@query("flt08_drop_publications", f"SELECT seq, name FROM names_v WHERE NOT {FURNITURE_SQL.format(n=_NAME)}")
def flt08(t):
    return t.names_v.filter(~T.is_publication_or_furniture(c("name"))).select("seq", "name")


@query("fn17_share_band", f"SELECT seq, {Q.pct('percentage')} AS pct, {Q.band('percentage')} AS band FROM psc_v")
def fn17(t):
    return t.psc_v.select("seq", H.to_percent(c("percentage")).alias("pct"), H.share_band(c("percentage")).alias("band"))


@query("fn18_risk_bucket", f"SELECT seq, {Q.case_floor('risk_score', V.RISK_FLOORS, 'Low')} AS bucket FROM articles_v")
def fn18(t):
    return t.articles_v.select("seq", S.risk_bucket(c("risk_score")).alias("bucket"))


@query("fn19_news_listing", """SELECT seq AS id, title, source, url, category, risk_score,
  CASE WHEN coalesce(risk_score, 0) >= 50 THEN 'High' ELSE 'Low' END AS risk_level, raw_text AS summary FROM articles_v""")
def fn19(t):
    return gates.news_listing(t.articles_v.withColumn("summary", c("raw_text")))


@query("fn20_node_id", "SELECT seq, left(md5(lower(trim(person_name))), 12) AS id FROM psc_v")
def fn20(t):
    return t.psc_v.select("seq", T.node_id(c("person_name")).alias("id"))


_SLUG_IN = "concat(text, ' & ', source)"
_SLUG = (f"regexp_replace(regexp_replace(replace(strip_accents(lower({Q.squeeze(_SLUG_IN)})), '&', ' and '), "
         "'[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")


@query("fn21_slug", f"""SELECT doc_id, lower({Q.squeeze(_SLUG_IN)}) AS name_key, {_SLUG} AS slug,
  {_SLUG} <> '' AND {_SLUG} = {_SLUG.replace('concat(text,', 'concat(substr(text, 1, length(text) - 1),')} AS matches_shorter FROM documents""")
def fn21(t):
    name = F.concat(c("text"), F.lit(" & "), c("source"))
    shorter = F.concat(F.substring(c("text"), F.lit(1), F.length("text") - 1), F.lit(" & "), c("source"))
    return t.documents.select(
        "doc_id", T.name_key(name).alias("name_key"), T.slugify(name).alias("slug"),
        T.matches_slug(name, T.slugify(shorter)).alias("matches_shorter"),
    )


TITLE_KEY_SQL = (
    f"trim(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(title, ''), '{Q.WS}+[-–—|]{Q.WS}+[^-–—|]{{2,40}}$', '')), "
    "'[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"
)


def _with_suffix(t):
    return t.articles_v.withColumn(
        "title", F.when(c("seq") % 3 == 0, F.concat(c("title"), F.lit(" - Daily Paper"))).otherwise(c("title")))


_SUFFIX_V = "suffix_v AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN concat(title, ' - Daily Paper') ELSE title END AS title) FROM articles_v)"


@query("fn22_title_key", f"WITH {_SUFFIX_V} SELECT seq, {TITLE_KEY_SQL} AS key FROM suffix_v")
def fn22(t):
    return _with_suffix(t).select("seq", T.title_key(c("title")).alias("key"))


_FEED_SUMMARY = "concat(raw_text, ' AT&amp;T &quot;x&quot; ... [+', CAST(1 + seq % 5 AS STRING), ' chars] ')"


@query("fn23_clean_summary", f"""SELECT seq, {Q.strip(_entities_sql(f"regexp_replace({_FEED_SUMMARY}, '(?i){Q.WS}*[[][+][0-9]+{Q.WS}*chars?[]]{Q.WS}*$', '…')"))} AS summary FROM articles_v""")
def fn23(t):
    raw = F.concat(c("raw_text"), F.lit(" AT&amp;T &quot;x&quot; ... [+"),
                   (1 + c("seq") % 5).cast("string"), F.lit(" chars] "))
    return t.articles_v.select("seq", T.clean_summary(raw).alias("summary"))


@query("fn24_normalise_article", f"""SELECT seq, coalesce(nullif(source, ''), 'Unknown') AS source, coalesce(nullif(url, ''), '#') AS url,
  coalesce(nullif(category, ''), 'Other') AS category, risk_score, {Q.case_floor('risk_score', V.RISK_FLOORS, 'Low')} AS risk_level,
  'Neutral' AS sentiment, CASE WHEN {Q.strip('raw_text')} <> '' THEN {Q.strip('raw_text')} ELSE 'No summary available.' END AS summary FROM articles_v""")
def fn24(t):
    raw = t.articles_v.withColumn("summary", c("raw_text"))
    return gates.normalise_articles(raw).select(
        "seq", "source", "url", "category", "risk_score", "risk_level", "sentiment", "summary")


@query("fn25_direct_holding", f"SELECT seq, {Q.direct('vehicle')} AS direct FROM psc_v")
def fn25(t):
    return t.psc_v.select("seq", H.is_direct_holding(c("vehicle")).alias("direct"))


CHAIN_SQL = f"""
 step_v AS (SELECT seq, 0 AS pos, 'person' AS kind, coalesce(nullif(person_name, ''), 'Undisclosed holder') AS title, 'Natural person' AS subtitle FROM psc_v
  UNION ALL SELECT seq, 1, 'vehicle', vehicle, 'Intermediate vehicle' FROM psc_v WHERE NOT {Q.direct('vehicle')}
  UNION ALL SELECT seq, CASE WHEN {Q.direct('vehicle')} THEN 1 ELSE 2 END, 'company', coalesce(nullif(company, ''), 'Undisclosed company'), 'Operating company' FROM psc_v)"""


@query("fn26_control_chain", f"WITH {CHAIN_SQL} SELECT * FROM step_v")
def fn26(t):
    chain = H.control_chain(c("person_name"), F.lit(""), c("vehicle"), c("company"))
    return t.psc_v.select("seq", F.posexplode(chain).alias("pos", "step")).select("seq", "pos", "step.*")


@query("fn31_edition_label", """SELECT event_id, CASE WHEN hour(ts) BETWEEN 8 AND 11 THEN '10:00 AM' WHEN hour(ts) BETWEEN 12 AND 15 THEN '2:00 PM'
  WHEN hour(ts) BETWEEN 16 AND 19 THEN '6:00 PM' ELSE strftime(ts, '%I:00 %p') END AS edition FROM events""")
def fn31(t):
    return t.events.select("event_id", D.edition_label(c("ts")).alias("edition"))


_ID = "CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(o_orderkey AS STRING), '.0') WHEN 1 THEN concat(' ', CAST(o_orderkey AS STRING)) WHEN 2 THEN concat(CAST(o_orderkey AS STRING), '.5') WHEN 3 THEN 'n/a' ELSE '' END"


@query("fn32_whole_id", f"""SELECT o_orderkey, CASE WHEN try_cast(trim({_ID}) AS DOUBLE) = floor(try_cast(trim({_ID}) AS DOUBLE))
  THEN CAST(try_cast(trim({_ID}) AS DOUBLE) AS BIGINT) ELSE 0 END AS id FROM orders""")
def fn32(t):
    return t.orders.select("o_orderkey", F.expr(_ID).alias("raw")).select("o_orderkey", T.whole_id(c("raw")).alias("id"))


@query("fn33_alert_text", """SELECT seq, concat('Risk Alert: ', title) AS title, CASE WHEN risk_score >= 75 THEN 'Critical' ELSE 'Warning' END AS severity
  FROM articles_v WHERE risk_score >= 50""")
def fn33(t):
    return gates.feed_alerts(t.articles_v).select("seq", "title", "severity")


# ------------------------------------------------------------------ filters

COUNTRY_SQL = (f"({Q.has_any('lower(url)', V.COUNTRY_URL_MARKERS)} OR {Q.has_any('{low}', V.COUNTRY_TEXT_MARKERS)} "
               f"OR {Q.hits('{fold}', V.COUNTRY_WHOLE_WORDS)})")


@query("flt02_country_gate", f"""WITH u AS (SELECT * REPLACE (CASE WHEN seq % 4 = 0 THEN url ELSE replace(url, '.ng', '.com') END AS url,
   CASE WHEN seq % 7 = 0 THEN concat(title, ' FIRS notice') ELSE title END AS title) FROM articles_v),
 f AS (SELECT *, lower(concat_ws(chr(10), title, raw_text)) AS low, {Q.fold("lower(concat_ws(chr(10), title, raw_text))")} AS folded FROM u)
 SELECT seq FROM f WHERE {COUNTRY_SQL.format(low='low', fold='folded')}""")
def flt02(t):
    mixed = t.articles_v.withColumn(
        "url", F.when(c("seq") % 4 == 0, c("url")).otherwise(F.replace(c("url"), F.lit(".ng"), F.lit(".com")))
    ).withColumn("title", F.when(c("seq") % 7 == 0, F.concat(c("title"), F.lit(" FIRS notice"))).otherwise(c("title")))
    return gates.keep_country(mixed).select("seq")


@query("flt03_freshness", f"""SELECT seq, {STAMP_SQL.format('published_at')} AS published_at FROM articles_v
  WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOURS""")
def flt03(t):
    fresh = gates.keep_fresh(t.articles_v, AS_OF)
    return fresh.select("seq", stamp(c("published_at")).alias("published_at"))


@query("flt04_off_topic", f"""WITH {Q.off_topic_ctes('articles_v', 'seq', 'title', 'raw_text')}
 SELECT seq, topic, array_to_string(matched, '|') AS matched FROM topic_v WHERE topic IS NOT NULL""")
def flt04(t):
    reason = t.articles_v.select("seq", S.off_topic(c("title"), c("raw_text")).alias("r")).filter("r IS NOT NULL")
    return reason.select("seq", "r.topic", F.array_join("r.matched", "|").alias("matched"))


@query("flt05_relevance_gate", f"""WITH {Q.off_topic_ctes('articles_v', 'seq, category, risk_score', 'title', "raw_text")}
 SELECT seq, CASE WHEN seq % 4 = 0 OR topic IS NOT NULL THEN 'Filtered' ELSE 'Unread' END AS status,
   CASE WHEN seq % 4 = 0 OR topic IS NOT NULL THEN 'Non-Relevant' ELSE coalesce(category, 'Other') END AS category,
   CASE WHEN seq % 4 = 0 OR topic IS NOT NULL THEN 0 ELSE risk_score END AS risk_score FROM topic_v""")
def flt05(t):
    rows = t.articles_v.withColumn("relevant", c("seq") % 4 != 0).withColumn("summary", c("raw_text"))
    return gates.relevance_gate(rows).select("seq", "status", "category", "risk_score")


@query("flt06_english_only", f"""WITH f AS (SELECT doc_id, source, {_LOW} AS t FROM documents),
 n AS (SELECT doc_id, source, len(regexp_extract_all(t, '\\b[a-z]+\\b')) AS words, len(regexp_extract_all(t, {Q.words(V.ENGLISH_STOPWORDS)})) AS en FROM f)
 SELECT doc_id FROM n WHERE (words > 0 AND en / nullif(words, 0) > 0.10) OR source = 'src3'""")
def flt06(t):
    return gates.keep_english(t.documents, c("text"), seeded=c("source") == "src3").select("doc_id")


@query("flt07_violence_gate", f"""SELECT seq, {Q.has_any("lower(concat(title, CASE seq % 5 WHEN 0 THEN ' Kidnap ring' WHEN 1 THEN ' Airstrike' WHEN 2 THEN ' mourners' ELSE '' END))", V.VIOLENCE_STEMS)} AS dropped FROM articles_v""")
def flt07(t):
    tail = F.when(c("seq") % 5 == 0, " Kidnap ring").when(c("seq") % 5 == 1, " Airstrike").when(c("seq") % 5 == 2, " mourners").otherwise("")
    return t.articles_v.select("seq", gates.is_violent(F.concat(c("title"), tail)).alias("dropped"))


@query("flt11_feed_filters", """SELECT seq FROM articles_v WHERE lower(coalesce(category, '')) = 'company' AND risk_score >= 50 AND risk_score < 75
  AND (contains(lower(title), 'the') OR contains(lower(raw_text), 'the'))""")
def flt11(t):
    rows = t.articles_v.withColumn("summary", c("raw_text")).withColumn("risk_level", S.risk_bucket(c("risk_score")))
    return gates.feed_filter(rows, category="company", risk="high", text="the").select("seq")


_TOPIC_ROWS = " UNION ALL ".join(
    f"SELECT seq, {Q.lit(n)} AS topic FROM full_v WHERE {Q.hits('folded', [w.lower() for w in ws])}"
    for n, ws in V.SEARCH_TOPICS.items())


@query("src09_topic_tags", f"WITH {_FULL_V} {_TOPIC_ROWS}")
def src09(t):
    return t.articles_v.select("seq", F.explode(S.topics(full_text())).alias("topic"))
