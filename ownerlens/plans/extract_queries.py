"""Extraction operators as registered queries."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ownerlens import schemas, vocab as V
from ownerlens.functions import scoring as S
from ownerlens.operators import extract as X, ingest as IG, publish as PB
from ownerlens.plans import sqltext as Q
from ownerlens.plans.registry import query
from ownerlens.session import materialise, scratch_path
from ownerlens.plans.text_queries import FURNITURE_SQL, FULL, IMPORTANCE_SQL, SUMMARY_SQL, full_text

c = F.col

_HAY = "lower(concat(title, ' ', raw_text))"


def mentions(t, limit=10, rows=None):
    hay = F.concat_ws(" ", c("title"), c("raw_text"))
    return X.match_entities(t.articles_v if rows is None else rows, t.dictionary_v, hay, limit)


MENTIONS_SQL = f"""
 keyed_v AS (SELECT *, lower(trim(name)) AS key FROM dictionary_v WHERE length(trim(name)) >= 4
   QUALIFY row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY entity_seq) = 1),
 hit_v AS (SELECT a.seq, k.entity_seq, trim(k.name) AS name, k.type, row_number() OVER (PARTITION BY a.seq ORDER BY k.entity_seq) AS rn
   FROM articles_v a JOIN keyed_v k ON contains({_HAY}, k.key)),
 mention_v AS (SELECT seq, entity_seq, name, type FROM hit_v WHERE rn <= 10)"""


@query("fn30_article_entities", f"WITH {MENTIONS_SQL} SELECT seq, entity_seq, name, type FROM mention_v")
def fn30(t):
    return mentions(t).select("seq", "entity_seq", "name", "type")


# Sentences with names in them, wrapped around the article text.
_SENTENCES = [
    "Lagoon Holdings appoints Chairman Ada Obi in Abuja.", "Director Musa Bello resigns from Hill Bank.",
    "Hill Bank acquired Plain Industries Limited.", "Lagoon Holdings partnered with Hill Bank.",
    "Securities Commission investigates Plain Industries Limited near Port Harcourt.", "Ministry suing Lagoon Group today.",
    "The board will suspend Minister Eke Udo.", "Nothing else to report.",
]
_TEXT_SQL = f"concat([{', '.join(Q.lit(s) for s in _SENTENCES)}][seq % 8 + 1], ' ', [{', '.join(Q.lit(s) for s in _SENTENCES)}][(seq // 8) % 8 + 1], ' ', raw_text)"


def story_text():
    arr = F.array(*[F.lit(s) for s in _SENTENCES])
    pick = lambda i: F.element_at(arr, (i + 1).cast("int"))
    return F.concat_ws(" ", pick(c("seq") % 8), pick(F.floor(c("seq") / 8) % 8), c("raw_text"))


def stories(t):
    return t.articles_v.withColumn("text", story_text()).withColumn("entities", X.named_entities(c("text")))


def _sql_find(pattern):
    return f"list_distinct(regexp_extract_all({Q.fold('text')}, {Q.lit(pattern)}, 1))"


_STORY = f"""
 story_v AS (SELECT * REPLACE (category AS category), {_TEXT_SQL} AS text FROM articles_v),
 ent_v AS (SELECT *, {_sql_find(X.PERSON_PATTERN)} AS people, {_sql_find(X.ORGANISATION_PATTERN)} AS orgs,
   {_sql_find(X.LOCATION_PATTERN)} AS places, {Q.positions(Q.fold('lower(text)'))} AS pos FROM story_v)"""


@query("ext01_named_entities", f"""WITH {_STORY} SELECT seq, array_to_string(list_sort(people), '|') AS people, array_to_string(list_sort(orgs), '|') AS organizations,
  array_to_string(list_sort(places), '|') AS locations, array_to_string(pos, '|') AS positions FROM ent_v""")
def ext01(t):
    rows = stories(t)
    show = lambda n: F.array_join(F.array_sort(c(f"entities.{n}")), "|").alias(n)
    return rows.select("seq", show("people"), show("organizations"), show("locations"),
                       F.array_join("entities.positions", "|").alias("positions"))


_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_VERB = "CASE " + " ".join(f"WHEN regexp_matches(folded, '\\b{stem}') THEN '{stem}'" for stem in V.RELATION_STEMS) + " END"
_RELATIONS = f"""
 rstory_v AS (SELECT seq, {_TEXT_SQL} AS text FROM articles_v),
 found_v AS (SELECT *, regexp_extract_all(text, {Q.lit(X.PERSON_PATTERN)}, 1) AS p0, regexp_extract_all(text, {Q.lit(X.ORGANISATION_PATTERN)}, 1) AS o0,
   {Q.positions(Q.fold('lower(text)'))} AS pos, {Q.sentence_list('text')} AS sents FROM rstory_v),
 uniq_v AS (SELECT seq, {_ORDERED.format('p0')} AS people, {_ORDERED.format('o0')} AS orgs, pos, sents FROM found_v),
 snt_v AS (SELECT seq, people, orgs, pos, unnest(sents) AS sentence, unnest(range(len(sents))) AS sentence_no FROM uniq_v),
 verb_v AS (SELECT *, {_VERB} AS verb FROM (SELECT *, {Q.fold('lower(sentence)')} AS folded FROM snt_v) f),
 in_v AS (SELECT seq, sentence_no, verb, list_filter(people, lambda x: contains(sentence, x)) AS p, list_filter(orgs, lambda x: contains(sentence, x)) AS o,
   list_filter(pos, lambda x: contains(sentence, x)) AS q FROM verb_v WHERE verb IS NOT NULL),
 relation_v AS (SELECT seq, sentence_no, coalesce(o[1], 'Government') AS subject, 'appointed' AS predicate, coalesce(p[1], q[1], 'Unknown Person') AS object, 0.8::DOUBLE AS confidence FROM in_v WHERE verb IN ('appoint', 'hire')
   UNION ALL SELECT seq, sentence_no, coalesce(p[1], 'Executive'), 'resigned from', coalesce(o[1], 'Company'), 0.85 FROM in_v WHERE verb IN ('resign', 'retire')
   UNION ALL SELECT seq, sentence_no, o[1], 'acquired', o[2], 0.9 FROM in_v WHERE verb IN ('acquire', 'buy') AND len(o) > 1
   UNION ALL SELECT seq, sentence_no, o[1], 'partnered with', o[2], 0.85 FROM in_v WHERE verb = 'partner' AND len(o) > 1
   UNION ALL SELECT seq, sentence_no, coalesce(o[1], 'Regulatory Body'), CASE verb WHEN 'sue' THEN 'suing' ELSE 'investigating' END, coalesce(o[2], p[1], 'Company'), 0.75 FROM in_v WHERE verb IN ('investigate', 'sue'))"""


@query("ext02_relations", f"WITH {_RELATIONS} SELECT seq, CAST(sentence_no AS INTEGER) AS sentence_no, subject, predicate, object, confidence FROM relation_v")
def ext02(t):
    return X.relations(stories(t))


@query("ext07_event_type", f"""WITH {_RELATIONS}, one_v AS (SELECT seq, arg_min(predicate, sentence_no) AS p FROM relation_v GROUP BY seq)
 SELECT a.seq, coalesce(upper(left(p, 1)) || substr(p, 2), 'Policy announcement') AS event_type FROM articles_v a LEFT JOIN one_v USING (seq)""")
def ext07(t):
    rows = stories(t)
    return X.event_type(X.relations(rows), rows.select("seq")).select("seq", "event_type")


def extractions(t):
    """Extraction records with nested arrays, derived from the articles."""
    k = c("seq")
    name = lambda prefix, m: F.concat(F.lit(prefix), (k % m).cast("string"))
    null = F.lit(None).cast("string")
    orgs = F.array(
        F.struct(name("Company ", 150).alias("name"), F.lit("company").alias("type")),
        F.struct(name("Agency ", 25).alias("name"), F.lit("agency").alias("type")),
        F.struct(F.when(k % 6 == 0, "The Guardian").otherwise(name("Board ", 9)).alias("name"),
                 F.when(k % 2 == 0, "company").otherwise("agency").alias("type")),
    )
    people = F.when(k % 3 == 0, F.array(F.struct(
        name("Person ", 200).alias("name"), null.alias("position"), name("Company ", 150).alias("organization"),
        F.when(k % 2 == 0, "resignation").alias("event"))))
    held = {f.name: null for f in schemas.HOLDING.fields}
    held.update(name=name("Holder ", 90), organization=name("Company ", 150), nature_of_control=F.when(k % 8 == 0, ""),
                percentage=F.when(k % 8 == 0, "30%"), intermediate_entities=F.when(k % 12 == 0, "Hill Trust"))
    holding = F.when(k % 4 == 0, F.array(F.struct(*[v.alias(n) for n, v in held.items()])))
    procurement = F.when(k % 10 == 1, F.struct(
        F.when(k % 20 == 1, name("Agency ", 25)).otherwise("").alias("agency"), null.alias("contractor"), null.alias("amount"), null.alias("project")))
    ex = F.struct(
        F.when(k % 5 != 0, k % 2 == 0).alias("relevant"), c("category").alias("category"),
        F.when(k % 3 == 0, "Appointment").alias("event_type"), c("risk_score").cast("int").alias("risk_score"),
        S.risk_bucket(c("risk_score")).alias("risk_level"), F.lit(None).cast("int").alias("importance_score"),
        F.lit(None).cast("string").alias("summary"), orgs.alias("organizations"), people.alias("people"),
        holding.alias("significant_control"), procurement.alias("procurement"),
    )
    return t.articles_v.select("seq", "title", "source", "url", ex.alias("extraction"))


@query("fn28_extraction_defaults", f"""SELECT seq, coalesce(CASE WHEN seq % 5 <> 0 THEN seq % 2 = 0 END, FALSE) AS relevant, coalesce(category, 'Other') AS category,
  CASE WHEN seq % 3 = 0 THEN 'Appointment' ELSE 'Other' END AS event_type, CAST(risk_score AS INTEGER) AS risk_score, 50 AS importance_score, '' AS summary,
  CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS n_people, CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END AS n_holders FROM articles_v""")
def fn28(t):
    e = extractions(t).select("seq", X.with_defaults(c("extraction")).alias("e"))
    return e.select("seq", "e.relevant", "e.category", "e.event_type", "e.risk_score", "e.importance_score", "e.summary",
                    F.size("e.people").alias("n_people"), F.size("e.significant_control").alias("n_holders"))


_ORGS = f"""org_v AS (SELECT * FROM (
   SELECT seq, 0 AS pos, title, concat('Company ', CAST(seq % 150 AS STRING)) AS name, 'company' AS type, risk_score FROM articles_v
   UNION ALL SELECT seq, 1, title, concat('Agency ', CAST(seq % 25 AS STRING)), 'agency', risk_score FROM articles_v
   UNION ALL SELECT seq, 2, title, CASE WHEN seq % 6 = 0 THEN 'The Guardian' ELSE concat('Board ', CAST(seq % 9 AS STRING)) END,
     CASE WHEN seq % 2 = 0 THEN 'company' ELSE 'agency' END, risk_score FROM articles_v) o WHERE NOT {FURNITURE_SQL.format(n='lower(name)')})"""
_RISK = Q.case_floor("risk_score", V.RISK_FLOORS, "Low")
_HOLDINGS = f"""hold_v AS (SELECT seq, concat('Holder ', CAST(seq % 90 AS STRING)) AS person_name, concat('Company ', CAST(seq % 150 AS STRING)) AS company,
   CASE WHEN seq % 8 = 0 THEN '30%' ELSE '' END AS percentage, CASE WHEN seq % 8 = 0 THEN 'BAND_25_50' ELSE '' END AS share_band,
   CASE WHEN seq % 12 = 0 THEN 'Hill Trust' ELSE 'Direct Holding' END AS vehicle, '' AS nature_of_control, 'Not assessed' AS pep_status, 'Standard' AS risk_level,
   'disclosed' AS change_type, 'extracted' AS source FROM articles_v WHERE seq % 4 = 0)"""


@query("fn29_holding_rows", f"WITH {_HOLDINGS} SELECT * FROM hold_v")
def fn29(t):
    return X.holding_rows(extractions(t), "2024-01-04").select(
        "seq", "person_name", "company", "percentage", "share_band", "vehicle", "nature_of_control", "pep_status",
        "risk_level", "change_type", "source")


@query("ext06_fan_out", f"""WITH {_ORGS}, {_HOLDINGS}
 SELECT 'companies' AS register, seq, name AS a, {_RISK} AS b FROM org_v WHERE type = 'company'
 UNION ALL SELECT 'agencies', seq, name, CASE WHEN seq % 3 = 0 THEN 'Appointment' ELSE 'Directive' END FROM org_v WHERE type = 'agency'
 UNION ALL SELECT 'people', seq, concat('Person ', CAST(seq % 200 AS STRING)), concat('Director, Company ', CAST(seq % 150 AS STRING), ', ', CASE WHEN seq % 2 = 0 THEN 'resignation' ELSE 'appointment' END) FROM articles_v WHERE seq % 3 = 0
 UNION ALL SELECT 'procurement', seq, concat('Agency ', CAST(seq % 25 AS STRING)), concat('TBD, N/A, ', title) FROM articles_v WHERE seq % 20 = 1
 UNION ALL SELECT 'significant_control', seq, person_name, share_band FROM hold_v""")
def ext06(t):
    f = c("fields")
    a = {"companies": f["company"], "agencies": f["agency"], "people": f["name"], "procurement": f["agency"], "significant_control": f["person_name"]}
    b = {"companies": f["risk_level"], "agencies": f["event"], "people": F.concat_ws(", ", f["position"], f["organization"], f["event"]),
         "procurement": F.concat_ws(", ", f["contractor"], f["amount"], f["project"]), "significant_control": f["share_band"]}
    pick = lambda values: F.coalesce(*[F.when(c("register") == name, value) for name, value in values.items()])
    return X.fan_out(extractions(t), "2024-01-04").select("register", "seq", pick(a).alias("a"), pick(b).alias("b"))


_REPLY = """CASE seq % 6 WHEN 0 THEN concat('Here it is: ```json {"relevant": true, "category": "Legal", "risk_score": ', CAST(seq % 100 AS STRING), '} ``` done')
  WHEN 1 THEN concat('{"relevant": false, "category": "Company", "risk_score": ', CAST(seq % 100 AS STRING), '}')
  WHEN 2 THEN concat('Sure. {"category": "Other", "risk_score": ', CAST(seq % 100 AS STRING), '} Hope this helps')
  WHEN 3 THEN '{"relevant": true, "category": ' WHEN 4 THEN 'I cannot answer that' ELSE '' END"""


def replies(t):
    return t.articles_v.select("seq", "title", "raw_text", F.expr(_REPLY).alias("reply"))


_PARSED = """p AS (SELECT seq, CASE WHEN seq % 6 IN (0, 1, 2) THEN ['Legal', 'Company', 'Other'][seq % 6 + 1] END AS category,
   CASE seq % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS relevant, CASE WHEN seq % 6 < 3 THEN CAST(seq % 100 AS INTEGER) END AS risk_score FROM articles_v)"""


@query("fn27_reply_json", f"WITH {_PARSED} SELECT seq, category, relevant, risk_score FROM p")
def fn27(t):
    e = X.from_replies(replies(t))
    return e.select("seq", "extraction.category", "extraction.relevant", "extraction.risk_score")


def attempts(t):
    """Two providers that each miss some articles, and the vocabulary fallback for a few."""
    rows = X.from_replies(replies(t)).withColumn("first", X.with_defaults(c("extraction")))
    second = X.with_defaults(F.from_json(F.when(c("seq") % 6 == 3, F.lit('{"category": "Legal", "relevant": true}')), schemas.EXTRACTION))
    return rows.withColumn("second", second)


@query("ext04_cascade", """SELECT seq, CASE WHEN seq % 6 < 3 THEN 'first' WHEN seq % 6 = 3 THEN 'second' END AS engine,
  CASE seq % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN TRUE END AS relevant FROM articles_v""")
def ext04(t):
    return X.cascade(attempts(t), ["first", "second"]).select("seq", "engine", "extraction.relevant")


@query("ext05_run_health", """SELECT count(*) AS tried, count(*) FILTER (seq % 6 >= 4) AS failed, 'degraded' AS verdict FROM articles_v""")
def ext05(t):
    return X.run_health(X.cascade(attempts(t), ["first", "second"]))


_RUNS = """arr_v AS (SELECT url, min(seq) AS seq FROM articles_v GROUP BY url),
 try_v AS (SELECT seq, url, 1 + CAST(seq % 3 AS INTEGER) AS arrives FROM arr_v),
 end_v AS (SELECT seq, url, CASE WHEN arrives = 3 THEN 3 WHEN seq % 5 < 3 THEN 2 ELSE 3 END AS done FROM try_v)"""


@query("ext05_publish_gate", f"""WITH {_RUNS}
 SELECT 'health' AS part, CAST(run AS BIGINT) AS run, CASE run WHEN 1 THEN 'nothing published' WHEN 2 THEN 'degraded' ELSE 'ok' END AS what, CASE run WHEN 1 THEN (SELECT count(*) FROM try_v WHERE arrives = 1)
   WHEN 2 THEN (SELECT count(*) FROM try_v WHERE arrives <= 2) ELSE (SELECT count(*) FROM end_v WHERE done = 3) END AS tried,
   CASE run WHEN 1 THEN (SELECT count(*) FROM try_v WHERE arrives = 1) WHEN 2 THEN (SELECT count(*) FROM try_v WHERE arrives <= 2 AND seq % 5 >= 3) ELSE 0 END AS failed FROM (SELECT unnest(range(1, 4)) AS run) r
 UNION ALL SELECT 'published', done, url, seq, 0 FROM end_v""")
def ext05_gate(t):
    """Three runs: all extractions fail, some fail, none fails; each tries the dead letters before it first."""
    root = scratch_path(t.spark, "published")
    rows = t.headlines().select("seq", "url", "title")
    # Copies of a URL arrive with its first one.  Every run reads the arrivals, which are written once.
    arrives = rows.groupBy("url").agg(F.min("seq").alias("_s")).select("url", (1 + c("_s") % 3).alias("arrives"))
    rows = materialise(rows.join(arrives, "url"), "arrivals")
    health = []
    for run in (1, 2, 3):
        todo = PB.pending(rows.filter(c("arrives") == run).drop("arrives"), root, run)
        fails = F.lit(True) if run == 1 else (c("seq") % 5 >= 3) if run == 2 else F.lit(False)
        health.append(PB.publish(todo.withColumn("extraction", F.when(~fails, F.struct(F.lit(True).alias("relevant")))), root, run, rows.drop("arrives").columns))
    told = reduce(DataFrame.unionAll, health).select(F.lit("health").alias("part"), c("run").cast("bigint").alias("run"), c("verdict").alias("what"), "tried", "failed")
    seen = PB.published(t.spark, root).select(F.lit("published").alias("part"), c("run").cast("bigint").alias("run"), c("url").alias("what"), c("seq").alias("tried"), F.lit(0).cast("bigint").alias("failed"))
    return told.unionAll(seen)


_STORY_SCORES = f"""{_STORY}, low_v AS (SELECT *, lower(text) AS low, {Q.fold('lower(text)')} AS folded FROM ent_v),
 cat_v AS (SELECT * EXCLUDE (category), {Q.category('low')} AS category, {Q.risk_level('folded')} AS risk_level FROM low_v),
 imp_v AS (SELECT *, {IMPORTANCE_SQL.format(cat='category', low='low', pos='pos', people='len(people)', orgs='len(orgs)')} AS importance FROM cat_v)"""


@query("ext03_fallback_extraction", f"""WITH {_STORY_SCORES}, {Q.off_topic_ctes('imp_v', 'seq, low, category, risk_level, importance, people, orgs', 'title', 'text')}
 SELECT seq, NOT {Q.has_any('low', V.VIOLENCE_STEMS)} AND topic IS NULL AS relevant, category,
  CASE category WHEN 'Government' THEN CASE WHEN contains(low, 'appoint') THEN 'Appointment' ELSE 'Policy' END
    WHEN 'Company' THEN CASE WHEN contains(low, 'merger') THEN 'Merger' ELSE 'Earnings' END ELSE 'Other' END AS event_type,
  CAST(floor(importance * 0.8) AS INTEGER) AS risk_score, risk_level, CAST(len(people) AS INTEGER) AS n_people, CAST(len(orgs) AS INTEGER) AS n_orgs,
  {Q.has_any('low', ['tender', 'procurement', 'contract'])} AS has_procurement FROM topic_v""")
def ext03(t):
    rows = stories(t)
    e = rows.select("seq", X.fallback_extraction(c("title"), c("text"), c("entities")).alias("e"))
    return e.select("seq", "e.relevant", "e.category", "e.event_type", "e.risk_score", "e.risk_level", F.size("e.people").alias("n_people"),
                    F.size("e.organizations").alias("n_orgs"), c("e.procurement").isNotNull().alias("has_procurement"))


@query("ext08_enrich", f"""WITH {_STORY_SCORES} SELECT seq, {Q.sentiment('low')} AS sentiment, risk_level, category, importance FROM imp_v""")
def ext08(t):
    rows = t.articles_v.withColumn("raw_text", story_text())
    return X.enrich(rows, english_only=False).select("seq", "sentiment", "risk_level", "category", "importance")


@query("ext08_stored_records", f"""WITH {_STORY_SCORES}, {_RELATIONS},
 en_v AS (SELECT * FROM (SELECT *, len(regexp_extract_all(folded, '\\b[a-z]+\\b')) AS words, len(regexp_extract_all(folded, {Q.words(V.ENGLISH_STOPWORDS)})) AS en FROM imp_v) x WHERE words > 0 AND en / words > 0.10),
 t_v AS (SELECT seq, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM low_v),
 n_v AS (SELECT seq, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM t_v GROUP BY 1, 2),
 vec_v AS (SELECT l.seq, list(coalesce(n, 0) ORDER BY i) AS v FROM low_v l CROSS JOIN (SELECT unnest(range(64)) AS i) r LEFT JOIN n_v ON n_v.seq = l.seq AND bucket = i GROUP BY 1),
 old_v AS (SELECT DISTINCT e.seq FROM vec_v e JOIN vec_v s ON s.seq % 50 = 0 AND e.seq % 50 <> 0 AND 1.0 - list_cosine_similarity(e.v, s.v) < {IG.REPEATS}),
 pred_v AS (SELECT seq, arg_min(predicate, sentence_no) AS p FROM relation_v GROUP BY seq)
 SELECT e.seq, e.url, {Q.sentiment('low')} AS sentiment, e.risk_level, e.category, e.importance AS importance_score, coalesce(upper(left(p, 1)) || substr(p, 2), 'Policy announcement') AS event_type, 64 AS dims
 FROM en_v e LEFT JOIN pred_v USING (seq) WHERE e.seq % 50 <> 0 AND e.seq NOT IN (SELECT seq FROM old_v)""")
def ext08_stored(t):
    """Records of the new articles; every fiftieth article is stored already, with its vector."""
    rows = t.articles_v.withColumn("raw_text", story_text())
    stored = X.hashed_embedding(IG.cleaned(rows.filter("seq % 50 = 0")), "seq", "cleaned_text")
    records = IG.store_records(rows.filter("seq % 50 <> 0"), stored)
    return records.select("seq", "url", "sentiment", "risk_level", "category", "importance_score", "event_type", F.size("vector_embedding").alias("dims"))


_LOWF = f"lower({FULL})"


@query("ext08_enrich_counts", f"""WITH f AS (SELECT seq, risk_score, {_LOWF} AS low, {Q.fold(_LOWF)} AS folded FROM articles_v),
 n AS (SELECT *, len(regexp_extract_all(folded, '\\b[a-z]+\\b')) AS words, len(regexp_extract_all(folded, {Q.words(V.ENGLISH_STOPWORDS)})) AS en FROM f)
 SELECT {Q.risk_level('folded')} AS risk_level, {Q.category('low')} AS category, {Q.sentiment('low')} AS sentiment, count(*) AS n,
   CAST(sum(risk_score) AS BIGINT) AS total_risk FROM n WHERE words > 0 AND en / nullif(words, 0) > 0.10 GROUP BY 1, 2, 3""")
def ext08_counts(t):
    """Flagship: gate, clean, score and count the whole article table."""
    rows = t.articles_v.select("risk_score", S.lowered(full_text()).alias("low"))
    low = c("low")
    scored = rows.filter(S.language_in(low) == "en").select(
        S.risk_in(low).alias("risk_level"), S.category_in(low).alias("category"), S.sentiment_in(low).alias("sentiment"), "risk_score")
    return scored.groupBy("risk_level", "category", "sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("total_risk"))


@query("ext09_embedding", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents),
 n AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2),
 s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM n GROUP BY 1),
 v AS (SELECT d.doc_id, i, coalesce(n.n / s.norm, 0) AS x FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS i) r LEFT JOIN n ON n.doc_id = d.doc_id AND n.bucket = i LEFT JOIN s ON s.doc_id = d.doc_id)
 SELECT doc_id, CAST(i AS INTEGER) AS i, round(x, 9) AS x FROM v""")
def ext09(t):
    return X.hashed_embedding(t.documents, "doc_id").select("doc_id", F.posexplode("embedding").alias("i", "x")).select("doc_id", "i", F.round("x", 9).alias("x"))
