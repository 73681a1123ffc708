"""Evaluation operators as registered queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ownerlens import schemas, vocab as V
from ownerlens.operators import evals as E
from ownerlens.plans import sqltext as Q
from ownerlens.plans.registry import query
from ownerlens.plans.text_queries import FURNITURE_SQL

c = F.col


def _s(prefix, m):
    return F.concat(F.lit(prefix), (c("seq") % m).cast("string"))


def _holding(name, org, pct):
    parts = {f.name: F.lit(None).cast("string") for f in schemas.HOLDING.fields}
    parts.update(name=name, organization=org, percentage=pct)
    return F.struct(*[v.alias(n) for n, v in parts.items()])


def _person(name, org):
    null = F.lit(None).cast("string")
    return F.struct(name.alias("name"), null.alias("position"), org.alias("organization"), null.alias("event"))


def pairs(t):
    """Gold and predicted extraction of every labelled document."""
    k = c("seq")
    rows = t.gold_pred_v.join(t.articles_v.select("seq", "title", "raw_text", "url"), "seq")
    none = {"h": F.array().cast(E._HOLDINGS), "p": F.array().cast("array<" + schemas.PERSON.simpleString() + ">")}
    holder, company = _s("Holder ", 90), _s("Company ", 50)
    pct = F.when(k % 10 == 0, "37.5%").when(k % 10 == 5, "60%")
    pred_name = F.when(k % 6 == 3, F.upper(F.concat(F.lit(" "), holder))).when(k % 6 == 4, F.lit("Someone Else")).otherwise(holder)
    gold_h = F.when(k % 3 != 2, F.array(_holding(holder, company, F.lit(None).cast("string")))).otherwise(none["h"])
    pred_h = F.when(k % 3 != 2, F.array(_holding(pred_name, company, pct))).otherwise(none["h"])
    org = lambda n, ty: F.struct(n.alias("name"), ty.alias("type"))
    gold_o = F.array(org(company, F.lit("company")))
    pred_o = F.when(k % 11 == 0, F.array(org(company, F.lit("company")), org(F.lit("The Guardian"), F.lit("company")))).when(
        k % 5 == 1, F.array(org(company, F.lit("company")), org(F.lit("Extra Ltd"), F.lit("company")))).otherwise(gold_o)
    person = _person(_s("Person ", 70), company)
    gold_p = F.when(k % 4 == 0, F.array(person)).otherwise(none["p"])
    pred_p = F.when(k % 7 == 0, F.array(person, _person(holder, company))).when(k % 8 == 4, none["p"]).otherwise(gold_p)

    def ex(rel, cat, risk, imp, summary, o, p, h):
        return F.struct(
            rel.alias("relevant"), cat.alias("category"), F.when(k % 9 == 0, "Audit").otherwise("Merger").alias("event_type"),
            risk.cast("int").alias("risk_score"), F.lit("Low").alias("risk_level"), imp.cast("int").alias("importance_score"),
            summary.alias("summary"), o.alias("organizations"), p.alias("people"), h.alias("significant_control"),
            F.lit(None).cast(schemas.PROCUREMENT).alias("procurement"))

    return rows.select(
        "seq", "title", "url", F.concat(c("raw_text"), F.lit(" It holds 60% of shares.")).alias("article_text"), "verified_by",
        ex(c("gold_relevant"), c("gold_category"), c("gold_risk"), k % 101, F.lit(""), gold_o, gold_p, gold_h).alias("gold"),
        ex(c("pred_relevant"), c("pred_category"), c("pred_risk"), (k * 3) % 101, F.lit(""), pred_o, pred_p, pred_h).alias("pred"))




def _norm_sql(x):
    return f"lower({Q.squeeze(x)})"


_H, _C = "concat('Holder ', CAST(seq % 90 AS STRING))", "concat('Company ', CAST(seq % 50 AS STRING))"
_PER = "concat('Person ', CAST(seq % 70 AS STRING))"


def _key(a, b):
    return f"lower(trim(concat({a}, ''))) || chr(1) || lower(trim({b}))"


PAIRS_SQL = f"""
 base_v AS (SELECT g.*, a.title, a.url, concat(a.raw_text, ' It holds 60% of shares.') AS article_text FROM gold_pred_v g JOIN articles_v a USING (seq)),
 keys_v AS (SELECT *, CASE WHEN seq % 3 <> 2 THEN [{_key(_H, _C)}] ELSE [] END AS gh,
   CASE WHEN seq % 3 = 2 THEN [] WHEN seq % 6 = 4 THEN [{_key("'Someone Else'", _C)}] ELSE [{_key(_H, _C)}] END AS ph,
   [{_key(_C, "'company'")}] AS go, CASE WHEN seq % 11 = 0 THEN [{_key(_C, "'company'")}, {_key("'The Guardian'", "'company'")}]
     WHEN seq % 5 = 1 THEN [{_key(_C, "'company'")}, {_key("'Extra Ltd'", "'company'")}] ELSE [{_key(_C, "'company'")}] END AS po,
   CASE WHEN seq % 4 = 0 THEN [{_key(_PER, _C)}] ELSE [] END AS gp,
   CASE WHEN seq % 7 = 0 THEN [{_key(_PER, _C)}, {_key(_H, _C)}] WHEN seq % 8 = 4 THEN [] WHEN seq % 4 = 0 THEN [{_key(_PER, _C)}] ELSE [] END AS pp,
   CASE WHEN seq % 3 <> 2 AND seq % 10 = 0 THEN '37.5' WHEN seq % 3 <> 2 AND seq % 10 = 5 THEN '60' END AS digits FROM base_v),
 feat_v AS (SELECT *, digits IS NOT NULL AND NOT contains({_norm_sql('article_text')}, digits) AS fabricated, seq % 11 = 0 AS publication,
   len(list_intersect(pp, ph)) > 0 AS leaked FROM keys_v)"""


def _f1(g, p):
    return f"CASE WHEN len({g}) + len({p}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({g}, {p}))::DOUBLE / (len({g}) + len({p})) END"


_SCORES = f"""{PAIRS_SQL}, {Q.off_topic_ctes('feat_v', '*', 'title', "''")},
 f1_v AS (SELECT *, {_f1('gh', 'ph')} AS f1_holdings, {_f1('go', 'po')} AS f1_organizations, {_f1('gp', 'pp')} AS f1_people FROM topic_v),
 score_v AS (SELECT *, CASE WHEN fabricated OR publication OR (pred_relevant AND topic IS NOT NULL) OR gold_relevant <> pred_relevant THEN 0.0::DOUBLE
   WHEN NOT gold_relevant THEN 1.0::DOUBLE ELSE round((CASE WHEN gold_category = pred_category THEN 1.0 ELSE 0.0 END + 2.0
     + CASE WHEN abs(gold_risk - pred_risk) <= 20 THEN 0.5 ELSE 0.0 END + CASE WHEN abs(seq % 101 - (seq * 3) % 101) <= 20 THEN 0.5 ELSE 0.0 END
     + f1_holdings * 3.0::DOUBLE + f1_organizations * 1.5::DOUBLE + f1_people)::DOUBLE / (9.5 + CASE WHEN leaked THEN 1.0 ELSE 0.0 END), 4) END AS score FROM f1_v)"""


@query("agg14_set_f1", f"""WITH {PAIRS_SQL} SELECT seq, round({_f1('gh', 'ph')}, 6)::DOUBLE AS f1_holdings, round({_f1('go', 'po')}, 6)::DOUBLE AS f1_organizations, round({_f1('gp', 'pp')}, 6)::DOUBLE AS f1_people FROM feat_v""")
def agg14(t):
    f = E.features(pairs(t))
    return f.select("seq", *[F.round(n, 6).alias(n) for n in ("f1_holdings", "f1_organizations", "f1_people")])


@query("agg15_extraction_score", f"WITH {_SCORES} SELECT seq, score FROM score_v")
def agg15(t):
    return E.score(pairs(t)).select("seq", "score")


@query("ev01_fabricated", f"WITH {PAIRS_SQL} SELECT seq FROM feat_v WHERE fabricated")
def ev01(t):
    return E.features(pairs(t)).filter(F.size("fabricated") > 0).select("seq")


_WHO = f"CASE WHEN seq % 6 = 3 THEN upper(concat(' ', {_H})) WHEN seq % 6 = 4 THEN 'Someone Else' ELSE {_H} END"
_NOTES = """list_filter([CASE WHEN gold_category <> pred_category THEN concat('category should be ''', gold_category, ''', not ''', pred_category, '''') END,
   CASE WHEN abs(gold_risk - pred_risk) > 20 THEN concat('risk_score of ', pred_risk, ' is more than 20 points from ', gold_risk) END,
   CASE WHEN abs(seq % 101 - (seq * 3) % 101) > 20 THEN concat('importance_score of ', (seq * 3) % 101, ' is more than 20 points from ', seq % 101) END,
   CASE WHEN f1_holdings < 1 THEN 'holdings do not match the gold record' END, CASE WHEN f1_organizations < 1 THEN 'organizations do not match the gold record' END,
   CASE WHEN f1_people < 1 THEN 'people do not match the gold record' END, CASE WHEN leaked THEN 'a holder of control is filed under people too' END], lambda x: x IS NOT NULL)"""


@query("ev05_feedback", f"""WITH {_SCORES} SELECT seq, score, CASE WHEN fabricated THEN concat('Percentages the article does not state: ', {_WHO}, ': percentage=', digits, '%')
   WHEN publication THEN 'Publications listed as parties: The Guardian' WHEN pred_relevant AND topic IS NOT NULL THEN concat('Marked relevant but is ', topic, ' coverage')
   WHEN gold_relevant <> pred_relevant THEN CASE WHEN pred_relevant THEN 'Should have been filtered out' ELSE 'Should have been published' END
   WHEN NOT gold_relevant THEN 'Correctly not relevant' WHEN len({_NOTES}) = 0 THEN 'Correct' ELSE concat('Fix: ', array_to_string({_NOTES}, '; ')) END AS feedback FROM score_v""")
def ev05(t):
    return E.feedback(pairs(t)).select("seq", "score", "feedback")


@query("jn14_leaked_holders", f"WITH {PAIRS_SQL} SELECT seq, replace(unnest(list_intersect(pp, ph)), chr(1), '|') AS leaked FROM feat_v")
def jn14(t):
    return E.features(pairs(t)).select("seq", F.explode("leaked").alias("k")).select("seq", F.replace("k", F.lit("\u0001"), F.lit("|")).alias("leaked"))


@query("set03_intersect", f"""WITH {PAIRS_SQL} SELECT DISTINCT replace(k, chr(1), '|') AS party FROM (SELECT unnest(ph) AS k FROM feat_v) a
  WHERE k IN (SELECT unnest(pp) FROM feat_v)""")
def set03(t):
    rows = pairs(t)
    held = rows.select(F.explode(E.pair_keys(c("pred.significant_control"), "name", "organization")).alias("k"))
    people = rows.select(F.explode(E.pair_keys(c("pred.people"), "name", "organization")).alias("k"))
    return held.intersect(people).select(F.replace("k", F.lit("\u0001"), F.lit("|")).alias("party"))


_ORDER = "CAST(concat('0x', left(md5(concat(CAST(seq AS STRING), '#0')), 15)) AS BIGINT)"
_SPLIT = f"""pos_v AS (SELECT seq, row_number() OVER (ORDER BY {_ORDER}) AS pos, count(*) OVER () AS n FROM gold_pred_v),
 split_v AS (SELECT seq, CASE WHEN pos <= greatest(1, floor(n * 0.3)) THEN 'val' ELSE 'train' END AS split FROM pos_v)"""


@query("win12_split", f"WITH {_SPLIT} SELECT seq, split FROM split_v")
def win12(t):
    return E.split(t.gold_pred_v, c("seq")).select("seq", "split")


def programs(t):
    """The same examples answered by two programs, with their split."""
    splits = E.split(t.gold_pred_v.select("seq"), c("seq"))
    answer = lambda name, pred: F.struct(F.lit(name).alias("program"), pred.alias("pred"))
    answers = F.array(answer("candidate", c("pred")), answer("incumbent", c("pred").withField("category", F.lit("Other"))))
    rows = pairs(t).withColumn("answer", F.explode(answers)).withColumns({"program": c("answer.program"), "pred": c("answer.pred")})
    both = E.score(rows).select("seq", "score", "program")
    return both.join(splits, "seq")


_WEAK = _SCORES[_SCORES.index("score_v AS"):].replace("score_v", "weak_v").replace("gold_category = pred_category", "gold_category = 'Other'")
_PROGRAMS = f"{_SCORES}, {_WEAK}, {_SPLIT}, prog_v AS (SELECT seq, 'candidate' AS program, score FROM score_v UNION ALL SELECT seq, 'incumbent', score FROM weak_v)"


@query("agg16_mean_score", f"WITH {_PROGRAMS} SELECT program, split, round(avg(score), 6) AS mean_score, count(*) AS n FROM prog_v JOIN split_v USING (seq) GROUP BY 1, 2")
def agg16(t):
    return E.mean_scores(programs(t)).withColumn("mean_score", F.round("mean_score", 6))


@query("agg17_comparison", f"""WITH {_PROGRAMS}, m AS (SELECT avg(score) FILTER (program = 'incumbent') AS i, avg(score) FILTER (program = 'candidate') AS k FROM prog_v JOIN split_v USING (seq) WHERE split = 'val')
 SELECT round(i, 6) AS incumbent, round(k, 6) AS candidate, round(k - i, 6) AS delta, k > i AS improved FROM m""")
def agg17(t):
    one = E.comparison(programs(t))
    return one.select(*[F.round(n, 6).alias(n) for n in ("incumbent", "candidate", "delta")], "improved")


def gold_file(t):
    """Predictions read as a gold file with its faults."""
    k = c("seq")
    rows = pairs(t).select("seq", "title", "article_text", "url", "verified_by", "pred.*")
    return rows.withColumns({
        "file": F.lit("gold.jsonl"), "line_no": k,
        "article_text": F.when(k % 17 == 0, "").when(k % 17 == 1, F.left(c("article_text"), F.lit(50))).otherwise(c("article_text")),
        "event_type": F.when(k % 13 == 0, "Gossip").otherwise(c("event_type")),
        "relevant": F.when(k % 19 != 0, c("relevant")), "_archive_hint": c("title")})


_GOLD = f"""{PAIRS_SQL}, gf_v AS (SELECT *, CASE WHEN seq % 17 = 0 THEN '' WHEN seq % 17 = 1 THEN left(article_text, 50) ELSE article_text END AS txt,
   CASE WHEN seq % 19 <> 0 THEN pred_relevant END AS rel FROM feat_v), {Q.off_topic_ctes('gf_v', '*', 'title', "''")},
 prob_v AS (SELECT seq, 'article_text is empty' AS problem FROM topic_v WHERE trim(txt) = ''
  UNION ALL SELECT seq, concat('article_text has only ', CAST(length(txt) AS STRING), ' chars') FROM topic_v WHERE trim(txt) <> '' AND length(txt) < 200
  UNION ALL SELECT seq, 'event_type=Gossip is not allowed' FROM topic_v WHERE seq % 13 = 0 AND verified_by IS NOT NULL
  UNION ALL SELECT seq, 'relevant is null on a verified record' FROM topic_v WHERE rel IS NULL AND verified_by IS NOT NULL
  UNION ALL SELECT seq, concat('relevant but looks like ', topic) FROM topic_v WHERE rel AND topic IS NOT NULL
  UNION ALL SELECT seq, concat('not stated in the article: ', CASE WHEN seq % 6 = 3 THEN upper(concat(' ', {_H})) WHEN seq % 6 = 4 THEN 'Someone Else' ELSE {_H} END, ': percentage=', digits, '%') FROM topic_v
    WHERE digits IS NOT NULL AND NOT contains({_norm_sql('txt')}, digits)
  UNION ALL SELECT seq, 'publication as organization: The Guardian' FROM topic_v WHERE publication
  UNION ALL SELECT seq, concat('in people and significant_control: ', split_part(unnest(list_intersect(pp, ph)), chr(1), 1)) FROM topic_v)"""


@query("ev02_gold_problems", f"WITH {_GOLD} SELECT seq AS line_no, problem FROM prob_v")
def ev02(t):
    return E.problems(gold_file(t)).select("line_no", "problem")


@query("agg18_gold_summary", f"""WITH {_GOLD} SELECT count(*) AS records, count(verified_by) AS verified, count(*) - count(verified_by) AS drafts,
  (SELECT count(*) FROM prob_v) AS problems, (SELECT count(*) FROM prob_v) = 0 AND count(verified_by) >= 10 AS usable FROM topic_v""")
def agg18(t):
    return E.gold_summary(gold_file(t), required=10)


@query("ev03_verified_only", "SELECT seq, verified_by FROM gold_pred_v JOIN articles_v USING (seq) WHERE verified_by IS NOT NULL")
def ev03(t):
    kept = E.verified_only(gold_file(t))
    assert "_archive_hint" not in kept.columns
    return kept.select("seq", "verified_by")


def _drafts(t):
    corpus = t.articles_v.select("seq", "title", c("raw_text").alias("article_text"), F.when(c("seq") % 9 != 0, c("url")).otherwise("").alias("url"), "source")
    gold = t.gold_pred_v.select("seq").join(t.articles_v, "seq").select("url", "title")
    archive = t.articles_v.filter("seq % 2 = 0").select("seq", "url", "category", "risk_score", c("raw_text").alias("summary"))
    return E.drafts(corpus, gold, archive)


_DRAFTS = """corp_v AS (SELECT seq, title, raw_text, CASE WHEN seq % 9 <> 0 THEN url ELSE '' END AS url, source FROM articles_v),
 gold_v AS (SELECT coalesce(nullif(a.url, ''), a.title) AS key FROM gold_pred_v g JOIN articles_v a USING (seq)),
 fresh_v AS (SELECT *, coalesce(nullif(url, ''), title) AS key FROM corp_v WHERE coalesce(nullif(url, ''), title) <> '' AND raw_text <> ''
   QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(url, ''), title) ORDER BY seq) = 1),
 hint_v AS (SELECT url AS key, category, risk_score FROM articles_v WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1)"""


@query("jn12_gold_drafts", f"""WITH {_DRAFTS} SELECT f.seq, f.url, h.category AS hint_category, h.risk_score AS hint_risk FROM fresh_v f LEFT JOIN hint_v h USING (key)
  WHERE key NOT IN (SELECT key FROM gold_v)""")
def jn12(t):
    return _drafts(t).select("seq", "url", c("_archive_hint.category").alias("hint_category"), c("_archive_hint.risk_score").alias("hint_risk"))


@query("ev04_blank_answers", f"""WITH {_DRAFTS} SELECT f.seq, CAST(NULL AS BOOLEAN) AS relevant, CAST(NULL AS STRING) AS category, '' AS summary, CAST(NULL AS STRING) AS verified_by
  FROM fresh_v f WHERE key NOT IN (SELECT key FROM gold_v)""")
def ev04(t):
    return _drafts(t).select("seq", "relevant", "category", "summary", "verified_by")
