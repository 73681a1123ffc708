"""Scoring extractions against a gold set, and checking the gold set itself."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ownerlens import vocab as V
from ownerlens.functions import scoring as S, text as T
from ownerlens.operators.keys import first_per_key, global_rank

c = F.col
STAKE_FIELDS = ("percentage", "direct_percentage", "indirect_percentage")
NUMERIC_TOLERANCE = 20
MIN_ARTICLE_CHARS = 200


def norm(value: Column) -> Column:
    return F.lower(T.squeeze(value.cast("string")))


def pair_keys(items: Column, first: str, second: str) -> Column:
    """Distinct normalised (first, second) keys of an array of structs."""
    keys = F.transform(items, lambda x: F.concat(norm(x[first]), F.lit("\u0001"), norm(x[second])))
    return F.array_distinct(F.coalesce(keys, F.array().cast("array<string>")))


def set_f1(gold: Column, pred: Column) -> Column:
    """F1 of two key sets; both empty is agreement."""
    hits, total = F.size(F.array_intersect(gold, pred)), F.size(gold) + F.size(pred)
    return F.when(total == 0, 1.0).otherwise(F.lit(2.0) * hits / total)


def fabricated_stakes(text: Column, holdings: Column) -> Column:
    """Stated percentages whose digits the article does not contain."""
    hay = norm(text)

    def wrong(h: Column) -> Column:
        fields = []
        for name in STAKE_FIELDS:
            digits = F.trim(F.replace(norm(h[name]), F.lit("%"), F.lit("")))
            bad = (digits != "") & ~F.contains(hay, digits)
            who = F.coalesce(T.non_empty(h["name"]), F.lit("unknown holder"))
            fields.append(F.when(bad, F.concat(who, F.lit(f": {name}="), h[name])))
        return F.array_compact(F.array(*fields))

    return F.flatten(F.transform(F.coalesce(holdings, F.array().cast(_HOLDINGS)), wrong))


def _holdings_type() -> str:
    from ownerlens import schemas

    return "array<" + schemas.HOLDING.simpleString() + ">"


_HOLDINGS = _holdings_type()


def publications(orgs: Column) -> Column:
    return F.filter(F.transform(orgs, lambda o: o["name"]), T.is_publication_or_furniture)


def leaked_holders(pred: Column) -> Column:
    """Holders that were also filed under people."""
    return F.array_sort(F.array_intersect(
        pair_keys(pred["people"], "name", "organization"), pair_keys(pred["significant_control"], "name", "organization")))


def features(pairs: DataFrame) -> DataFrame:
    """Per gold/prediction pair ``(title, article_text, gold, pred)`` everything the score needs."""
    g, p = c("gold"), c("pred")

    def f1(name: str, first: str, second: str) -> Column:
        return set_f1(pair_keys(g[name], first, second), pair_keys(p[name], first, second))

    return pairs.withColumns({
        "fabricated": fabricated_stakes(c("article_text"), p["significant_control"]),
        "publications": F.coalesce(publications(p["organizations"]), F.array().cast("array<string>")),
        "off_topic": S.off_topic(c("title"), p["summary"]),
        "gold_yes": F.coalesce(g["relevant"], F.lit(False)),
        "pred_yes": F.coalesce(p["relevant"], F.lit(False)),
        **{f"same_{n}": norm(g[n]) == norm(p[n]) for n in ("category", "event_type", "risk_level")},
        **{f"near_{n}": F.abs(F.coalesce(g[n], F.lit(0)) - F.coalesce(p[n], F.lit(0))) <= NUMERIC_TOLERANCE
           for n in ("risk_score", "importance_score")},
        "f1_holdings": f1("significant_control", "name", "organization"),
        "f1_organizations": f1("organizations", "name", "type"),
        "f1_people": f1("people", "name", "organization"),
        "leaked": leaked_holders(p),
    })


def _disqualified() -> Column:
    return (
        (F.size("fabricated") > 0) | (F.size("publications") > 0)
        | (c("pred_yes") & c("off_topic").isNotNull()) | (c("gold_yes") != c("pred_yes"))
    )


def score(pairs: DataFrame) -> DataFrame:
    """``score`` in [0, 1], rounded to four places.

    Fabricated figures, publications as parties, off-topic rows marked relevant
    and a wrong relevance score zero whatever else is right.
    """
    one = lambda cond: F.when(c(cond), 1.0).otherwise(0.0)
    leak = F.when(F.size("leaked") > 0, 1.0).otherwise(0.0)
    total = (
        one("same_category") + one("same_event_type") + one("same_risk_level")
        + one("near_risk_score") * 0.5 + one("near_importance_score") * 0.5
        + c("f1_holdings") * 3.0 + c("f1_organizations") * 1.5 + c("f1_people")
    )
    value = F.when(_disqualified(), 0.0).when(~c("gold_yes"), 1.0).otherwise(F.round(total / (F.lit(9.5) + leak), 4))
    return features(pairs).withColumn("score", value)


def feedback(pairs: DataFrame) -> DataFrame:
    """``feedback``: a sentence per broken rule, the disqualifying ones alone."""
    g, p = c("gold"), c("pred")

    def differs(name: str) -> Column:
        return F.when(~c(f"same_{name}"), F.concat(
            F.lit(f"{name} should be '"), F.coalesce(g[name], F.lit("")), F.lit("', not '"), F.coalesce(p[name], F.lit("")), F.lit("'")))

    def far(name: str) -> Column:
        return F.when(~c(f"near_{name}"), F.concat(
            F.lit(f"{name} of "), F.coalesce(p[name], F.lit(0)).cast("string"),
            F.lit(f" is more than {NUMERIC_TOLERANCE} points from "), F.coalesce(g[name], F.lit(0)).cast("string")))

    def low(name: str) -> Column:
        return F.when(c(f"f1_{name}") < 1.0, F.lit(f"{name} do not match the gold record"))

    notes = F.array_compact(F.array(
        differs("category"), differs("event_type"), differs("risk_level"), far("risk_score"), far("importance_score"),
        low("holdings"), low("organizations"), low("people"),
        F.when(F.size("leaked") > 0, F.lit("a holder of control is filed under people too"))))
    text = (
        F.when(F.size("fabricated") > 0, F.concat(F.lit("Percentages the article does not state: "), F.array_join("fabricated", "; ")))
        .when(F.size("publications") > 0, F.concat(F.lit("Publications listed as parties: "), F.array_join("publications", ", ")))
        .when(c("pred_yes") & c("off_topic").isNotNull(), F.concat(F.lit("Marked relevant but is "), c("off_topic.topic"), F.lit(" coverage")))
        .when(c("gold_yes") != c("pred_yes"), F.when(c("pred_yes"), "Should have been filtered out").otherwise("Should have been published"))
        .when(~c("gold_yes"), "Correctly not relevant")
        .when(F.size(notes) == 0, "Correct")
        .otherwise(F.concat(F.lit("Fix: "), F.array_join(notes, "; ")))
    )
    return score(pairs).withColumn("feedback", text)


def mean_scores(scored: DataFrame) -> DataFrame:
    """Mean score per program and split; no rows count as zero."""
    return scored.groupBy("program", "split").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def comparison(scored: DataFrame, split: str = "val") -> DataFrame:
    """Candidate against incumbent on one split, in one aggregate."""
    mean = lambda name: F.coalesce(F.avg(F.when(c("program") == name, c("score"))), F.lit(0.0))
    one = scored.filter(c("split") == split).agg(mean("incumbent").alias("incumbent"), mean("candidate").alias("candidate"))
    return one.withColumn("delta", c("candidate") - c("incumbent")).withColumn("improved", c("candidate") > c("incumbent"))


# ------------------------------------------------------------- gold set


def is_verified() -> Column:
    return T.strip(F.coalesce(c("verified_by"), F.lit(""))) != ""


def problems(gold: DataFrame) -> DataFrame:
    """One row per problem of a gold record (columns of the gold schema plus file, line_no)."""
    text = F.coalesce(c("article_text"), F.lit(""))
    done = is_verified()

    def enum(name: str, allowed: list[str]) -> Column:
        return F.when(done & c(name).isNotNull() & ~c(name).isin(allowed), F.concat(F.lit(f"{name}="), c(name), F.lit(" is not allowed")))

    def each(items: Column, lead: str) -> Column:
        filled = F.coalesce(items, F.array().cast("array<string>"))
        return F.transform(filled, lambda x: F.concat(F.lit(lead), F.coalesce(x, F.lit("(no name)"))))

    topic = S.off_topic(c("title"), c("summary"))
    whole = F.struct("people", "significant_control")
    single = F.array_compact(F.array(
        F.when(T.strip(text) == "", F.lit("article_text is empty"))
        .when(F.length(text) < MIN_ARTICLE_CHARS, F.concat(F.lit("article_text has only "), F.length(text).cast("string"), F.lit(" chars"))),
        enum("category", V.CATEGORIES), enum("event_type", V.EVENT_TYPES), enum("risk_level", V.RISK_LEVELS),
        F.when(done & c("relevant").isNull(), F.lit("relevant is null on a verified record")),
        F.when(F.coalesce(c("relevant"), F.lit(False)) & topic.isNotNull(), F.concat(F.lit("relevant but looks like "), topic["topic"])),
    ))
    found = F.concat(
        single,
        each(fabricated_stakes(c("article_text"), c("significant_control")), "not stated in the article: "),
        each(publications(c("organizations")), "publication as organization: "),
        each(F.transform(leaked_holders(whole), lambda k: F.substring_index(k, "\u0001", 1)), "in people and significant_control: "),
    )
    return gold.select("file", "line_no", F.explode(found).alias("problem"))


def gold_summary(gold: DataFrame, required: int = 0) -> DataFrame:
    """Records, verified, drafts, problems and whether the set may be used."""
    counts = gold.agg(F.count(F.lit(1)).alias("records"), F.count_if(is_verified()).alias("verified"))
    return counts.withColumns({
        "drafts": c("records") - c("verified"),
        "problems": problems(gold).agg(F.count(F.lit(1))).scalar(),
    }).withColumn("usable", (c("problems") == 0) & (c("verified") >= required))


def verified_only(gold: DataFrame) -> DataFrame:
    """Signed-off records without labelling aids (fields starting with ``_``)."""
    return gold.filter(is_verified()).drop(*[n for n in gold.columns if n.startswith("_")])


def split(examples: DataFrame, key: Column, val_fraction: float = 0.3, seed: int = 0) -> DataFrame:
    """Repeatable split by hashed key with at least one validation row.

    The position comes from a distributed rank, so the cut is exact without
    sorting everything in one place.
    """
    order = F.conv(F.left(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), F.lit(15)), 16, 10).cast("bigint")
    n = examples.agg(F.count(F.lit(1))).scalar()
    cut = F.greatest(F.lit(1), F.floor(n * val_fraction))
    return global_rank(examples, order, "_pos").withColumn("split", F.when(c("_pos") <= cut, "val").otherwise("train")).drop("_pos")


def drafts(corpus: DataFrame, gold: DataFrame, archive: DataFrame) -> DataFrame:
    """New blank gold records for captured inputs, with earlier output beside them as a hint.

    Keyed on URL, or title where there is none.
    """
    key = F.coalesce(T.non_empty(c("url")), c("title"))
    fresh = corpus.withColumn("key", key).filter((F.coalesce(c("key"), F.lit("")) != "") & (F.coalesce(c("article_text"), F.lit("")) != ""))
    fresh = first_per_key(fresh, ["key"]).join(gold.select(key.alias("key")).distinct(), "key", "left_anti")
    hints = first_per_key(archive.filter(T.non_empty(c("url")).isNotNull()).withColumn("_newest", -c("seq")), ["url"], ("_newest",)).select(
        c("url").alias("key"), F.struct("category", "risk_score", "summary").alias("_archive_hint"))
    null = F.lit(None)
    return fresh.join(hints, "key", "left").select(
        "seq", "title", "article_text", "url", "source", null.cast("boolean").alias("relevant"), null.cast("string").alias("category"),
        F.lit("").alias("summary"), null.cast("string").alias("verified_by"), null.cast("string").alias("verified_at"), "_archive_hint")
