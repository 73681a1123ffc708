"""Article scoring: language, sentiment, risk, category, importance, summaries."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ownerlens import vocab as V
from ownerlens.functions import text as T


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


# Every score has a form over text lower-cased already (``*_in``), so a chain of
# scores lower-cases a text once; the plain form does it itself.


def language_in(low: Column) -> Column:
    words = F.regexp_count(low, F.lit(T.WORD_START + "[a-z]++" + T.WORD_END))
    english = F.regexp_count(low, F.lit(T.whole_words(V.ENGLISH_STOPWORDS)))
    return T.let(F.struct(words.alias("n"), english.alias("en")), lambda x: (
        F.when(x["n"] == 0, "unknown").when(x["en"] / F.nullif(x["n"], F.lit(0)) > 0.10, "en").otherwise("other")))


def detect_language(text: Column) -> Column:
    return T.let(lowered(text), language_in)


def sentiment_in(low: Column) -> Column:
    margin = T.count_substrings(low, V.POSITIVE_STEMS) - T.count_substrings(low, V.NEGATIVE_STEMS)
    return T.let(margin, lambda m: F.when(m > 1, "Positive").when(m < -1, "Negative").otherwise("Neutral"))


def sentiment(text: Column) -> Column:
    return T.let(lowered(text), sentiment_in)


def risk_in(low: Column) -> Column:
    out = F.lit(None).cast("string")
    for tier in reversed(list(V.RISK_TIERS)):
        out = F.when(T.has_word(low, V.RISK_TIERS[tier], plural=True), tier).otherwise(out)
    return F.coalesce(out, F.lit("Low"))


def risk_level(text: Column) -> Column:
    return T.let(lowered(text), risk_in)


def category_in(low: Column) -> Column:
    """Strict maximum of three vocabularies, else a person's title, else General."""
    n = {name: T.count_substrings(low, words) for name, words in V.CATEGORY_WORDS.items()}

    def leader(n: Column) -> Column:
        g, b, l = n["Government"], n["Company"], n["Legal"]
        return (
            F.when((g > b) & (g > l), "Government")
            .when((b > g) & (b > l), "Company")
            .when((l > g) & (l > b), "Legal")
        )

    chosen = T.let(F.struct(*[count.alias(name) for name, count in n.items()]), leader)
    return F.coalesce(
        chosen, F.when(T.has_any(low, V.PERSON_TITLE_WORDS), F.lit("Person")), F.lit("General")
    )


def category(text: Column) -> Column:
    return T.let(lowered(text), category_in)


def importance(text: Column, positions: Column, n_people: Column, n_orgs: Column, cat: Column) -> Column:
    """0–100 from government level, seniority, size of cast and event words."""
    return T.let(lowered(text), lambda low: importance_in(low, positions, n_people, n_orgs, cat))


def importance_in(low: Column, positions: Column, n_people: Column, n_orgs: Column, cat: Column) -> Column:
    senior = F.arrays_overlap(
        F.transform(positions, F.lower), F.array(*[F.lit(t.lower()) for t in V.SENIOR_TITLES])
    )
    gov = cat == "Government"
    score = (
        F.lit(30.0)
        + F.when(gov, 15.0).otherwise(0.0)
        + F.when(gov & T.has_any(low, V.GOVERNMENT_LEVEL_WORDS), 15.0).otherwise(0.0)
        + F.when(F.coalesce(senior, F.lit(False)), 15.0).otherwise(0.0)
        + F.least(n_people * 2.0, F.lit(10.0))
        + F.least(n_orgs * 3.0, F.lit(15.0))
        + F.when(T.has_any(low, V.BREAKING_WORDS), 10.0).otherwise(0.0)
    )
    return F.when(low == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def sentences(text: Column) -> Column:
    parts = F.split(T.strip(F.coalesce(text, F.lit(""))), r"(?U)(?<=[.!?])\s+")
    return F.filter(parts, lambda s: s != "")


_DATE_WORDS = (
    T.WORD_START + r"(?:(?:19|20)\d{2}|" + T.any_of([w.lower() for w in V.MONTH_WORDS + V.DAY_WORDS]) + ")" + T.WORD_END
)


def summaries(title: Column, text: Column, *names: str) -> Column:
    """STRUCT of four extractive summaries, or of the named ones; only the timeline looks at every sentence."""

    def build(s: Column) -> Column:
        dated = F.slice(F.filter(s, lambda x: F.rlike(F.lower(x), F.lit(_DATE_WORDS))), 1, 3)
        chosen = T.let(dated, lambda d: F.when(F.size(d) > 0, d).otherwise(F.slice(s, 1, 3)))
        some = F.size(s) > 0
        made = {
            "one_line": F.when(some, F.left(F.get(s, F.lit(0)), F.lit(200))).otherwise(title),
            "executive": F.array_join(F.slice(s, 1, 2), " "),
            "detailed": F.array_join(F.slice(s, 1, 5), " "),
            "timeline": F.when(some, F.concat(F.lit(" \n- "), F.array_join(chosen, " \n- "))).otherwise(""),
        }
        return F.struct(*[made[n].alias(n) for n in names or made])

    return T.let(sentences(text), build)


def risk_bucket(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0))
    out = F.lit("Low")
    for floor, name in reversed(V.RISK_FLOORS):
        out = F.when(s >= floor, name).otherwise(out)
    return out


def off_topic(title: Column, summary: Column) -> Column:
    """NULL when in scope, else STRUCT<topic, matched>.

    Structural ownership words win outright; a deal verb counts only beside a
    percentage; a scoreline corroborates sport, or stands with a result verb.
    """
    raw = F.concat_ws(" ", title, summary)
    return T.let(F.lower(F.replace(raw, F.lit("’"), F.lit("'"))), off_topic_in)


_SPORT, _FUN = T.whole_words(V.SPORT_TERMS), T.whole_words(V.ENTERTAINMENT_TERMS)


def off_topic_in(t: Column) -> Column:
    """:func:`off_topic` over normalised text."""
    owned = F.rlike(t, F.lit(T.whole_words(V.OWNERSHIP_STRONG_TERMS))) | (T.has_word(t, V.OWNERSHIP_WEAK_TERMS) & F.rlike(t, F.lit("(?U)" + V.PERCENTAGE_PATTERN)))
    sport, fun = F.rlike(t, F.lit(_SPORT)), F.rlike(t, F.lit(_FUN))
    # A scoreline alone decides nothing, and digits are rarer than verbs of result.
    score = F.rlike(t, F.lit("(?U)" + V.SCORELINE_PATTERN))
    verb = T.has_word(t, V.RESULT_VERBS)

    def matched(pattern: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))

    line = F.when(score, F.array(F.lit("scoreline"))).otherwise(F.array().cast("array<string>"))
    reason = (
        F.when(
            sport,
            F.struct(F.lit("sport").alias("topic"), F.array_sort(F.array_union(matched(_SPORT), line)).alias("matched")),
        )
        .when(
            score & verb,
            F.struct(
                F.lit("sport").alias("topic"),
                F.array(F.lit("result verb"), F.lit("scoreline")).alias("matched"),
            ),
        )
        .when(fun, F.struct(F.lit("entertainment").alias("topic"), F.array_sort(matched(_FUN)).alias("matched")))
    )
    # Most texts are on neither topic, so ownership is asked for last.
    return T.let(reason, lambda r: F.when(r.isNotNull() & ~owned, r))


def is_off_topic(title: Column, summary: Column | None = None) -> Column:
    other = F.lit(None).cast("string") if summary is None else summary
    return off_topic(title, other).isNotNull()


def topics(text: Column) -> Column:
    """Search topics whose terms occur in the text."""
    return T.let(lowered(text), topics_in)


def topics_in(low: Column) -> Column:
    tags = [
        F.when(F.rlike(low, F.lit(T.whole_words([w.lower() for w in words]))), name)
        for name, words in V.SEARCH_TOPICS.items()
    ]
    return F.array_compact(F.array(*tags))


def mentions_country(url: Column, title: Column, text: Column) -> Column:
    """The country gate: outlet domains, place and agency names, whole-word acronyms."""
    def in_text(t: Column) -> Column:
        whole = [F.contains(t, F.lit(w)) & F.rlike(t, F.lit(T.whole_words([w]))) for w in V.COUNTRY_WHOLE_WORDS]
        out = T.has_any(t, V.COUNTRY_TEXT_MARKERS)
        for hit in whole:
            out = out | hit
        return out

    in_url = T.let(F.lower(F.coalesce(url, F.lit(""))), lambda u: T.has_any(u, V.COUNTRY_URL_MARKERS))
    return in_url | T.let(F.lower(F.concat_ws("\n", title, text)), in_text)
