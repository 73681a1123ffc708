"""Ownership register: de-duplication, red flags, portfolio figures, listings."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ownerlens import vocab as V
from ownerlens.functions import holdings as H, text as T
from ownerlens.operators.keys import first_per_key, zero_filled

c = F.col


def identity() -> list[Column]:
    """What makes a disclosure the same as another."""
    return [F.lower(F.trim(F.coalesce(c(k).cast("string"), F.lit("")))) for k in V.PSC_IDENTITY]


def deduplicate(records: DataFrame, order: str = "seq") -> DataFrame:
    """One row per disclosure; the same holding on a later date is a new one."""
    return first_per_key(records, identity(), (order,))


def parsed(records: DataFrame) -> DataFrame:
    """Stakes as numbers, parties as keys; computed once and used by every rule."""
    stored = c("share_band") if "share_band" in records.columns else F.lit(None).cast("string")
    return records.withColumns({
        "pct": H.to_percent(c("percentage")),
        "direct": H.to_percent(c("direct_pct")),
        "indirect": H.to_percent(c("indirect_pct")),
        "voting": H.to_percent(c("voting_pct")),
        "person_key": H.party_key(c("person_name")),
        "company_key": H.party_key(c("company")),
        "is_direct": H.is_direct_holding(c("vehicle")),
        "band": H.band_for(stored, c("percentage")),
    })


def parked() -> Column:
    return (c("pct") >= V.SUB_THRESHOLD_FLOOR) & (c("pct") < V.SUB_THRESHOLD_CEILING)


def companies_per_holder(rows: DataFrame) -> DataFrame:
    """Distinct companies of each holder: companies, not rows."""
    named = rows.filter((c("person_key") != "") & (c("company_key") != ""))
    return named.groupBy("person_key").agg(F.count_distinct("company_key").alias("n_companies"))


def parked_per_company(rows: DataFrame) -> DataFrame:
    return rows.filter(parked() & (c("company_key") != "")).groupBy("company_key").agg(
        F.count(F.lit(1)).alias("n_parked"))


def with_context(records: DataFrame) -> DataFrame:
    """Records with the two counts the cross-row rules need.

    Both sides joined in hold one partially aggregated row per key, and only
    keys that can fire; AQE splits the record side where a key is hot.
    """
    rows = parsed(records)
    many = companies_per_holder(rows).filter(c("n_companies") >= 2)
    crowded = parked_per_company(rows).filter(c("n_parked") >= 2)
    return rows.join(many, "person_key", "left").join(crowded, "company_key", "left")


def _equity() -> Column:
    both = F.coalesce(c("direct"), F.lit(0.0)) + F.coalesce(c("indirect"), F.lit(0.0))
    return F.when(c("direct").isNull() & c("indirect").isNull(), c("pct")).otherwise(both)


def secrecy_term() -> Column:
    """First listed jurisdiction named in a non-direct vehicle."""
    low = F.lower(c("vehicle"))
    first = F.coalesce(*[F.when(F.contains(low, F.lit(t)), t) for t in V.SECRECY_JURISDICTIONS])
    return F.when(~c("is_direct"), first)


def _fixed(value: Column) -> Column:
    return T.fixed1(value, ties_up=True)


def rule_details() -> dict[str, Column]:
    """Per rule the detail text, NULL when it does not fire; in rule order."""
    gap = c("voting") - _equity()
    papers = F.concat_ws(" ", F.lower(F.coalesce(c("vehicle"), F.lit(""))),
                         F.lower(F.coalesce(c("previous_holder"), F.lit(""))))
    change = F.lower(F.coalesce(c("change_type"), F.lit("")))
    replaced = T.strip(F.coalesce(c("previous_holder"), F.lit(""))) != ""
    term = secrecy_term()
    return {
        "R1_SUB_THRESHOLD": F.when(
            parked() & (c("n_parked") >= 2),
            F.concat(c("n_parked").cast("string"), F.lit(
                V.DETAIL_PARKED))),
        "R3_VOTING_MISMATCH": F.when(
            gap >= V.VOTING_GAP_POINTS,
            F.concat(F.lit("Voting rights of "), _fixed(c("voting")), F.lit("% against an equity interest of "),
                     _fixed(_equity()), F.lit("% — a "), _fixed(gap), F.lit(V.DETAIL_GAP))),
        "R7_SECRECY_VEHICLE": F.when(
            term.isNotNull(), F.concat(F.lit(V.DETAIL_SECRECY[0]), term, F.lit(V.DETAIL_SECRECY[1]))),
        "R4_NOMINEE": F.when(T.has_any(papers, V.NOMINEE_MARKERS), F.lit(V.DETAIL_NOMINEE)),
        "R9_PEP": F.when(F.startswith(F.lower(c("pep_status")), F.lit("yes")), F.lit(V.DETAIL_PEP)),
        "R8_RAPID_CHANGE": F.when(
            (F.contains(change, F.lit("increas")) | F.contains(change, F.lit("acquir"))) & replaced,
            F.concat(F.lit(V.DETAIL_CHANGE[0]), c("previous_holder"), F.lit(V.DETAIL_CHANGE[1]))),
        "R12_CROSS_ENTITY": F.when(
            c("n_companies") >= 2,
            F.concat(F.lit(V.DETAIL_PORTFOLIO[0]), c("n_companies").cast("string"), F.lit(V.DETAIL_PORTFOLIO[1]))),
        "R6_UNKNOWN_OWNER": F.when(
            c("pct").isNull() & (T.strip(F.coalesce(c("nature_of_control"), F.lit(""))) == ""),
            F.lit(V.DETAIL_UNKNOWN)),
    }


CROSS_ROW_RULES = {"R1_SUB_THRESHOLD", "R12_CROSS_ENTITY"}


def rule_hits(records: DataFrame, rule: str) -> DataFrame:
    """Records one rule fires on, with its detail text.

    Rules about a single row are a plain filter; only two need other rows.
    """
    if rule in CROSS_ROW_RULES:
        rows = with_context(records)
    else:
        unknown = F.lit(None).cast("bigint")
        rows = parsed(records).withColumns({"n_companies": unknown, "n_parked": unknown})
    return rows.withColumn("detail", rule_details()[rule]).filter(c("detail").isNotNull())


def annotate(records: DataFrame) -> DataFrame:
    """Records with band and ``flags``: high severity first, rule order within."""
    details = rule_details()

    def flags(severity: str) -> Column:
        return F.filter(
            F.array(*[
                F.struct(F.lit(rule).alias("id"), F.lit(sev).alias("severity"), F.lit(title).alias("title"),
                         details[rule].alias("detail"))
                for rule, (sev, title) in V.FLAG_TITLES.items() if sev == severity
            ]),
            lambda f: f["detail"].isNotNull(),
        )

    return (
        with_context(records)
        .withColumn("_high", flags("high"))
        .withColumn("_medium", flags("medium"))
        .withColumn("n_high", F.size("_high"))
        .withColumn("flags", F.concat("_high", "_medium"))
        .withColumn("n_flags", F.size("flags"))
        .drop("_high", "_medium")
    )


FILTERS: dict[str, Callable[[], Column]] = {
    "all": lambda: F.lit(True),
    "flagged": lambda: c("n_flags") > 0,
    "majority": lambda: c("pct") >= 75,
    "low_band": lambda: (c("pct") >= 5) & (c("pct") < 25),
    "indirect": lambda: ~c("is_direct"),
    "pep": lambda: F.startswith(F.lower(F.coalesce(c("pep_status"), F.lit(""))), F.lit("yes")),
    "cross_entity": lambda: c("n_companies") >= 2,
}


def filter_register(annotated: DataFrame, name: str) -> DataFrame:
    return annotated.filter(F.coalesce(FILTERS[name](), F.lit(False)))


def search_register(rows: DataFrame, text: str) -> DataFrame:
    columns = [n for n in ("person_name", "company", "vehicle", "nature_of_control", "board_role", "filing_ref")
               if n in rows.columns]
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c(n), F.lit("")) for n in columns]))
    return rows.filter(F.contains(hay, F.lit(text.strip().lower())))


def ranked_register(annotated: DataFrame) -> DataFrame:
    """Worst first; arrival order breaks ties."""
    return annotated.orderBy(c("n_high").desc(), c("n_flags").desc(), "seq")


def summarise(records: DataFrame) -> DataFrame:
    """Portfolio figures, one row, from one annotated pass."""
    n = F.count(F.lit(1))
    cited = F.count_if(T.strip(F.coalesce(c("filing_ref"), F.lit(""))) != "")
    seeded = F.count_if(F.lower(c("source")) == "seed")
    return annotate(records).agg(
        n.alias("total"),
        F.avg("pct").alias("mean_stake"),
        F.count_if(~c("is_direct")).alias("indirect"),
        F.count_if(c("n_flags") > 0).alias("flagged"),
        F.count_if(c("n_high") > 0).alias("high_severity"),
        F.count_if(c("band") == "BAND_5_25").alias("low_band"),
        (cited / F.nullif(n, F.lit(0))).alias("disclosure_rate"),
        seeded.alias("seeded"),
        (seeded > 0).alias("is_demo"),
    )


def band_histogram(records: DataFrame) -> DataFrame:
    counts = (
        records.groupBy(F.coalesce(T.non_empty(H.share_band(c("percentage"))), F.lit("UNDISCLOSED")).alias("band"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return zero_filled(counts, "band", [*V.BAND_IDS, "UNDISCLOSED"])


def holder_pairs(records: DataFrame) -> DataFrame:
    """Distinct (holder, company) pairs: the index in both directions, as rows.

    Rows instead of arrays, so a holder or company with very many counterparts
    is never gathered into one value.
    """
    rows = parsed(records).filter((c("person_key") != "") & (c("company_key") != ""))
    return rows.groupBy("person_key", "company_key").agg(F.count(F.lit(1)).alias("n_records"), F.min("seq").alias("first_seq"))


def dossier(records: DataFrame, person: str) -> DataFrame:
    """Every holding of one person, with flags."""
    return annotate(records).filter(c("person_key") == person.strip().lower())


def ownership_map(records: DataFrame) -> DataFrame:
    """Edges person → [vehicle] → company, marked where the record has flags."""
    rows = annotate(records)
    person = F.coalesce(T.non_empty(c("person_name")), F.lit("Unknown"))
    company = F.coalesce(T.non_empty(c("company")), F.lit("Unknown Company"))

    def edge(a, a_kind, b, b_kind, label, flagged):
        return F.struct(a.alias("src"), F.lit(a_kind).alias("src_kind"), b.alias("dst"), F.lit(b_kind).alias("dst_kind"),
                        label.alias("label"), flagged.alias("flagged"))

    pct = F.coalesce(c("percentage"), F.lit(""))
    direct = F.array(edge(person, "person", company, "company", F.trim(F.concat(F.lit("Direct "), pct)), c("n_flags") > 0))
    through = F.array(
        edge(person, "person", c("vehicle"), "vehicle", pct, c("n_flags") > 0),
        edge(c("vehicle"), "vehicle", company, "company", F.lit(""), F.lit(False)),
    )
    return rows.select("seq", F.explode(F.when(c("is_direct"), direct).otherwise(through)).alias("e")).select("seq", "e.*")
