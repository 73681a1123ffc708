"""Ownership-register operators as registered queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ownerlens import vocab as V
from ownerlens.operators import psc
from ownerlens.plans import sqltext as Q
from ownerlens.plans.registry import query

c = F.col

_P = {n: Q.pct(col) for n, col in
      {"pct": "percentage", "direct": "direct_pct", "indirect": "indirect_pct", "voting": "voting_pct"}.items()}
_EQ = "CASE WHEN direct IS NULL AND indirect IS NULL THEN pct ELSE coalesce(direct, 0) + coalesce(indirect, 0) END"
_PARKED = "(pct >= 3.5 AND pct < 5)"
_SECRECY = "CASE WHEN is_direct THEN NULL " + " ".join(
    f"WHEN contains(lower(vehicle), {Q.lit(t)}) THEN {Q.lit(t)}" for t in V.SECRECY_JURISDICTIONS) + " END"
_PAPERS = "concat_ws(' ', lower(vehicle), lower(previous_holder))"
CONTEXT_SQL = f"""
 parsed_v AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _P.items())}, lower(trim(person_name)) AS person_key,
   lower(trim(company)) AS company_key, {Q.direct('vehicle')} AS is_direct, nullif({Q.band('percentage')}, '') AS band FROM psc_v),
 many_v AS (SELECT person_key, count(DISTINCT company_key) AS n_companies FROM parsed_v WHERE person_key <> '' AND company_key <> '' GROUP BY 1),
 crowd_v AS (SELECT company_key, count(*) AS n_parked FROM parsed_v WHERE {_PARKED} AND company_key <> '' GROUP BY 1),
 ctx_v AS (SELECT p.*, m.n_companies, k.n_parked, {_EQ} AS equity, {_SECRECY} AS term FROM parsed_v p
   LEFT JOIN many_v m USING (person_key) LEFT JOIN crowd_v k USING (company_key))"""
RULES = {
    "R1_SUB_THRESHOLD": (f"{_PARKED} AND n_parked >= 2",
        f"concat(CAST(n_parked AS STRING), {Q.lit(V.DETAIL_PARKED)})"),
    "R3_VOTING_MISMATCH": ("voting - equity >= 20",
        f"concat('Voting rights of ', printf('%.1f', voting), '% against an equity interest of ', printf('%.1f', equity), '% — a ', printf('%.1f', voting - equity), {Q.lit(V.DETAIL_GAP)})"),
    "R7_SECRECY_VEHICLE": ("term IS NOT NULL", f"concat({Q.lit(V.DETAIL_SECRECY[0])}, term, {Q.lit(V.DETAIL_SECRECY[1])})"),
    "R9_PEP": ("starts_with(lower(pep_status), 'yes')", Q.lit(V.DETAIL_PEP)),
    "R4_NOMINEE": (Q.has_any(_PAPERS, V.NOMINEE_MARKERS), Q.lit(V.DETAIL_NOMINEE)),
    "R8_RAPID_CHANGE": ("(contains(lower(change_type), 'increas') OR contains(lower(change_type), 'acquir')) AND trim(previous_holder) <> ''",
        f"concat({Q.lit(V.DETAIL_CHANGE[0])}, previous_holder, {Q.lit(V.DETAIL_CHANGE[1])})"),
    "R12_CROSS_ENTITY": ("n_companies >= 2", f"concat({Q.lit(V.DETAIL_PORTFOLIO[0])}, CAST(n_companies AS STRING), {Q.lit(V.DETAIL_PORTFOLIO[1])})"),
    "R6_UNKNOWN_OWNER": ("pct IS NULL AND trim(nature_of_control) = ''",
        Q.lit(V.DETAIL_UNKNOWN)),
}
_ORDER = {r: i for i, r in enumerate(
    [r for r in V.FLAG_TITLES if V.FLAG_TITLES[r][0] == "high"] + [r for r in V.FLAG_TITLES if V.FLAG_TITLES[r][0] == "medium"])}
FLAGS_SQL = CONTEXT_SQL + ", flag_v AS (" + " UNION ALL ".join(
    f"SELECT seq, {_ORDER[r]} AS ord, '{r}' AS id, '{V.FLAG_TITLES[r][0]}' AS severity, {Q.lit(V.FLAG_TITLES[r][1])} AS title, {d} AS detail FROM ctx_v WHERE {p}"
    for r, (p, d) in RULES.items()) + ")"
COUNTS_SQL = FLAGS_SQL + """, ann_v AS (SELECT x.*, coalesce(f.n_flags, 0) AS n_flags, coalesce(f.n_high, 0) AS n_high FROM ctx_v x
 LEFT JOIN (SELECT seq, count(*) AS n_flags, count(*) FILTER (severity = 'high') AS n_high FROM flag_v GROUP BY seq) f USING (seq))"""

for _name, _rule in {
    "rf01_sub_threshold": "R1_SUB_THRESHOLD", "rf03_voting_mismatch": "R3_VOTING_MISMATCH", "rf04_nominee": "R4_NOMINEE",
    "rf06_unknown_owner": "R6_UNKNOWN_OWNER", "rf07_secrecy_vehicle": "R7_SECRECY_VEHICLE", "rf08_rapid_change": "R8_RAPID_CHANGE",
    "rf09_politically_exposed": "R9_PEP", "rf12_cross_entity": "R12_CROSS_ENTITY",
}.items():
    _pred, _detail = RULES[_rule]

    @query(_name, f"WITH {CONTEXT_SQL} SELECT seq, {_detail} AS detail FROM ctx_v WHERE {_pred}")
    def _rule_query(t, rule=_rule):
        return psc.rule_hits(t.psc_v, rule).select("seq", "detail")


@query("rf20_annotate", f"""WITH {FLAGS_SQL} SELECT f.seq, coalesce(x.band, '') AS band,
  row_number() OVER (PARTITION BY f.seq ORDER BY f.ord) - 1 AS pos, f.id, f.severity, f.title, f.detail FROM flag_v f JOIN ctx_v x USING (seq)""")
def rf20(t):
    flags = psc.annotate(t.psc_v).select("seq", F.coalesce("band", F.lit("")).alias("band"), F.posexplode("flags").alias("pos", "f"))
    return flags.select("seq", "band", c("pos").cast("bigint").alias("pos"), "f.*")


_KEYS = ", ".join(f"lower(trim(coalesce({k}, '')))" for k in V.PSC_IDENTITY)


PSC_FIRST_SQL = f"SELECT seq FROM psc_v QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY seq) = 1"


@query("agg05_psc_dedup", f"SELECT seq, person_name, company FROM psc_v QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY seq) = 1")
def agg05(t):
    return psc.deduplicate(t.psc_v).select("seq", "person_name", "company")


@query("agg07_portfolio", f"""WITH {COUNTS_SQL} SELECT count(*) AS total, round(avg(pct), 6) AS mean_stake, count(*) FILTER (NOT is_direct) AS indirect,
  count(*) FILTER (n_flags > 0) AS flagged, count(*) FILTER (n_high > 0) AS high_severity, count(*) FILTER (band = 'BAND_5_25') AS low_band,
  round(count(*) FILTER (trim(filing_ref) <> '') / count(*), 9) AS disclosure_rate, count(*) FILTER (lower(source) = 'seed') AS seeded,
  count(*) FILTER (lower(source) = 'seed') > 0 AS is_demo FROM ann_v""")
def agg07(t):
    return psc.summarise(t.psc_v).withColumns(
        {"mean_stake": F.round("mean_stake", 6), "disclosure_rate": F.round("disclosure_rate", 9)})


@query("agg08_band_histogram", f"""WITH b AS (SELECT unnest({[*V.BAND_IDS, 'UNDISCLOSED']}) AS band),
 n AS (SELECT coalesce(nullif({Q.band('percentage')}, ''), 'UNDISCLOSED') AS band, count(*) AS n FROM psc_v GROUP BY 1)
 SELECT band, coalesce(n, 0) AS n FROM b LEFT JOIN n USING (band)""")
def agg08(t):
    return psc.band_histogram(t.psc_v)


@query("agg09_companies_per_holder", f"WITH {CONTEXT_SQL} SELECT person_key, n_companies FROM many_v")
def agg09(t):
    return psc.companies_per_holder(psc.parsed(t.psc_v))


@query("jn08_holder_index", f"WITH {CONTEXT_SQL} SELECT person_key, company_key, count(*) AS n_records, min(seq) AS first_seq FROM parsed_v GROUP BY 1, 2")
def jn08(t):
    return psc.holder_pairs(t.psc_v)


@query("jn09_person_dossier", f"""WITH {COUNTS_SQL} SELECT seq, person_name, company, percentage, n_flags FROM ann_v
  WHERE person_key = (SELECT min(person_key) FROM many_v WHERE n_companies >= 2)""")
def jn09(t):
    rows = psc.annotate(t.psc_v)
    person = rows.filter("n_companies >= 2").agg(F.min("person_key")).scalar()
    return rows.filter(c("person_key") == person).select(
        "seq", "person_name", "company", "percentage", c("n_flags").cast("bigint").alias("n_flags"))


_CHIPS = {"flagged": "n_flags > 0", "majority": "pct >= 75", "low_band": "pct >= 5 AND pct < 25", "indirect": "NOT is_direct",
          "pep": "starts_with(lower(pep_status), 'yes')", "cross_entity": "n_companies >= 2"}


@query("flt09_register_chips", f"WITH {COUNTS_SQL} " + " UNION ALL ".join(
    f"SELECT '{n}' AS chip, seq FROM ann_v WHERE {p}" for n, p in _CHIPS.items()))
def flt09(t):
    tags = F.array_compact(F.array(*[F.when(F.coalesce(psc.FILTERS[n](), F.lit(False)), n) for n in _CHIPS]))
    return psc.annotate(t.psc_v).select(F.explode(tags).alias("chip"), "seq")


@query("flt10_register_search", """SELECT seq FROM psc_v WHERE contains(lower(concat_ws(' ', person_name, company, vehicle, nature_of_control, filing_ref)), 'mauritius')""")
def flt10(t):
    return psc.search_register(t.psc_v, " Mauritius ").select("seq")


@query("win06_register_ranking", f"WITH {COUNTS_SQL} SELECT seq, n_high, n_flags FROM ann_v ORDER BY n_high DESC, n_flags DESC, seq")
def win06(t):
    return psc.ranked_register(psc.annotate(t.psc_v)).select(
        "seq", c("n_high").cast("bigint").alias("n_high"), c("n_flags").cast("bigint").alias("n_flags"))


@query("gr04_ownership_map", f"""WITH {COUNTS_SQL}
 SELECT seq, person_name AS src, 'person' AS src_kind, company AS dst, 'company' AS dst_kind, trim(concat('Direct ', percentage)) AS label, n_flags > 0 AS flagged FROM ann_v WHERE is_direct
 UNION ALL SELECT seq, person_name, 'person', vehicle, 'vehicle', percentage, n_flags > 0 FROM ann_v WHERE NOT is_direct
 UNION ALL SELECT seq, vehicle, 'vehicle', company, 'company', '', FALSE FROM ann_v WHERE NOT is_direct""")
def gr04(t):
    return psc.ownership_map(t.psc_v)
