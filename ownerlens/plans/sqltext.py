"""Pieces of DuckDB check SQL built from the same vocabularies."""
from __future__ import annotations

import re

from ownerlens import vocab as V

# White space as Unicode has it; RE2's \s is ASCII only.
WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def fold(x: str) -> str:
    """Non-ASCII letters become '_', other non-ASCII a space: RE2's ASCII \\b then
    sits where the Unicode one does.  The en dash is kept for scorelines."""
    return (
        f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}–]', ' ', 'g'), "
        f"'[^\\x00-\\x7F–]', '_', 'g')"
    )


def words(terms, plural: bool = False) -> str:
    ordered = sorted(dict.fromkeys(terms), key=lambda t: (-len(t), t))
    body = "|".join(re.sub(r"([.+*?()\[\]-])", r"\\\1", t) for t in ordered)
    return lit(rf"\b(?:{body}){'s?' if plural else ''}\b")


def hits(x: str, terms, plural: bool = False) -> str:
    """Whole-word test on already folded lower-case text."""
    return f"regexp_matches({x}, {words(terms, plural)})"


def has_any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def count(x: str, terms) -> str:
    return "(" + " + ".join(
        f"((length({x}) - length(replace({x}, {lit(t)}, ''))) // {len(t)})" for t in terms
    ) + ")"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def off_topic_ctes(source: str, keep: str, title: str, summary: str) -> str:
    """CTE chain ending in ``topic_v(keep…, topic, matched)``."""
    text = f"lower(replace(concat_ws(' ', {title}, {summary}), '’', ''''))"
    sport, fun = words(V.SPORT_TERMS), words(V.ENTERTAINMENT_TERMS)
    return f"""
 folded_v AS (SELECT {keep}, {fold(text)} AS t FROM {source}),
 tests_v AS (SELECT *, ({hits('t', V.OWNERSHIP_STRONG_TERMS)} OR ({hits('t', V.OWNERSHIP_WEAK_TERMS)}
        AND regexp_matches(t, {lit(V.PERCENTAGE_PATTERN)}))) AS owned,
        list_distinct(regexp_extract_all(t, {sport})) AS sp, list_distinct(regexp_extract_all(t, {fun})) AS fu,
        regexp_matches(t, {lit(V.SCORELINE_PATTERN)}) AS line, {hits('t', V.RESULT_VERBS)} AS verb FROM folded_v),
 topic_v AS (SELECT {keep},
        CASE WHEN owned THEN NULL WHEN len(sp) > 0 OR (line AND verb) THEN 'sport' WHEN len(fu) > 0 THEN 'entertainment' END AS topic,
        CASE WHEN owned THEN NULL
             WHEN len(sp) > 0 THEN list_sort(list_distinct(list_concat(sp, CASE WHEN line THEN ['scoreline'] ELSE [] END)))
             WHEN line AND verb THEN ['result verb', 'scoreline'] WHEN len(fu) > 0 THEN list_sort(fu) END AS matched
        FROM tests_v)"""


def case_floor(x: str, floors, default: str) -> str:
    whens = " ".join(f"WHEN {x} >= {floor} THEN {lit(name)}" for floor, name in floors)
    return f"CASE {whens} ELSE {lit(default)} END"


def pct(x: str) -> str:
    t = f"trim(replace({x}, '%', ''))"
    return rf"CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({t} AS DOUBLE) END"


def band(x: str) -> str:
    p = pct(x)
    whens = " ".join(f"WHEN ({p}) >= {f} THEN {lit(n)}" for f, n in V.SHARE_BANDS)
    return f"CASE WHEN ({p}) IS NULL THEN '' {whens} ELSE {lit(V.BELOW_THRESHOLD)} END"


def direct(x: str) -> str:
    return f"lower(trim(coalesce({x}, ''))) IN {inlist(V.DIRECT_HOLDING_LABELS)}"


def stub(title: str, source: str) -> str:
    """Navigation-stub predicate over columns already normalised into t and s."""
    rest = "CASE " + " ".join(
        f"WHEN ends_with({title}, {lit(sep)} || {source}) THEN trim(left({title}, length({title}) - {len(sep)} - length({source})))"
        for sep in V.TITLE_SEPARATORS
    ) + f" ELSE {title} END"
    nav = inlist(V.NAVIGATION_TITLES)
    return (
        f"({title} = '' OR {title} IN {nav} OR ({source} <> '' AND (({rest}) = {source} OR {title} = {source} "
        f"OR ({rest}) IN {nav} OR (starts_with(({rest}), {source} || ' ') AND substr(({rest}), length({source}) + 2) IN {nav}))))"
    )


def sentiment(x: str) -> str:
    p, n = count(x, V.POSITIVE_STEMS), count(x, V.NEGATIVE_STEMS)
    return f"CASE WHEN {p} > {n} + 1 THEN 'Positive' WHEN {n} > {p} + 1 THEN 'Negative' ELSE 'Neutral' END"


def risk_level(folded: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {hits(folded, terms, plural=True)} THEN {lit(tier)}" for tier, terms in V.RISK_TIERS.items()
    ) + " ELSE 'Low' END"


def category(x: str) -> str:
    g, c, l = (count(x, V.CATEGORY_WORDS[k]) for k in ("Government", "Company", "Legal"))
    return (
        f"CASE WHEN {g} > {c} AND {g} > {l} THEN 'Government' WHEN {c} > {g} AND {c} > {l} THEN 'Company' "
        f"WHEN {l} > {g} AND {l} > {c} THEN 'Legal' WHEN {has_any(x, V.PERSON_TITLE_WORDS)} THEN 'Person' ELSE 'General' END"
    )


def positions(folded: str) -> str:
    items = ", ".join(
        f"CASE WHEN {hits(folded, [t.lower()], plural=True)} THEN {lit(t)} END" for t in V.JOB_TITLES
    )
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def sentence_list(x: str) -> str:
    marked = rf"regexp_replace({strip(x)}, '([.!?]){WS}+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda x: x <> '')"
