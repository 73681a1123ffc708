"""Reports as ordered lines, and alert rows.

A report is a table ``(section, item, part, line)``.  Sorting and writing it is
a distributed range sort, so a report over any number of articles is never
gathered into one string, group or task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ownerlens import vocab as V
from ownerlens.functions import holdings as H, text as T
from ownerlens.operators import psc

c = F.col
ORDER = ["section", "item", "part"]
EVENT_SECTIONS = ["appointments", "company_changes", "procurement", "regulation", "financial"]


def sections(articles: DataFrame) -> DataFrame:
    """First matching section of every article and two independent flags."""
    low = F.lower(F.concat_ws("\n", c("title"), c("text")))
    section = F.lit(None).cast("string")
    for name in reversed(EVENT_SECTIONS):
        hit = T.has_any(c("_low"), V.SECTION_WORDS[name])
        if name in V.SECTION_CATEGORY:
            hit = (F.coalesce(c("category"), F.lit("")) == V.SECTION_CATEGORY[name]) & hit
        section = F.when(hit, name).otherwise(section)
    return (
        articles.withColumn("_low", low)
        .withColumns({
            "section": section,
            "high_priority": (c("risk_level") == "Critical") | (c("importance") >= 75),
            "corruption": c("risk_level").isin("High", "Critical") | T.has_any(c("_low"), V.CORRUPTION_WORDS),
        })
        .drop("_low")
    )


def alerts(articles: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Alert rows of high-risk or important articles, tied to their first entity."""
    level, title = c("risk_level"), c("title")
    rows = articles.filter(level.isin("High", "Critical") | (c("importance") >= 75)).select(
        "seq", F.concat(level, F.lit(" Risk Alert: "), title).alias("title"),
        F.concat(F.lit("A "), level, F.lit(" risk event has been detected in article '"), title, F.lit("' (Importance: "),
                 T.fixed1(c("importance")), F.lit("). Summary: "), c("executive")).alias("message"),
        c("event_type").alias("alert_type"),
        F.when(level == "Critical", "Critical").when(level == "High", "Warning").otherwise("Info").alias("severity"),
    )
    if mentions is None:
        return rows.withColumn("entity_id", F.lit(None).cast("bigint"))
    first = mentions.groupBy("seq").agg(F.min("entity_seq").alias("entity_id"))
    return rows.join(first, "seq", "left")


def _line(section: int, part: int, text, item=None) -> Column:
    """One report line; ``item`` orders the lines of a section (-1 is its heading)."""
    item = F.lit(-1) if item is None else item
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(section).alias("section"), item.cast("bigint").alias("item"), F.lit(part).alias("part"), text.alias("line"))


def _lines(df: DataFrame, lines: list[Column]) -> DataFrame:
    """All lines a row contributes, NULL ones left out: one pass over ``df``."""
    return df.select(F.explode(F.array_compact(F.array(*lines))).alias("l")).select("l.*")


def _figure(label: str, name: str) -> Column:
    return F.concat(F.lit(f"- **{label}:** "), c(name).cast("string"))


def daily_report(articles: DataFrame, new_entities: DataFrame, trending: DataFrame, edition: str) -> DataFrame:
    """The sectioned report over the articles of one window.

    ``articles`` carries title, text, source, url, category, risk_level,
    importance, one_line and executive; ``trending`` is (type, name, n) cut to a
    few rows per type.  Headings, figures and empty-section notes come from one
    aggregate row; everything else from one pass over the articles.
    """
    rows = sections(articles)
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    totals = rows.agg(
        F.count(F.lit(1)).alias("total"), count(c("high_priority")).alias("high"), count(c("corruption")).alias("corruption"),
        *[count(c("section") == name).alias(name) for name in EVENT_SECTIONS],
    ).withColumns({n: new_entities.select(n).scalar() for n in ("new_companies", "new_agencies")})
    empty = lambda n: c(n) == 0
    head = [
        _line(0, 0, "# Daily Ownership & Company Report"), _line(0, 1, f"**Run time:** {edition}"), _line(0, 2, "## Summary"),
        _line(0, 3, _figure("Articles processed", "total")), _line(0, 4, _figure("New companies", "new_companies")),
        _line(0, 5, _figure("New agencies", "new_agencies")), _line(0, 6, _figure("Appointments", "appointments")),
        _line(0, 7, _figure("Company and board changes", "company_changes")), _line(0, 8, _figure("Procurement and tenders", "procurement")),
        _line(0, 9, _figure("High risk and corruption alerts", "corruption")),
        _line(1, 0, "## High Priority Events"),
        F.when(empty("high"), _line(1, 1, V.REPORT_NO_ALERTS)),
        _line(7, 0, "## Corruption Risk Alerts"),
        F.when(empty("corruption"), _line(7, 1, V.REPORT_NO_CORRUPTION)),
        _line(8, 0, "## Trending Entities"), _line(9, 0, "## Sources"),
    ]
    item = c("seq")
    entry = F.concat(F.lit("- **"), c("title"), F.lit("** ("), c("source"), F.lit(") - *"), c("one_line"), F.lit("*"))
    body = [F.when(c("high_priority"), _line(1, part, text, item)) for part, text in enumerate((
        F.concat(F.lit("### "), c("title")), F.concat(F.lit("- **Category:** "), F.coalesce("category", F.lit("Other"))),
        F.concat(F.lit("- **Risk score:** "), T.fixed1(c("importance") * 0.8), F.lit(" ("), c("risk_level"), F.lit(")")),
        F.concat(F.lit("- **Summary:** "), c("executive")), F.concat(F.lit("- **Source:** "), c("source"))))]
    for i, (name, heading, none) in enumerate(V.REPORT_HEADINGS, start=2):
        head += [_line(i, 0, heading), F.when(empty(name), _line(i, 1, none))]
        body.append(F.when(c("section") == name, _line(i, 0, entry, item)))
    body += [
        F.when(c("corruption"), _line(7, 0, F.concat(
            F.lit("- **"), c("title"), F.lit("** ("), c("source"), F.lit(") - **Risk score: "),
            T.fixed1(c("importance") * 0.85), F.lit("** - *"), c("executive"), F.lit("*")), item)),
        _line(9, 0, F.concat(F.lit("- ["), c("source"), F.lit("]("), c("url"), F.lit(") - "), c("title")), item),
    ]
    kind = F.when(c("type") == "company", 1).when(c("type") == "agency", 2).when(c("type") == "person", 3).otherwise(4)
    popular = trending.select(
        F.lit(8).alias("section"), kind.cast("bigint").alias("item"), F.row_number().over(_by_type()).alias("part"),
        F.concat(F.lit("- "), c("type"), F.lit(": "), c("name"), F.lit(" ("), c("n").cast("string"), F.lit(")")).alias("line"))
    return _lines(totals, head).unionByName(_lines(rows, body)).unionByName(popular)


def _by_type():
    from pyspark.sql import Window

    return Window.partitionBy("type").orderBy(c("n").desc(), "name")


def brief(records: DataFrame, generated: str, key_items: int = 8) -> DataFrame:
    """The rule-based brief of one run over extraction records.

    ``records``: seq, title, summary, risk_level, event_type, person,
    organization, has_procurement.
    """
    from ownerlens.operators.stats import run_counts

    risky = F.coalesce(c("risk_level").isin("High", "Critical"), F.lit(False))
    bought = F.coalesce((c("event_type") == "Procurement") | c("has_procurement"), F.lit(False))
    appointed = F.coalesce(c("event_type") == "Appointment", F.lit(False))
    counts = run_counts(records).withColumn("other", records.filter(~risky).limit(1).agg(F.count(F.lit(1))).scalar())
    item = lambda fallback, text: F.concat(
        F.lit("*   **"), F.coalesce(c("title"), F.lit(fallback)), F.lit("**: "), F.coalesce(T.non_empty(c("summary")), F.lit(text)))
    head = [
        _line(0, 0, "# Daily Ownership & Company Brief"), _line(0, 1, f"**Generated on:** {generated}"), _line(0, 2, "## Summary Statistics"),
        _line(0, 3, _figure("Total Articles Processed", "total")), _line(0, 4, _figure("High Risk Signals", "high_risk")),
        _line(0, 5, _figure("Appointments Logged", "appointments")), _line(0, 6, _figure("Procurement Awards", "procurement")),
        _line(1, 0, "### Key Developments"),
        F.when(c("other") == 0, _line(1, 1, V.BRIEF_NO_EVENTS)),
        _line(2, 0, "### High Risk Alerts"),
        F.when(c("high_risk") == 0, _line(2, 1, V.BRIEF_NO_RISKS)),
        _line(3, 0, "### Procurement & Board Changes"),
        F.when((c("appointments") == 0) & (c("procurement") == 0),
               _line(3, 1, V.BRIEF_NO_CHANGES)),
    ]
    seq = c("seq")
    body = [
        F.when(risky, _line(2, 0, item("Risk Alert", V.BRIEF_RISK_SUMMARY), seq)),
        F.when(appointed, _line(3, 0, F.concat(
            F.lit("*   **Key Appointment**: "), F.coalesce("person", F.lit("Executive")), F.lit(" logged under "),
            F.coalesce("organization", F.lit("Counterparty")), F.lit(".")), seq)),
        F.when(bought, _line(4, 0, F.concat(F.lit("*   **Procurement**: "), F.coalesce("title", F.lit("Contract Award"))), seq)),
    ]
    key = records.filter(~risky).orderBy("seq").limit(key_items)
    return (
        _lines(counts, head)
        .unionByName(_lines(key, [_line(1, 0, item("Corporate Event", V.BRIEF_EVENT_SUMMARY), seq)]))
        .unionByName(_lines(records, body))
    )


def compliance_brief(register: DataFrame) -> DataFrame:
    """Portfolio figures and a block per record; undisclosed figures say so."""
    or_text = lambda name, text: F.coalesce(T.non_empty(c(name)), F.lit(text))
    undisclosed = F.lit("not disclosed")
    mean = F.when(c("mean_stake").isNull(), undisclosed).otherwise(F.concat(T.fixed1(c("mean_stake"), ties_up=True), F.lit("%")))
    share = F.when(c("disclosure_rate").isNull(), undisclosed).otherwise(
        F.concat(F.round(c("disclosure_rate") * 100).cast("int").cast("string"), F.lit("%")))
    head = _lines(psc.summarise(register), [
        _line(0, 0, "# Persons with Significant Control: Audit Brief"),
        F.when(c("is_demo"), _line(0, 1, "> **NOT FOR COMPLIANCE USE.** Contains illustrative seed records.")),
        _line(0, 2, "## Summary"), _line(0, 3, _figure("Control records", "total")),
        _line(0, 4, F.concat(F.lit("- **Mean disclosed stake:** "), mean)), _line(0, 5, _figure("Held via a vehicle", "indirect")),
        _line(0, 6, F.concat(_figure("With red flags", "flagged"), F.lit(" ("), c("high_severity").cast("string"), F.lit(" high severity)"))),
        _line(0, 7, F.concat(F.lit("- **Citing a filing reference:** "), share)),
    ])
    titles = F.array_join(F.transform("flags", lambda f: f["title"]), ", ")
    blocks = (
        F.concat(F.lit("### "), or_text("person_name", "Undisclosed holder"), F.lit(" — "), or_text("company", "Undisclosed company")),
        F.concat(F.lit("- **Stake:** "), or_text("percentage", "not disclosed"), F.lit(" (Direct: "), or_text("direct_pct", "N/A"),
                 F.lit(", Indirect: "), or_text("indirect_pct", "N/A"), F.lit(")")),
        F.concat(F.lit("- **Vehicle:** "), F.when(H.is_direct_holding(c("vehicle")), "Direct Ownership").otherwise(c("vehicle"))),
        F.concat(F.lit("- **Nature of control:** "), or_text("nature_of_control", "not disclosed")),
        F.concat(F.lit("- **PEP status:** "), or_text("pep_status", "not disclosed")),
        F.concat(F.lit("- **Red flags:** "), F.coalesce(T.non_empty(titles), F.lit("Clean Disclosure"))),
        F.concat(F.lit("- **Filing reference:** "), or_text("filing_ref", "not disclosed")),
    )
    return head.unionByName(_lines(psc.annotate(register), [_line(1, i, text, c("seq")) for i, text in enumerate(blocks)]))


def write_report(lines: DataFrame, path: str) -> None:
    """Text files in report order, range-partitioned."""
    lines.orderBy(*ORDER).select(F.coalesce("line", F.lit("")).alias("value")).write.mode("overwrite").text(path)
