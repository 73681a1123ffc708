"""One run from collected articles to its end.

Gates, new URLs, extraction, relevance, fan-out and registers (``daily_run``), and with
``complete_run`` also the store, the brief, the exports and the gate that publishes them.
"""
from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ownerlens import schemas
from ownerlens.functions import scoring as S, text as T
from ownerlens.operators import extract, gates, psc, publish, registers, reports
from ownerlens.operators.keys import new_by_key
from ownerlens.session import materialise

c = F.col


def fresh_articles(articles: DataFrame, store: DataFrame, as_of) -> DataFrame:
    """Articles that pass every gate and whose URL is not stored yet, the first of each URL."""
    live = articles.filter(~T.is_navigation_stub(c("title"), c("source")) & S.mentions_country(c("url"), c("title"), c("raw_text")))
    return new_by_key(gates.keep_fresh(live, as_of), store, "url")


def daily_run(articles: DataFrame, store: DataFrame, as_of, text: str = "text", entities: str = "entities") -> dict[str, DataFrame]:
    """Tables of one run: ``extracted`` (every new article), ``companies``, ``agencies``, ``people``, ``holdings``, ``procurement``.

    The extraction is evaluated once and written; the tables read it from there.
    """
    new = fresh_articles(articles, store, as_of)
    record = extract.fallback_extraction(c("title"), c(text), c(entities))
    extracted = materialise(new.select("seq", "url", "title", "source", "published_at", record.alias("extraction")), "extracted")
    relevant = extracted.filter("extraction.relevant")
    return {
        "extracted": extracted,
        "companies": registers.upsert_companies(extract.company_rows(relevant)),
        "agencies": extract.agency_rows(relevant),
        "people": extract.people_rows(relevant),
        "holdings": extract.holding_rows(relevant, str(as_of)[:10]),
        "procurement": extract.procurement_rows(relevant),
    }


def summary(funnel: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(part, name, n): articles per stage, mentions per company, rows per agency and person."""
    stages = funnel.select(F.explode(F.create_map(*[x for n in funnel.columns for x in (F.lit(n), c(n))])).alias("name", "n"))
    kept = tables["extracted"].agg(F.count(F.lit(1)).alias("new"), F.count_if("extraction.relevant").alias("relevant"))
    kept = kept.select(F.explode(F.create_map(F.lit("new"), c("new"), F.lit("relevant"), c("relevant"))).alias("name", "n"))
    count = lambda part, name: tables[part].groupBy(c(name).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "name", "n")
    parts = [
        stages.select(F.lit("stage").alias("part"), "name", "n"), kept.select(F.lit("stage").alias("part"), "name", "n"),
        tables["companies"].select(F.lit("companies").alias("part"), c("company").alias("name"), c("mention_count").alias("n")),
        count("agencies", "agency"), count("people", "name"),
    ]
    return reduce(DataFrame.unionAll, parts)


def complete_run(articles: DataFrame, root: str, run: int, as_of, answer: Callable[[DataFrame], DataFrame], text: str = "text", entities: str = "entities") -> dict[str, DataFrame]:
    """A run to its end, below ``root``: extraction, registers, brief, exports, publication.

    ``answer`` adds the column ``told`` to the rows to be extracted, dead letters of the
    run before among them: a model's extraction, null where it gave none. The vocabularies
    answer what is left, unless a run has no fallback (an empty ``text``).
    Articles that are not relevant are stored as filtered, so their URLs stay seen. The
    tables are written before the pointer moves, and nothing is shown of a run that
    failed as a whole. Returns ``health`` and, unless it did, ``articles``, the registers
    and ``brief``.
    """
    spark = articles.sparkSession
    live = articles.filter(~T.is_navigation_stub(c("title"), c("source")) & S.mentions_country(c("url"), c("title"), c("raw_text")))
    todo = publish.pending(gates.keep_fresh(live, as_of), root, run)
    answers = [c("told")]
    if text:
        # Under the schema that replies are read with.
        answers.append(F.from_json(F.to_json(extract.fallback_extraction(c("title"), c(text), c(entities))), schemas.EXTRACTION))
    rows = answer(todo).withColumn("extraction", extract.with_defaults(F.coalesce(*answers))).drop("told")
    status = F.when(F.coalesce(c("extraction.relevant"), F.lit(False)), "Published").otherwise("Filtered")
    rows = materialise(rows.withColumn("status", status), "run")
    fanned = extract.fan_out(rows.filter("status = 'Published'"), str(as_of))
    extract.write_fan_out(fanned, os.path.join(root, "registers", f"run={run:012d}"))
    records = rows.filter("status = 'Published'").select(
        "seq", "title", c("extraction.summary").alias("summary"), c("extraction.risk_level").alias("risk_level"), c("extraction.event_type").alias("event_type"),
        F.get("extraction.people.name", F.lit(0)).alias("person"), F.get("extraction.organizations.name", F.lit(0)).alias("organization"),
        c("extraction.procurement").isNotNull().alias("has_procurement"))
    registers.write_snapshot(reports.brief(records, str(as_of)), os.path.join(root, "brief"), run)
    health = publish.publish(rows, root, run, articles.columns)
    if run not in publish.finished(spark, root):
        return {"health": health}
    held = {name: register_of(spark, root, name) for name in extract.REGISTERS}
    exports = os.path.join(root, "exports", f"run={run:012d}")
    registers.write_csv(held["significant_control"], os.path.join(exports, "significant_control_csv"), [n for n in held["significant_control"].columns if n not in ("seq", "pos")])
    registers.write_json(registers.mark_demo(held["significant_control"]), os.path.join(exports, "significant_control_json"))
    stored = publish.published(spark, root)
    registers.write_json(registers.published_feed(stored.withColumn("summary", c("extraction.summary"))).drop("extraction"), os.path.join(exports, "feed_json"))
    return {"health": health, "articles": stored, "brief": registers.read_snapshot(spark, os.path.join(root, "brief")), **held}


_COLUMNS = {
    "companies": ("company", "seen_at", "industry", "risk_level"), "agencies": ("agency", "event", "article", "date"),
    "people": ("name", "position", "organization", "event", "date"), "procurement": ("agency", "contractor", "amount", "project", "source"),
    "significant_control": ("person_name", "company", "nature_of_control", "board_role", "percentage", "direct_pct", "indirect_pct", "voting_pct", "share_band", "vehicle",
                            "pep_status", "risk_level", "filing_ref", "verification_status", "change_type", "previous_holder", "date", "source"),
}


def register_of(spark, root: str, name: str) -> DataFrame:
    """A register over all published runs: companies merged, disclosures once, other rows as they came."""
    paths = [os.path.join(root, "registers", f"run={run:012d}") for run in sorted(publish.finished(spark, root))]
    fanned = spark.read.schema("seq bigint, pos int, fields map<string,string>, register string").option("basePath", os.path.join(root, "registers")).parquet(*paths)
    rows = extract.register_rows(fanned, name, *_COLUMNS[name])
    if name == "companies":
        return registers.upsert_companies(rows)
    return psc.deduplicate(rows) if name == "significant_control" else rows
