"""Relations, events and entities tied together by keys."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ownerlens.operators.keys import first_per_key, top_per_key
from ownerlens.operators.resolve import resolve
from ownerlens.session import materialise

c = F.col
#: Confidence of every event record.
CONFIDENCE = 0.9


def endpoint_types(predicate: Column) -> tuple[Column, Column]:
    """Entity types of subject and object by predicate."""
    subject = (
        F.when(predicate.isin("resigned from", "retired from"), "person")
        .when(predicate.isin("investigating", "suing"), "agency")
        .otherwise("company")
    )
    obj = F.when(
        predicate.isin("resigned from", "retired from", "acquired", "partnered with", "investigating", "suing"), "company"
    ).otherwise("person")
    return subject, obj


def resolved_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with entity ids at both ends, one per (article, subject, predicate, object).

    The ends' distinct (type, name) pairs go through the resolver as one batch, in other
    spellings too, and its answers are joined back at both ends; unknown ends become new
    entities.  Copies are dropped before anything is joined.  An empty end stays without.
    """
    subject_type, object_type = endpoint_types(c("predicate"))
    rows = first_per_key(relations, ["article_id", "subject", "predicate", "object"]).withColumns(
        {"subject_type": subject_type, "object_type": object_type})
    ends = rows.select("seq", c("subject_type").alias("type"), c("subject").alias("name")).unionAll(
        rows.select("seq", c("object_type").alias("type"), c("object").alias("name")))
    found = materialise(resolve(ends, entities), "relation-ends")
    for end in ("subject", "object"):
        answer = found.select(c("type").alias(f"{end}_type"), c("name").alias("_name"), c("entity_id").alias(f"{end}_id"), c("stage").alias(f"{end}_stage"))
        rows = rows.withColumn("_name", F.trim(end)).join(answer, [f"{end}_type", "_name"], "left").drop("_name")
    return rows


def event_bridge(mentions: DataFrame) -> DataFrame:
    """Distinct (event, entity) pairs with the fixed confidence of the event record."""
    return mentions.select(c("seq").alias("event_id"), c("entity_seq").alias("entity_id"), "type").distinct().withColumn(
        "confidence", F.lit(CONFIDENCE))


def events(articles: DataFrame) -> DataFrame:
    """The event record of every enriched article ``(seq, title, summaries, event_type, published_at, entities)``; its place is the first one named."""
    return articles.select(
        c("seq").alias("event_id"), "title", c("summaries.executive").alias("description"), "event_type", F.lit(CONFIDENCE).alias("confidence"),
        "published_at", F.get("entities.locations", F.lit(0)).alias("location"))


def entities_of(articles: DataFrame, bridge: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities linked to the given articles; the bridge is cut down before the join."""
    wanted = bridge.join(articles.select(c("seq").alias("event_id")), "event_id", "left_semi")
    return wanted.join(entities.select(c("entity_seq").alias("entity_id"), "name"), "entity_id")


def trending(linked: DataFrame, k: int = 5) -> DataFrame:
    """Most mentioned entities of each type: events per entity, ties by name."""
    counts = linked.groupBy("type", "name").agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(counts, ["type"], [c("n").desc(), c("name")], k, "rank")


def trending_keywords(articles: DataFrame, k: int = 5) -> DataFrame:
    words = F.array_compact(F.array(c("category"), F.concat(c("risk_level"), F.lit(" Risk"))))
    counts = articles.select(F.explode(words).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(c("n").desc(), "name").limit(k)


def new_entities(linked: DataFrame) -> DataFrame:
    return linked.agg(
        F.count_distinct(F.when(c("type") == "company", c("entity_id"))).alias("new_companies"),
        F.count_distinct(F.when(c("type") == "agency", c("entity_id"))).alias("new_agencies"),
    )
