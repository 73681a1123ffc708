"""Entity resolution: exact name, alias, best fuzzy match, else a new entity."""
from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ownerlens.functions.similarity import TextMatcher
from ownerlens.operators.dedup import greedy_sweep
from ownerlens.operators.keys import first_per_key, global_rank, top_per_key
from ownerlens.operators.registers import snapshots, write_snapshot
from ownerlens.session import materialise

c = F.col
LEAST = 0.80
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Different names of one type in a cell; a pair of cells is compared in one task.
CELL = 1 << 15
#: Unresolved names of one type that a round of the sweep settles: names are short, and rounds cost more than they do.
ROUND = 1 << 13


def _best_of_cells(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The best known name above ``LEAST`` for every name asked, of those of two cells."""
    found = []
    if len(asked) and len(known):
        found = list(TextMatcher(LEAST, strict=True).best(asked["low"].tolist(), known["low"].tolist(), known["entity_id"].to_numpy()))
    rows, others = [i for i, _, _ in found], [j for _, j, _ in found]
    best = asked[["type", "low"]].iloc[rows].reset_index(drop=True)
    return best.assign(entity_id=known["entity_id"].to_numpy()[others] if found else [], score=np.array([s for _, _, s in found], dtype="float64")).astype({"type": object, "low": object})


def _celled(names: DataFrame, mine: str, other: str, sizes: DataFrame) -> DataFrame:
    """``names(type, low, ...)`` dealt into the cells of their type, once for each cell of the other side."""
    rows = names.join(sizes, "type").withColumn(mine, F.pmod(F.xxhash64("low"), c(f"{mine}s")).cast("int"))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), c(f"{other}s") - 1))).drop(f"{mine}s", f"{other}s")


def fuzzy_best(mentions: DataFrame, known: DataFrame, cell: int | None = None) -> DataFrame:
    """Best known entity above 0.8 per mention; ties go to the lowest id.

    ``mentions(mention_id, type, name)``, ``known(entity_id, type, name)`` with one
    row per name or alias.  The different lower-case names of a type are dealt into cells, and
    each pair of cells is compared in a task, by exact bounds before the similarity.
    A task hands on the best match of a name, never pairs.
    """
    cell = cell or CELL
    m = mentions.select("mention_id", "type", F.lower("name").alias("low"))
    asked = m.filter("type IS NOT NULL AND low IS NOT NULL").select("type", "low").distinct()
    # Of equal names only the lowest id can be the best.
    k = known.select("entity_id", "type", F.lower("name").alias("low")).filter("type IS NOT NULL AND low IS NOT NULL")
    k = k.groupBy("type", "low").agg(F.min("entity_id").alias("entity_id"))
    asked, k = materialise(asked, "names-asked"), materialise(k, "names-known")
    count = lambda names, as_: names.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(as_))
    sizes = count(asked, "as").join(count(k, "ks"), "type")
    left, right = _celled(asked, "a", "k", sizes), _celled(k, "k", "a", sizes)
    types = {f.name: f.dataType.simpleString() for f in k.schema.fields}
    cells = left.groupBy("type", "a", "k").cogroup(right.groupBy("type", "a", "k"))
    found = cells.applyInPandas(_best_of_cells, f"type string, low string, entity_id {types['entity_id']}, score double")
    best = top_per_key(found, ["type", "low"], [c("score").desc(), c("entity_id")], 1)
    return m.join(best, ["type", "low"]).select("mention_id", "entity_id", "score")


def resolve(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``(type, name, entity_id, stage)`` for every distinct mention.

    ``mentions(seq, type, name)``; ``entities(entity_id, type, name, aliases)``.
    Stages: exact name, alias ignoring case, fuzzy above 0.8, and for the rest
    the same rule among themselves in arrival order, the first of a family
    becoming a new entity.
    """
    named = mentions.select(c("seq").cast("bigint").alias("seq"), "type", F.trim("name").alias("name")).filter("name <> ''")
    # An article may hold several names, so distinct mentions are numbered, in order of arrival.
    firsts = first_per_key(named, ["type", "name"])
    m = global_rank(firsts, [c("seq"), c("type"), c("name")], "mention_id").drop("seq")
    exact = m.join(entities.groupBy("type", "name").agg(F.min("entity_id").alias("entity_id")), ["type", "name"])
    exact = exact.select("mention_id", "entity_id", F.lit("exact").alias("stage"))
    rest = m.join(exact, "mention_id", "left_anti")
    aliases = entities.select("entity_id", "type", F.explode("aliases").alias("name"))
    by_alias = aliases.groupBy("type", F.lower("name").alias("key")).agg(F.min("entity_id").alias("entity_id"))
    alias = rest.withColumn("key", F.lower("name")).join(by_alias, ["type", "key"]).select(
        "mention_id", "entity_id", F.lit("alias").alias("stage"))
    rest = rest.join(alias, "mention_id", "left_anti")
    known = entities.select("entity_id", "type", "name").unionByName(aliases)
    fuzzy = materialise(fuzzy_best(rest, known).select("mention_id", "entity_id", F.lit("fuzzy").alias("stage")), "fuzzy")
    rest = materialise(rest.join(fuzzy, "mention_id", "left_anti"), "unresolved")

    items = rest.select(c("type").alias("group"), c("mention_id").alias("seq"), F.lower("name").alias("value"))
    founders = greedy_sweep(items, TextMatcher(LEAST, strict=True), ROUND).withColumnRenamed("seq", "mention_id")
    highest = entities.agg(F.coalesce(F.max("entity_id"), F.lit(0))).scalar()
    new = materialise(
        global_rank(rest.join(founders, "mention_id", "left_semi"), c("mention_id"), "_n")
        .withColumn("entity_id", highest + c("_n")).select("mention_id", "entity_id", "type", "name"), "new-entities")
    followers = fuzzy_best(rest.join(new, "mention_id", "left_anti"), new.select("entity_id", "type", "name")).select(
        "mention_id", "entity_id", F.lit("joined new").alias("stage"))
    created = new.select("mention_id", "entity_id", F.lit("new").alias("stage"))
    stages = exact.unionByName(alias).unionByName(fuzzy).unionByName(created).unionByName(followers)
    return m.join(stages, "mention_id").select("type", "name", "entity_id", "stage")


def with_new_aliases(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(entity_id, type, name)`` to add: one row per mention that resolved to another spelling.

    Kept as rows, so an entity with very many spellings is not gathered into one value.
    """
    known = entities.select("entity_id", c("name")).unionByName(entities.select("entity_id", F.explode("aliases").alias("name")))
    found = resolved.filter(c("stage").isin("fuzzy", "joined new")).select("entity_id", "type", "name").distinct()
    return found.join(known, ["entity_id", "name"], "left_anti")


def entity_defaults(new: DataFrame) -> DataFrame:
    """Base scores and empty details of new entities, by type."""
    t = c("type")
    return new.withColumns({
        "aliases": F.array("name"),
        "risk_score": F.when(t.isin("company", "agency"), 10.0).otherwise(0.0),
        "influence_score": F.when(t == "agency", 20.0).otherwise(5.0),
        "status": F.when(t == "company", "Active"),
        "jurisdiction": F.when(t == "agency", "National"),
    })


_KNOWN = "entity_id bigint, type string, name string, aliases array<string>"


def known_before(entities: DataFrame, root: str, version: int) -> DataFrame:
    """The dimension with all that earlier batches added: new entities, and one row per accepted spelling."""
    spark = entities.sparkSession
    out = entities.select(*[c(name).cast(kind) for name, kind in (part.rsplit(" ", 1) for part in _KNOWN.split(", "))])
    for part in ("created", "spelling"):
        added = snapshots(spark, os.path.join(root, part), version)
        if added is not None:
            out = out.unionByName(added.select("entity_id", "type", "name", F.array("name").alias("aliases")))
    return out


def resolve_batch(mentions: DataFrame, entities: DataFrame, root: str, version: int) -> DataFrame:
    """Resolve one batch against the dimension and what batches before ``version`` have learnt.

    New entities and accepted spellings are written as rows of this version, which later
    batches read; earlier ones are not touched, and a replayed batch reads the same and
    writes the same again.
    """
    known = known_before(entities, root, version)
    found = materialise(resolve(mentions, known), "resolved-batch")
    created = entity_defaults(found.filter(c("stage") == "new").select("entity_id", "type", "name"))
    write_snapshot(created, os.path.join(root, "created"), version)
    write_snapshot(with_new_aliases(known, found), os.path.join(root, "spelling"), version)
    return found
