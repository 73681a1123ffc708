"""Keyword, vector, hybrid, concept and batch search; related articles and traces."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ownerlens import vocab as V
from ownerlens.functions import text as T
from ownerlens.operators.extract import Keys, contained_keys, match_entities, pieces_in, words_of
from ownerlens.operators.keys import top_per_key
from ownerlens.operators.vectors import block_products, nearest
from ownerlens.session import materialise

c = F.col
RRF_K = 60
#: Queries that a word may have before the best articles are found once for all of them.
OWN = 8


# ------------------------------------------------------------- one query


def keyword(articles: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Articles whose title or text contains the query, most recent first."""
    needle = F.lit(text.lower())
    hit = F.contains(F.lower(c("title")), needle) | F.contains(F.lower(c("raw_text")), needle)
    return articles.filter(hit).orderBy(c("published_at").desc_nulls_last(), "seq").limit(limit)


def latest(articles: DataFrame, limit: int = 20) -> DataFrame:
    return articles.orderBy(c("published_at").desc_nulls_last(), "seq").limit(limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector(vectors: DataFrame, query: Column, limit: int = 20) -> DataFrame:
    """Nearest stored vectors; the query vector is a literal or a scalar subquery,
    so the scan ends in a top-k without a shuffle of the vectors."""
    scored = vectors.withColumn("_q", query).withColumn("distance", cosine_distance(c("embedding"), c("_q"))).drop("_q")
    return scored.orderBy(c("distance").asc_nulls_last(), "seq").limit(limit)


def fuse(keyword_hits: DataFrame, vector_hits: DataFrame, limit: int = 20) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists.

    Both lists are already cut to a few rows, so ranking them in one window is
    cheap by construction.
    """
    first = keyword_hits.select("seq", (F.row_number().over(Window.orderBy(c("published_at").desc_nulls_last(), "seq")) - 1).alias("rank"))
    second = vector_hits.select("seq", (F.row_number().over(Window.orderBy(c("distance").asc_nulls_last(), "seq")) - 1).alias("rank"))
    votes = first.unionAll(second).withColumn("vote", F.lit(1.0) / (c("rank") + RRF_K))
    return votes.groupBy("seq").agg(F.sum("vote").alias("score")).orderBy(c("score").desc(), "seq").limit(limit)


def hybrid(articles: DataFrame, vectors: DataFrame, text: str, query: Column | None, limit: int = 20) -> DataFrame:
    """Keyword and vector search fused; an empty query lists the latest articles and a
    missing query vector falls back to the keyword list for both."""
    if not text:
        return latest(articles, limit).select("seq", F.lit(1.0).alias("score"), F.lit("latest").alias("type"))
    words = keyword(articles, text, 2 * limit)
    if query is None:
        near = words.withColumn("distance", -F.unix_timestamp(c("published_at").cast("timestamp")).cast("double"))
    else:
        near = vector(vectors, query, 2 * limit)
    return fuse(words, near, limit).withColumn("type", F.lit("hybrid"))


def concept_tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9']+", text.lower()) if len(w) > 2]


def concept_score(title: Column, summary: Column, level: Column, text: str) -> Column:
    """Title hits weigh three, summary hits one, a risk word two where the level matches."""
    levels = {name.lower(): name for name in V.RISK_LEVELS}
    low_title, low_summary = F.lower(title), F.lower(summary)
    total = F.lit(0)
    for token in concept_tokens(text):
        if token in levels:
            total = total + F.when(level == levels[token], 2).otherwise(0)
        elif token != "risk":
            total = total + F.when(F.contains(low_title, F.lit(token)), 3).when(
                F.contains(low_summary, F.lit(token)), 1).otherwise(0)
    return total


def concept(articles: DataFrame, text: str) -> DataFrame:
    scored = articles.withColumn("score", concept_score(c("title"), c("summary"), c("risk_level"), text))
    return scored.filter("score > 0").orderBy(c("score").desc(), "seq")


# ------------------------------------------------------------- many queries


def batch_keyword(articles: DataFrame, queries: DataFrame, text: Column, limit: int = 20) -> DataFrame:
    """Top articles of every query in a table ``(query_id, query)``, most recent first.

    Distinct queries of one word are looked up in the words of all texts: a query's best
    articles are among the best of each word that contains it, so every word is cut first
    and a query contained in most articles stays cheap.  Other queries go
    through ``extract.contained_keys``.
    """
    asked = materialise(queries.select(F.lower("query").alias("key"), "query_id").filter(F.length("key") > 0), "asked")
    keys = Keys(asked.groupBy("key").agg(F.min("query_id").cast("bigint").alias("id")))
    dated = articles.select("seq", "published_at")
    recent = [c("published_at").desc_nulls_last(), c("seq")]
    if keys.few:
        hits = contained_keys(articles, F.lower(text), keys.all)
    else:
        texts = articles.select(c("seq").cast("bigint").alias("seq"), "published_at", F.lower(text).alias("hay")).filter(c("hay") != "")
        # Equal rows of an article share a rank.
        ranked = words_of(texts, keys.least, "seq", "published_at").withColumn("_rank", F.dense_rank().over(Window.partitionBy("word").orderBy(*recent)))
        newest = materialise(ranked.filter(c("_rank") <= limit).drop("_rank").distinct(), "newest")
        met = pieces_in(newest.select("word").distinct(), keys.word.select(c("key").alias("piece")))
        hits = newest.join(met, "word").join(keys.word.select("id", c("key").alias("piece")), "piece").select("seq", "id", "published_at").distinct()
        hits = top_per_key(hits, ["id"], recent, limit).select("seq", "id").distinct()
        if keys.some_words or keys.some_none:
            hits = hits.unionByName(contained_keys(articles, F.lower(text), keys.words.unionByName(keys.none)))
    # Cut once per distinct query, so equal queries do not multiply the hits.
    best = top_per_key(hits.join(dated, "seq"), ["id"], recent, limit, "rank")
    ids = asked.join(keys.all.select("id", "key"), "key").select("query_id", "id")
    return best.join(ids, "id").select("query_id", "seq", "rank")


def batch_vector(vectors: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Nearest vectors ``(query_id, seq, distance, rank)`` of every row of ``queries(query_id, embedding)``.

    Both sides are dealt into blocks, and each pair of blocks is one matrix product in a
    task, which keeps ``limit`` rows per query; one cut per query merges them.  Neither
    side passes the driver.  Distances are rounded to nine digits, ties go by ``seq``;
    vectors without direction, on either side, are left out.
    """
    near = block_products(vectors, queries, nearest(limit), "query_id bigint, seq bigint, distance double")
    return top_per_key(near, ["query_id"], [c("distance"), c("seq")], limit, "rank").select("query_id", "seq", "distance", "rank")


def batch_hybrid(articles: DataFrame, vectors: DataFrame, queries: DataFrame, text: Column, limit: int = 20) -> DataFrame:
    """Keyword and vector search of every row of ``queries(query_id, query, embedding)``, fused by reciprocal ranks.

    A query without text, or without an embedding, is ranked by the other half alone.
    """
    words = batch_keyword(articles, queries.filter(T.non_empty(c("query")).isNotNull()).select("query_id", "query"), text, 2 * limit)
    near = batch_vector(vectors, queries, 2 * limit)
    both = words.select("query_id", "seq", "rank").unionByName(near.select("query_id", "seq", "rank"))
    fused = both.groupBy("query_id", "seq").agg(F.sum(1.0 / (c("rank") - 1 + RRF_K)).alias("score"))
    # Sums of the same two terms in either order differ in their last digits.
    return top_per_key(fused.withColumn("score", F.round("score", 12)), ["query_id"], [c("score").desc(), c("seq")], limit, "rank")


def batch_concept(articles: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Concept search ``(query_id, seq, score, rank)`` of every row of ``queries(query_id, query)``.

    Words of all queries are looked up in titles and summaries at once; a word counts as
    often as the query has it, three in a title, else one in the summary, and a level of
    risk two where the article has that level.

    Words of over ``OWN`` queries are shared.  Queries with the same shared words, as often,
    are one group: the best articles by these words alone are found once per group, and
    besides them only articles with another word of a query can be among its best.
    """
    levels = [level.lower() for level in V.RISK_LEVELS]
    words = F.filter(F.split(F.lower("query"), "[^a-z0-9']+"), lambda w: F.length(w) > 2)
    tokens = queries.select("query_id", F.explode(words).alias("token")).filter("token <> 'risk'")
    tokens = tokens.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    tokens = materialise(tokens.withColumn("id", F.xxhash64("token")), "tokens")
    keys = tokens.groupBy("id").agg(F.first("token").alias("key"), F.count(F.lit(1)).alias("asking"))
    keys = materialise(keys.withColumns({"shared": c("asking") > OWN, "is_level": c("key").isin(levels)}), "concept-keys")
    terms = keys.filter(~c("is_level")).select("id", "key")
    in_title = contained_keys(articles, F.lower("title"), terms).withColumn("weight", F.lit(3))
    in_summary = contained_keys(articles, F.lower("summary"), terms).withColumn("weight", F.lit(1))
    by_word = in_title.unionByName(in_summary).groupBy("seq", "id").agg(F.max("weight").cast("bigint").alias("weight"))
    held = articles.select(c("seq").cast("bigint").alias("seq"), F.xxhash64(F.lower("risk_level")).alias("id"))
    by_level = held.join(keys.filter("is_level").select("id"), "id").groupBy("seq", "id").agg((2 * F.count(F.lit(1))).alias("weight"))
    hits = by_word.unionByName(by_level).join(keys.select("id", "shared"), "id")
    hits = materialise(hits.select("seq", "id", "weight", "shared"), "concept-hits")

    tokens = tokens.join(keys.select("id", "shared"), "id")
    # A query's own words may be many or none; its shared ones are few, as they come from its text.
    groups = tokens.filter("shared").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("id", "times"))).alias("group"))
    groups = materialise(groups.withColumn("group_id", F.to_json(c("group"))), "concept-groups")
    of_group = groups.select("query_id", "group_id")
    parts = groups.select("group_id", "group").distinct().select("group_id", F.explode("group").alias("g")).select("group_id", "g.id", "g.times")
    by_group = hits.filter("shared").join(parts, "id").groupBy("group_id", "seq").agg(F.sum(c("weight") * c("times")).alias("score"))
    by_group = materialise(by_group, "concept-by-group")
    best = top_per_key(by_group, ["group_id"], [c("score").desc(), c("seq")], limit)
    alone = of_group.join(best, "group_id").select("query_id", "seq", "score")
    own = hits.filter(~c("shared")).join(tokens.filter(~c("shared")).select("id", "query_id", "times"), "id")
    own = own.groupBy("query_id", "seq").agg(F.sum(c("weight") * c("times")).alias("score")).join(of_group, "query_id", "left")
    full = own.join(by_group.withColumnRenamed("score", "more"), ["group_id", "seq"], "left")
    full = full.select("query_id", "seq", (c("score") + F.coalesce("more", F.lit(0))).alias("score"))
    # An article found both ways has its whole score from its own words.
    scored = full.unionByName(alone).groupBy("query_id", "seq").agg(F.max("score").alias("score"))
    return top_per_key(scored, ["query_id"], [c("score").desc(), c("seq")], limit, "rank")


# ------------------------------------------------------------- around one article or term


def related(articles: DataFrame, dictionary: DataFrame, focus: int, k: int = 5, least: int = 3) -> DataFrame:
    """Articles sharing words, entities or the category with one article.

    The article's words and entities are a single-row scalar subquery; the other
    articles are scored in one scan and cut by a top-k.
    """
    text = F.lower(F.concat_ws(" ", c("title"), c("summary")))
    stop = F.array(*[F.lit(w) for w in V.RELATED_STOPWORDS])
    one = articles.filter(c("seq") == focus)
    words = F.array_except(F.array_distinct(F.filter(F.split(text, r"[^a-z0-9']+"), lambda w: F.length(w) > 3)), stop)
    names = match_entities(one, dictionary, F.concat_ws(" ", c("title"), c("summary")))
    # At most ten names, the limit of the mention operator.
    keys = names.agg(F.collect_list(F.lower("name"))).scalar()

    def hits(items: Column, weight: int) -> Column:
        return F.size(F.filter(items, lambda w: F.contains(c("_text"), w))) * weight

    return (
        articles.filter(c("seq") != focus)
        .withColumns({"_text": text, "_words": one.select(words).scalar(), "_names": keys,
                      "_url": one.select("url").scalar(), "_category": one.select("category").scalar()})
        .filter(c("url") != c("_url"))
        .withColumn("score", hits(c("_words"), 1) + hits(c("_names"), 4)
                    + F.when(c("category").eqNullSafe(c("_category")), 1).otherwise(0))
        .filter(c("score") >= least)
        .orderBy(c("score").desc(), "seq")
        .limit(k)
        .select("seq", "score")
    )


def trace(articles: DataFrame, dictionary: DataFrame, register: DataFrame, text: str, rows: int = 8,
          entities: int = 4, elevated: int = 50) -> DataFrame | None:
    """What is held on a term: known entities, register rows, coverage; None for a short term."""
    q = text.strip().lower()
    if len(q) < 3:
        return None
    needle = F.lit(q)
    risk = F.coalesce(T.non_empty(c("risk")), F.lit("Low")) if "risk" in dictionary.columns else F.lit("Low")
    known = dictionary.filter(F.contains(F.lower("name"), needle)).orderBy("entity_seq").limit(entities).select(
        F.lit(0).alias("part"), c("entity_seq").cast("bigint").alias("pos"),
        F.when(c("type") == "psc", "Beneficial owner").otherwise(c("type")).alias("kind"), c("name").alias("label"),
        F.concat(F.lit("tracked in the knowledge graph · risk "), risk).alias("note"))
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c(n), F.lit("")) for n in ("person_name", "company", "vehicle")]))
    party = lambda n: F.coalesce(T.non_empty(c(n)), F.lit("Undisclosed"))
    held = register.filter(F.contains(hay, needle)).orderBy("seq").limit(rows).select(
        F.lit(1).alias("part"), c("seq").cast("bigint").alias("pos"), F.lit("PSC register").alias("kind"),
        F.concat(party("person_name"), F.lit(" → "), party("company")).alias("label"),
        F.concat(F.coalesce(T.non_empty(c("nature_of_control")), F.lit("nature not disclosed")),
                 F.when(F.coalesce(c("percentage"), F.lit("")) != "", F.concat(F.lit(" · "), c("percentage"))).otherwise("")).alias("note"))
    seen = articles.filter(F.contains(F.lower(F.concat_ws(" ", c("title"), c("summary"))), needle)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("risk_score") >= elevated).alias("high")).filter("n > 0").select(
        F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit("Coverage").alias("kind"),
        F.concat(c("n").cast("string"), F.lit(" articles mention this")).alias("label"),
        F.when(c("high") > 0, F.concat(c("high").cast("string"), F.lit(" scored at elevated risk or above"))).otherwise(
            "none scored above the elevated-risk threshold").alias("note"))
    return known.unionAll(held).unionAll(seen).orderBy("part", "pos").limit(rows)
