"""Operators on small fixtures, against brute force where the result depends on order."""
import collections
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from ownerlens import schemas, vocab as V
from ownerlens.functions import similarity
from ownerlens.operators import dedup, evals, extract, graph, ingest, psc, publish, registers, resolve, search, stats, vectors
from ownerlens.operators.keys import first_per_key, global_rank, top_per_key
from ownerlens.sources import feeds, jsonl
from ownerlens.streaming import feed

c = F.col
WORDS = "hill bank lagoon group acquires stake board fine tender notice merger court".split()


def titles(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 8)))
        if out and rng.random() < 0.4:
            chars = list(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                if chars:
                    chars[rng.randrange(len(chars))] = rng.choice("abcé ")
            text = "".join(chars)
        out.append(text)
    return out


def greedy(values, close):
    kept = []
    for i, x in enumerate(values):
        if not any(close(x, values[j]) for j in kept):
            kept.append(i)
    return kept


def overlap(a, b):
    x, y = set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize("chunk", [7, 1024])
def test_fuzzy_titles_equal_the_sequential_pass(spark, chunk):
    rows = [t.strip() for t in titles(90, 3)]
    df = spark.createDataFrame(list(enumerate(rows)), "seq bigint, title string").repartition(3)
    got = sorted(r["seq"] for r in dedup.fuzzy_titles(df, chunk=chunk).collect())
    filled = [(i, t) for i, t in enumerate(rows) if t]
    close = lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.70 or overlap(a, b) >= 0.65
    want = [filled[k][0] for k in greedy([t for _, t in filled], close)]
    assert got == want


def prose(rng, n):
    """Invented words of two or three syllables, about ``n`` characters of them."""
    out = ""
    while len(out) < n:
        out += "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.choice([2, 2, 3]))) + " "
    return out[:n].strip()


def test_whole_titles_are_aligned_for_few_pairs(monkeypatch):
    """most pairs with common characters are told apart by those of a part of the alphabet; the matches stay exact."""
    rng = random.Random(5)
    kept = [prose(rng, rng.choice([90, 130, 170])) for _ in range(90)]
    new = [prose(rng, 130) for _ in range(30)] + [k[:100] + prose(rng, 30) for k in kept[:10]] + [k + " again" for k in kept[20:25]]
    aligned, bounds = [], similarity.lcs_bounds
    monkeypatch.setattr(similarity, "lcs_bounds", lambda left, *rest: aligned.append(len(rest[-1]) if hasattr(left, "hist") else 0) or bounds(left, *rest))
    for jaccard in (None, 0.65):
        close = lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.70 or (jaccard is not None and overlap(a, b) >= jaccard)
        matcher = similarity.TextMatcher(0.70, jaccard=jaccard)
        aligned.clear()
        assert matcher.any_close(new, kept).tolist() == [any(close(a, b) for b in kept) for a in new]
        assert 0 < sum(aligned) < len(new) * len(kept) / 20
        assert np.flatnonzero(matcher.greedy(kept[:40] + new)).tolist() == greedy(kept[:40] + new, close)


def test_ratios_are_decided_exactly():
    """a ratio that is decided early is decided as the whole one, long strings with their frequent characters included."""
    rng = random.Random(6)
    kept = ["", "x", "abab", *(prose(rng, n) for n in (20, 60, 199, 200, 260))]
    new = kept + [k[: len(k) // 2] + prose(rng, len(k) // 2) for k in kept] + [k[::-1] for k in kept] + [k.replace("a", "") for k in kept]
    for least, strict in ((0.70, False), (0.85, True), (1.0, False)):
        ratios = similarity.Ratios(kept, similarity.TextMatcher(least, strict)._passes)
        for a in new:
            for j, b in enumerate(kept):
                score = SequenceMatcher(None, a, b).ratio()
                assert ratios.pass_(a, j) == (score > least if strict else score >= least)


def test_texts_are_written_for_new_articles_alone(spark, monkeypatch):
    """what repeats a stored article, or is not English, is held against the store as a vector and not as a text."""
    base = "the board of the bank is to meet in the city and it was said that the {} has a {} for the {}"
    rows = [(i, f"Title {i}", base.format(*[f"w{i}{x}" for x in "abc"])) for i in range(6)]
    rows += [(6, "Title 6", rows[0][2]), (6, "Titre 6", "bonjour tout le monde ici"), (7, "Titre 7", "bonjour tout le monde"), (None, "No key", rows[1][2])]
    df = spark.createDataFrame(rows, "seq bigint, title string, raw_text string")
    store = extract.hashed_embedding(ingest.cleaned(df.filter("seq IN (0, 1)")), "seq", "cleaned_text").withColumn("seq", c("seq") + 100)
    written, write = [], ingest.materialise
    monkeypatch.setattr(ingest, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    far = 1e-6
    got = ingest.new_articles(df, store, far).orderBy("seq").collect()
    assert [(r["seq"], r["title"], r["raw_text"]) for r in got] == [r for r in rows[:6] if r[0] > 1] and len(got[0]["embedding"]) == 64
    assert {r["seq"] for table in written if "raw_text" in table.columns for r in table.collect()} == {2, 3, 4, 5}
    # A key that is new keeps its English rows only.
    assert sorted((r["seq"], r["title"]) for r in ingest.new_articles(df.filter("seq >= 6"), store.limit(0), far).collect()) == [(6, "Title 6")]


def test_chain_keeps_both_ends(spark):
    rows = [(0, "alpha beta gamma delta"), (1, "alpha beta gamma delta eps zeta"), (2, "beta gamma delta eps zeta eta theta iota")]
    df = spark.createDataFrame(rows, "seq bigint, title string")
    assert sorted(r["seq"] for r in dedup.word_set_titles(df).collect()) == [0, 2]


def test_unlike_titles_with_common_words_are_settled_at_once(spark, monkeypatch):
    """rounds do not grow with the titles that share a word and are unlike."""
    import itertools

    names, write = [], dedup.materialise
    monkeypatch.setattr(dedup, "materialise", lambda df, name: names.append(name) or write(df, name))
    rows = [" ".join(t) for t in itertools.combinations("ann bob cat dan eve fay gus hal ida".split(), 3)]
    df = spark.createDataFrame(list(enumerate(rows)), "seq bigint, title string")
    assert dedup.word_set_titles(df, first_width=1).count() == len(rows) == 84
    assert names.count("undecided") == 1


def test_word_sets_in_chunks_and_cells(spark, monkeypatch):
    """Chunks, cells and the number of earlier titles one waits for do not change what is kept."""
    for name, value in (("FIRST", 24), ("GROWTH", 3), ("TOKEN_CELL", 3)):
        monkeypatch.setattr(dedup, name, value, raising=False)
    rng = random.Random(4)
    rows = [" ".join(rng.sample(WORDS[:14], rng.randint(3, 7))) for _ in range(90)] + ["--", "!!"]
    df = spark.createDataFrame([*enumerate(rows), (None, rows[0])], "seq bigint, title string").repartition(5)
    got = sorted(r["seq"] for r in dedup.word_set_titles(df, first_width=4).collect())
    low = [r.lower() for r in rows[:90]]
    assert got == greedy(low, lambda a, b: overlap(a, b) >= 0.65) + [90, 91]


def test_funnel_searches_whole_texts_once(spark, monkeypatch):
    """the flags of the gates are written once, for the counts and for the fresh titles."""
    from types import SimpleNamespace

    from ownerlens.operators import gates
    from ownerlens.plans import feed_queries

    calls, flags = [], gates.gate_flags
    monkeypatch.setattr(gates, "gate_flags", lambda *args: calls.append(args) or flags(*args))
    day = F.lit(feed_queries.AS_OF).cast("timestamp_ntz")
    rows = spark.range(1, 9).select(
        F.col("id").alias("seq"), F.lit("https://a.example.ng/1").alias("url"), F.lit("bank").alias("source"),
        F.when(F.col("id") == 8, "Home").otherwise(F.concat(F.lit("Nigeria bank acquires stake "), F.col("id") % 2)).alias("title"),
        F.lit("Lagos, Nigeria").alias("raw_text"), F.when(F.col("id") != 7, day).alias("published_at"))
    t = SimpleNamespace(articles_v=rows, headlines=lambda: rows.drop("raw_text"))
    (got,) = feed_queries.agg20(t).collect()
    assert got.asDict() == {"raw": 8, "stubs": 1, "country": 7, "undated": 1, "fresh": 6, "distinct_stories": 1}
    assert len(calls) == 1


@pytest.mark.parametrize("width", [1, 64])
def test_word_sets_equal_the_sequential_pass(spark, width):
    rows = [t.strip() for t in titles(80, 5)]
    df = spark.createDataFrame(list(enumerate(rows)), "seq bigint, title string")
    got = sorted(r["seq"] for r in dedup.word_set_titles(df, first_width=width).collect())
    filled = [(i, t) for i, t in enumerate(rows) if t]
    assert got == [filled[k][0] for k in greedy([t for _, t in filled], lambda a, b: overlap(a, b) >= 0.65)]


def test_vectors_equal_the_sequential_pass(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 8))
    rows = [(base[rng.integers(12)] + rng.normal(scale=0.25, size=8)).tolist() for _ in range(80)]
    cos = lambda a, b: 1 - np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    data = [(i, v) for i, v in enumerate(rows)] + [(100, []), (101, None), (102, [0.0] * 8)]
    df = spark.createDataFrame(data, "seq bigint, embedding array<double>")
    got = sorted(r["seq"] for r in dedup.distinct_vectors(df, chunk=9).collect())
    assert got == greedy(rows, lambda a, b: cos(a, b) < 0.15) + [100, 101, 102]
    fresh = dedup.unlike_stored(df.filter("seq >= 40"), df.filter("seq < 40"), chunk=11)
    want = [i for i in range(40, 80) if not any(cos(rows[i], rows[j]) < 0.15 for j in range(40))]
    assert sorted(r["seq"] for r in fresh.collect()) == want + [100, 101, 102]


def test_blocks_of_vectors_are_few_and_multiplied_in_slices(spark, monkeypatch):
    """5,000 vectors are one block, met once by every query; what a task holds at once changes nothing."""
    df = spark.range(5000).select(c("id").alias("seq"), F.array(F.cos(c("id")), F.sin(c("id"))).alias("embedding"))
    asked = df.limit(3).select(c("seq").alias("query_id"), "embedding")
    calls = vectors.block_products(df, asked, lambda q, v: q[["query_id"]].assign(n=len(v)), "query_id bigint, n bigint").collect()
    assert sorted(map(tuple, calls)) == [(0, 5000), (1, 5000), (2, 5000)]
    rng = np.random.default_rng(4)
    new, kept = rng.normal(size=(70, 4)), rng.normal(size=(30, 4))
    want = (1 - (new / np.linalg.norm(new, axis=1)[:, None]) @ (kept / np.linalg.norm(kept, axis=1)[:, None]).T < 0.15).any(axis=1)
    for product in (1, 64, 1 << 22):
        monkeypatch.setattr(similarity, "_PRODUCT", product)
        assert (similarity.VectorMatcher(0.15).any_close(list(new), list(kept)) == want).all()


def test_entity_resolution_stages(spark):
    entities = spark.createDataFrame(
        [(1, "company", "Lagoon Holdings", ["Lagoon Hldgs"]), (2, "company", "Hill Bank", ["HB"]), (3, "person", "Ada Obi", [])],
        "entity_id bigint, type string, name string, aliases array<string>")
    names = [("company", " Lagoon Holdings "), ("company", "lagoon hldgs"), ("company", "Lagoon Holding"), ("company", "HILL BANK"),
             ("person", "Hill Bank"), ("company", "New Harbour Limited"), ("company", "New Harbour Limitd"), ("person", "Ada Obie")]
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "seq bigint, type string, name string")
    got = {(r["type"], r["name"]): (r["entity_id"], r["stage"]) for r in resolve.resolve(df, entities).collect()}
    assert got[("company", "Lagoon Holdings")] == (1, "exact") and got[("company", "lagoon hldgs")] == (1, "alias")
    assert got[("company", "Lagoon Holding")] == (1, "fuzzy") and got[("company", "HILL BANK")] == (2, "fuzzy")
    assert got[("person", "Hill Bank")] == (4, "new") and got[("person", "Ada Obie")] == (3, "fuzzy")
    assert got[("company", "New Harbour Limited")] == (5, "new") and got[("company", "New Harbour Limitd")] == (5, "joined new")


def test_fuzzy_best_equals_brute_force(spark):
    rng = random.Random(2)
    known = [" ".join(rng.choice(["hill", "lagoon", "bank", "group", "plc"]) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    asked = ["".join(ch for ch in rng.choice(known) if rng.random() > 0.12) for _ in range(60)]
    asked = [a for a in dict.fromkeys(asked) if a]
    k = spark.createDataFrame([(i, "company", n) for i, n in enumerate(known)], "entity_id bigint, type string, name string")
    m = spark.createDataFrame([(i, "company", n) for i, n in enumerate(asked)], "mention_id bigint, type string, name string")
    got = {r["mention_id"]: r["entity_id"] for r in resolve.fuzzy_best(m, k).collect()}
    want = {}
    for i, a in enumerate(asked):
        score, best = max((SequenceMatcher(None, a, n).ratio(), -j) for j, n in enumerate(known))
        if score > 0.8:
            want[i] = -best
    assert got == want


@pytest.mark.parametrize("cell", [7, 1000])
def test_fuzzy_best_hands_on_one_row_a_name(spark, cell):
    """Cells of any size give the best of all; ties, copies, long and empty names, and rows without a type or a name."""
    rng = random.Random(11)
    known = [(i, rng.choice("pq"), "".join(rng.choices("abcAB é", k=rng.randint(0, 9)))) for i in range(150)] + [(150, "p", "x" * 200 + "y" * 90), (151, None, "ab"), (152, "p", None)]
    known += [(i + 200, t, n) for i, t, n in known]
    asked = [(i, rng.choice("pqr"), "".join(rng.choices("abcAB é", k=rng.randint(0, 9)))) for i in range(150)] + [(150, "p", "x" * 190 + "y" * 85), (151, None, "ab"), (152, "p", None), (153, "p", "ab"), (154, "p", "AB")]
    k = spark.createDataFrame(known, "entity_id bigint, type string, name string")
    m = spark.createDataFrame(asked, "mention_id bigint, type string, name string")
    want = {}
    for i, t, a in asked:
        scores = [(SequenceMatcher(None, a.lower(), n.lower()).ratio(), -j) for j, u, n in known if a is not None and n is not None and t is not None and u == t]
        if scores and max(scores)[0] > 0.8:
            want[i] = (-max(scores)[1], max(scores)[0])
    got = resolve.fuzzy_best(m, k, cell).collect()
    assert len(got) == len(want) > 20 and {r["mention_id"]: (r["entity_id"], r["score"]) for r in got} == want


def test_fuzzy_best_shuffles_no_candidate_pairs(spark):
    """All names share their beginning; the rows handed on are matches, not pairs."""
    k = spark.createDataFrame([(i, "p", f"alias {x}") for i, x in enumerate("".join(random.Random(i).choices("abcdefghij", k=9)) for i in range(300))], "entity_id bigint, type string, name string")
    m = k.select(c("entity_id").alias("mention_id"), "type", "name")
    plan = resolve.fuzzy_best(m, k)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "mention_id" in plan
    assert sorted((r["mention_id"], r["entity_id"]) for r in resolve.fuzzy_best(m, k).collect()) == [(i, i) for i in range(300)]


def test_global_rank_counts_every_row(spark):
    df = spark.range(0, 5000, 7).repartition(5).withColumn("seq", c("id") * c("id"))
    ranks = [r["rank"] for r in global_rank(df, c("seq")).orderBy("seq").collect()]
    assert ranks == list(range(1, len(ranks) + 1))
    assert global_rank(df.limit(0), c("seq")).count() == 0


def test_top_per_key_cuts_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", c("id") % 3)
    plan = first_per_key(df, ["k"], ("id",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top_per_key(df, ["k"], [c("id").desc()], 2).count() == 6


REGISTER = "seq bigint, person_name string, company string, nature_of_control string, percentage string, direct_pct string, indirect_pct string, voting_pct string, vehicle string, previous_holder string, change_type string, pep_status string, filing_ref string, date string, source string"


def holding(seq, person="Ada", company="Hill", nature="shares", pct="10%", direct="", indirect="", voting="", vehicle="", previous="",
            change="", pep="No", ref="", on="2024-01-01", source="extracted"):
    return (seq, person, company, nature, pct, direct, indirect, voting, vehicle, previous, change, pep, ref, on, source)


def flags(spark, *rows):
    df = psc.annotate(spark.createDataFrame(list(rows), REGISTER))
    return {r["seq"]: [f["id"] for f in r["flags"]] for r in df.collect()}


def test_red_flags(spark):
    got = flags(
        spark, holding(1, "A", "One", pct="4.7%"), holding(2, "B", "One", pct="4.9%"), holding(3, "C", "Two", pct="4.7%"),
        holding(4, "D", "Three", direct="10%", indirect="5%", voting="39.8%"), holding(5, "E", "Four", pct="20", voting="35"),
        holding(6, "F", "Five", vehicle="Hill Nominees (Mauritius) Ltd", pep="Yes - exposed"), holding(7, "G", "Six", vehicle=" Direct "),
        holding(8, "H", "Seven", previous="Old", change="Increased Control"), holding(9, "I", "Eight", pct="banana", nature=" "),
        holding(10, "J", "Nine"), holding(11, " j ", "Ten"), holding(12, "K", "Nine"), holding(13, "k", "nine "))
    assert got == {
        1: ["R1_SUB_THRESHOLD"], 2: ["R1_SUB_THRESHOLD"], 3: [], 4: ["R3_VOTING_MISMATCH"], 5: [],
        6: ["R7_SECRECY_VEHICLE", "R9_PEP", "R4_NOMINEE"], 7: [], 8: ["R8_RAPID_CHANGE"], 9: ["R6_UNKNOWN_OWNER"],
        10: ["R12_CROSS_ENTITY"], 11: ["R12_CROSS_ENTITY"], 12: [], 13: []}


def test_register_dedup_is_idempotent(spark):
    df = spark.createDataFrame([holding(1), holding(2, " ADA ", "hill"), holding(3, on="2024-02-01"), holding(4, nature="votes"), holding(5, pct="11%")], REGISTER)
    once = psc.deduplicate(df)
    assert sorted(r["seq"] for r in once.collect()) == [1, 3, 4, 5]
    assert once.exceptAll(psc.deduplicate(once)).isEmpty()


def test_portfolio_of_an_empty_register(spark):
    row = psc.summarise(spark.createDataFrame([], REGISTER)).first()
    assert row["total"] == 0 and row["mean_stake"] is None and row["disclosure_rate"] is None and row["is_demo"] is False


def test_company_snapshot_merges(spark):
    cols = "seq bigint, company string, seen_at string, industry string, risk_level string"
    a = registers.upsert_companies(spark.createDataFrame([(1, "Hill Bank", "2024-01-01", "", "High"), (2, " hill bank ", "2024-01-02", "Banking", "")], cols))
    b = registers.upsert_companies(spark.createDataFrame([(3, "HILL BANK", "2024-01-03", "", ""), (4, "", "2024-01-03", "", "")], cols), a)
    assert [tuple(r) for r in b.select("company", "mention_count", "last_seen", "industry", "risk_level").collect()] == [
        ("Hill Bank", 3, "2024-01-03", "Banking", "High")]


def test_migration_by_name(spark):
    assert registers.column_changes(["a", " c ", "old", " "], ["a", "b", "c"]) == {"b": "added", "old": "removed"}
    assert registers.column_changes(["c", " a"], ["a", "c"]) == {}
    df = registers.migrate(spark.createDataFrame([("1", "2", None)], "a string, c string, old string"), ["a", "b", "c"])
    assert tuple(df.first()) == ("1", "", "2")
    assert registers.migrate(df, ["a", "b", "c"]).exceptAll(df).isEmpty()


def test_article_ids_continue(spark):
    store = spark.createDataFrame([("5.0", "u1"), ("x", "u2")], "id string, url string")
    new = spark.createDataFrame([(1, "u1"), (2, "u3"), (3, "u3"), (4, "u4")], "seq bigint, url string")
    assert {r["url"]: r["id"] for r in registers.add_articles(new, store).collect()} == {"u3": 6, "u4": 7}


def test_snapshot_replay_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "snap")
    for _ in range(2):
        registers.write_snapshot(spark.range(3), root, 0)
    registers.write_snapshot(spark.range(5), root, 1)
    assert registers.read_snapshot(spark, root).count() == 5 and registers.read_snapshot(spark, root, before=1).count() == 3
    assert registers.read_snapshot(spark, root, before=0) is None


def test_extraction_fails_closed(spark):
    rows = spark.createDataFrame([(1, '{"category": "Legal"}'), (2, '{"relevant": true}'), (3, "no"), (4, '{"relevant":')], "seq bigint, reply string")
    e = extract.from_replies(rows).select("seq", extract.with_defaults(c("extraction")).alias("extraction"))
    got = {r["seq"]: r["extraction"] and r["extraction"]["relevant"] for r in e.collect()}
    assert got == {1: False, 2: True, 3: None, 4: None}
    assert extract.run_health(e).first()["verdict"] == "degraded"
    with pytest.raises(extract.ExtractionFailed):
        extract.require_health(e)


def test_relations(spark):
    rows = spark.createDataFrame([(1, "Hill Bank appoints Chairman Ada Obi. Hill Bank will suspend trading. CEO Musa Bello retires from Hill Bank. Hill Bank acquired Lagoon Group.")], "seq bigint, text string")
    rows = rows.withColumn("entities", extract.named_entities(c("text")))
    got = [(r["subject"], r["predicate"], r["object"]) for r in extract.relations(rows).orderBy("sentence_no").collect()]
    assert got == [("Hill Bank", "appointed", "Ada Obi"), ("Musa Bello", "resigned from", "Hill Bank"), ("Hill Bank", "acquired", "Lagoon Group")]


@pytest.mark.parametrize("window,piece", [(32, 16384), (8, 5)])
def test_entity_matching_finds_substrings(spark, monkeypatch, window, piece):
    """Inside one piece of text and across its borders; keys within a window and beyond it."""
    monkeypatch.setattr(extract, "WINDOW", window)
    monkeypatch.setattr(extract, "PIECE", piece)
    monkeypatch.setattr(extract, "STRIP", min(piece, 128))
    arts = spark.createDataFrame([(1, "xhill bankx and LAGOON"), (2, "abc")], "seq bigint, t string")
    names = spark.createDataFrame([(7, "Hill Bank", "company"), (8, "hill bank", "company"), (9, "abc", "person"), (5, " Lagoon ", "person")], "entity_seq bigint, name string, type string")
    assert [(r["seq"], r["entity_seq"]) for r in extract.match_entities(arts, names, c("t")).orderBy("seq", "entity_seq").collect()] == [(1, 5), (1, 7)]


@pytest.mark.parametrize("window,piece", [(32, 16384), (7, 9)])
def test_batch_search_equals_a_plain_scan(spark, monkeypatch, window, piece):
    monkeypatch.setattr(extract, "WINDOW", window)
    monkeypatch.setattr(extract, "PIECE", piece)
    monkeypatch.setattr(extract, "STRIP", min(piece, 128))
    rnd = random.Random(6)
    texts = [(i, "".join(rnd.choices("abcé ", k=rnd.randint(0, 60))), f"2024-01-{rnd.randint(1, 28):02d}") for i in range(80)]
    asked = [(i, "".join(rnd.choices("abcÉ", k=rnd.randint(0, 6)))) for i in range(60)] + [(60 + i, texts[i][1][i : i + 8 + i]) for i in range(20)]
    arts = spark.createDataFrame([*texts, (90, None, "2024-01-01")], "seq bigint, t string, published_at string")
    got = {(r["query_id"], r["seq"], r["rank"]) for r in search.batch_keyword(arts, spark.createDataFrame(asked, "query_id bigint, query string"), c("t"), 3).collect()}
    want = set()
    for q, words in asked:
        hits = sorted((t for t in texts if words and words.lower() in t[1].lower()), key=lambda t: (-int(t[2][-2:]), t[0]))
        want |= {(q, t[0], k + 1) for k, t in enumerate(hits[:3])}
    assert got == want


def test_employment_state(spark):
    rows = [(1, "Ada", "Hill", "appointed"), (2, "Ada", "Hill", "resigned from"), (3, "Ada", "Bank", "appointed"), (4, "Ada", "Hill", "appointed"), (5, "Eke", "Hill", "appointed")]
    df = spark.createDataFrame(rows, "seq bigint, person string, company string, predicate string")
    assert {(r["company"], r["person"]) for r in graph.executives(df).collect()} == {("Hill", "Ada"), ("Bank", "Ada"), ("Hill", "Eke")}
    assert {r["person"]: r["position"] for r in graph.current_position(df).collect()} == {"Ada": "Executive at Bank", "Eke": "Executive at Hill"}


def _pair(spark, gold, pred, title="Board change", text="Ada holds 30% of Hill."):
    schema = schemas.EXTRACTION.simpleString()
    return spark.createDataFrame([(title, text, gold, pred)], f"title string, article_text string, gold {schema}, pred {schema}")


def _ex(**fields):
    base = {"relevant": True, "category": "Company", "event_type": "Merger", "risk_score": 50, "risk_level": "Low", "importance_score": 50,
            "summary": "", "organizations": [{"name": "Hill", "type": "company"}], "people": [], "significant_control": [], "procurement": None}
    return {**base, **fields}


def _psc(name="Ada", pct=None):
    return {f.name: {"name": name, "organization": "Hill", "percentage": pct}.get(f.name) for f in schemas.HOLDING.fields}


@pytest.mark.parametrize("gold, pred, score", [
    (_ex(), _ex(), 1.0), (_ex(), _ex(category="Legal"), round(8.5 / 9.5, 4)), (_ex(risk_score=50), _ex(risk_score=70), 1.0),
    (_ex(risk_score=50), _ex(risk_score=71), round(9 / 9.5, 4)), (_ex(relevant=False), _ex(relevant=False, category="x"), 1.0),
    (_ex(), _ex(relevant=False), 0.0), (_ex(), _ex(significant_control=[_psc(pct="31%")]), 0.0),
    (_ex(significant_control=[_psc()]), _ex(significant_control=[_psc(" ADA ", "30%")]), 1.0),
    (_ex(significant_control=[_psc()]), _ex(), round(6.5 / 9.5, 4)), (_ex(), _ex(organizations=[{"name": "Reuters", "type": "company"}]), 0.0),
    (_ex(significant_control=[_psc()]), _ex(significant_control=[_psc()], people=[{"name": "ada", "position": None, "organization": "hill", "event": None}]), round(8.5 / 10.5, 4)),
])
def test_extraction_score(spark, gold, pred, score):
    row = evals.feedback(_pair(spark, gold, pred)).first()
    assert row["score"] == pytest.approx(score, abs=1e-4)
    assert (row["feedback"] in ("Correct", "Correctly not relevant")) == (score == 1.0)


def test_off_topic_extraction_scores_zero(spark):
    assert evals.score(_pair(spark, _ex(), _ex(), title="Lagoon FC beat Hill FC")).first()["score"] == 0.0


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(50).withColumnRenamed("id", "seq")
    one = {r["seq"]: r["split"] for r in evals.split(df, c("seq")).collect()}
    two = {r["seq"]: r["split"] for r in evals.split(df.repartition(7), c("seq")).collect()}
    assert one == two and list(one.values()).count("val") == 15
    assert evals.split(df.limit(1), c("seq")).first()["split"] == "val"


def test_payloads_and_rss(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"response": {"results": [{"webTitle": "T", "webUrl": "u", "fields": {"bodyText": ""}}]}}')
    assert feeds.read_payloads(spark, str(tmp_path / "a.json"), "guardian").first()["raw_text"] == "T"
    item = "<item><title>A &amp;amp; B</title><link>{}</link></item>"
    (tmp_path / "f1.xml").write_text(f"<rss><channel>{item.format('u1')}{item.format('u1')}{item.format('u2')}</channel></rss>")
    rows = {r["url"]: r for r in feeds.read_rss(spark, str(tmp_path / "f1.xml")).collect()}
    assert set(rows) == {"u1", "u2"} and rows["u1"]["title"] == "A & B" == rows["u1"]["raw_text"] and rows["u1"]["source"] == "Google News"


def test_jsonl_line_numbers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('// note\n\n{"title": "a"}\n{broken\n{"title": "b"}\n')
    rows = jsonl.read_jsonl(spark, str(path), schemas.CORPUS).orderBy("line_no").collect()
    assert [(r["line_no"], r["valid"], r["record"] and r["record"]["title"]) for r in rows][0::2] == [(3, True, "a"), (5, True, "b")]
    assert rows[1]["line_no"] == 4 and not rows[1]["valid"]


def test_streams_resume_and_replay(spark, tmp_path):
    landing, root, state = (str(tmp_path / n) for n in ("in", "reg", "state"))
    cols = "seq bigint, company string, seen_at string, industry string, risk_level string"
    for k in range(2):
        spark.createDataFrame([(k, "Hill", f"2024-01-0{k + 1}", "", "")], cols).write.mode("append").parquet(landing)
        feed.upsert_companies(spark.readStream.schema(cols).parquet(landing), root, state)
    feed.upsert_companies(spark.readStream.schema(cols).parquet(landing), root, state)
    assert registers.read_buckets(spark, root).first()["mention_count"] == 2


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    root, cols = str(tmp_path / "reg"), "seq bigint, company string, seen_at string, industry string, risk_level string"
    key = F.lower(F.trim("company"))
    batch = lambda names, start: spark.createDataFrame([(start + i, n, "2024-01-01", "", "") for i, n in enumerate(names)], cols)
    names = [f"Company {i}" for i in range(100)]
    assert len(registers.merge_buckets(batch(names, 0), root, 0, key, registers.upsert_companies, 16)) == 16
    for _ in range(2):  # the second time as a replay
        touched = registers.merge_buckets(batch(["company 7", " COMPANY 7"], 100), root, 1, key, registers.upsert_companies, 16)
        assert len(touched) == 1
        held = {r["company"]: r["mention_count"] for r in registers.read_buckets(spark, root).collect()}
        assert held == {n: 3 if n == "Company 7" else 1 for n in names}
    written = lambda v: {p.name for p in (tmp_path / "reg" / "rows" / f"version={v:012d}").glob("bucket=*")}
    assert written(1) == {f"bucket={touched[0]}"} and len(written(0)) == 16
    again = registers.merge_buckets(batch(["Company 7"], 200), root, 2, key, registers.upsert_companies, 16)
    # What neither of the last two pointers names is gone.
    assert again == touched and len(written(0)) == 15 and len(written(1)) == 1
    assert registers.read_buckets(spark, root).filter("company = 'Company 7'").first()["mention_count"] == 4
    assert registers.merge_buckets(batch([], 0), root, 3, key, registers.upsert_companies, 16) == []


def test_routing_counts_what_it_writes(spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    stamps = ["2024-01-01T00:00:00", "", "2024-01-02T00:00:00", None, "soon"]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"title": str(i), "url": str(i), "published_at_raw": s}) for i, s in enumerate(stamps)))
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    assert feed.route_dated(feed.landed_articles(spark, str(tmp_path / "in")), path, state) == {"dated": 2, "undated": 3}
    assert {(r["kind"], r["count"]) for r in spark.read.parquet(path).groupBy("kind").count().collect()} == {("dated", 2), ("undated", 3)}
    assert feed.route_dated(feed.landed_articles(spark, str(tmp_path / "in")), path, state) in ({}, {"dated": 0, "undated": 0})


def test_editions_on_a_stream_leave_out_and_count_late_rows(spark, tmp_path):
    landing, told, state = (str(tmp_path / n) for n in ("in", "told", "state"))
    late = 0
    for stamps in (["2024-01-01 03:00:00", "2024-01-01 12:00:00"], ["2024-01-01 03:30:00", "2024-01-01 13:00:00", "2024-01-02 00:00:00"]):
        spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp").alias("ts")).write.mode("append").parquet(landing)
        stream = feed.windowed_counts(spark.readStream.schema("ts timestamp").parquet(landing), "ts", feed.EDITION, "4 hours")
        late = feed.late_rows(feed.run_available(stream, told, state))
    got = {(str(r["w"]["start"]), r["n"]) for r in spark.read.parquet(told).collect()}
    assert got == {("2024-01-01 02:00:00", 1), ("2024-01-01 10:00:00", 2)} and late == 1


def test_batch_vector_equals_all_distances_over_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    stored = [rng.normal(size=5).round(1).tolist() for _ in range(60)] + [[0.0] * 5, None, []]
    stored[7] = stored[3]
    asked = [stored[3], rng.normal(size=5).tolist(), [0.0] * 5, None, [2 * x for x in stored[9]]]
    v = spark.createDataFrame(list(enumerate(stored)), "seq bigint, embedding array<double>")
    q = spark.createDataFrame([(100 + i, x) for i, x in enumerate(asked)], "query_id bigint, embedding array<double>")
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    want = set()
    for i, x in enumerate(asked):
        if x and any(x):
            near = sorted((round(1 - float(unit(x) @ unit(y)), 9) + 0.0, k) for k, y in enumerate(stored) if y and any(y))
            want |= {(100 + i, k, rank) for rank, (_, k) in enumerate(near[:4], 1)}
    for block in (2048, 7):
        monkeypatch.setattr("ownerlens.operators.vectors.BLOCK", block)
        assert {(r["query_id"], r["seq"], r["rank"]) for r in search.batch_vector(v, q, 4).collect()} == want
    assert search.batch_vector(v.limit(0), q, 4).collect() == []


def test_publish_shows_nothing_of_a_failed_run_and_replays(spark, tmp_path):
    root, cols = str(tmp_path), "seq bigint, url string"
    rows = lambda *r: spark.createDataFrame(list(r), cols)

    def run(number, articles, fails):
        todo = publish.pending(articles, root, number)
        done = todo.withColumn("extraction", F.when(~c("url").isin(fails), F.struct(F.lit(True).alias("relevant"))))
        return publish.publish(done, root, number, ["seq", "url"]).first()["verdict"]

    shown = lambda: None if (p := publish.published(spark, root)) is None else sorted(r["url"] for r in p.collect())
    assert run(1, rows((1, "a"), (2, "b")), ["a", "b"]) == "nothing published" and shown() is None
    for _ in range(2):  # the second time as a replay
        assert run(2, rows((3, "a"), (4, "c")), ["b"]) == "degraded" and shown() == ["a", "c"]
    # A seen URL is not tried again, a dead letter is.
    assert run(3, rows((5, "c"), (6, "d")), []) == "ok" and shown() == ["a", "b", "c", "d"]
    assert publish.finished(spark, root) == {2, 3}


def test_concept_and_trace(spark):
    a = spark.createDataFrame([(1, "Hill merger", "x", "High", 60), (2, "x", "merger", "Low", 10)], "seq bigint, title string, summary string, risk_level string, risk_score int")
    assert [(r["seq"], r["score"]) for r in search.concept(a, "high merger of").collect()] == [(1, 5), (2, 1)]
    assert search.trace(a, a, a, " x ") is None


def test_title_dedup_keeps_the_riskiest(spark):
    rows = [(1, "Hill merger - Hill Post", 10), (2, "Hill merger", 90), (3, "HILL  MERGER!", 90), (4, "Other", 5)]
    got = stats.dedupe_by_title(spark.createDataFrame(rows, "seq bigint, title string, risk_score int")).orderBy("first_seq").collect()
    assert [(r["seq"], r["first_seq"]) for r in got] == [(2, 1), (4, 4)]


def test_a_crowd_of_near_copies(spark):
    rng = random.Random(9)
    crowd = [f"Hill Bank acquires majority stake in Lagoon Group after court notice {i}" for i in range(120)]
    rows = crowd + [" ".join(rng.sample(WORDS, 5)) + f" {i}" for i in range(80)]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "seq bigint, title string")
    low = [r.lower() for r in rows]
    both = lambda a, b: overlap(a, b) >= 0.65 or SequenceMatcher(None, a, b).ratio() >= 0.70
    assert sorted(r["seq"] for r in dedup.fuzzy_titles(df, chunk=16).collect()) == greedy(low, both)
    assert sorted(r["seq"] for r in dedup.word_set_titles(df, first_width=4).collect()) == greedy(low, lambda a, b: overlap(a, b) >= 0.65)


def test_a_hot_company_and_holder(spark):
    rows = [holding(i, f"P{i}" if i % 3 else "Hot Holder", "Hot Company" if i % 2 else f"C{i}", pct="4.5%") for i in range(300)]
    got = flags(spark, *rows)
    assert all(("R1_SUB_THRESHOLD" in f) == bool(i % 2) for i, f in got.items())
    assert all(("R12_CROSS_ENTITY" in f) == (i % 3 == 0) for i, f in got.items())


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1", 'say "x"'), ("b", None)], "a string, b string")
    registers.write_csv(df.coalesce(1), str(tmp_path / "csv"), ["a", "b"])
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes().decode()
    assert text == '"a","b"\r\n"\'=1","say ""x"""\r\n"b",""\r\n'
    from ownerlens.operators import reports

    lines = spark.createDataFrame([(1, 5, 0, "c"), (0, -1, 1, "b"), (0, -1, 0, "a"), (1, 9, 0, "d")], "section int, item bigint, part int, line string")
    reports.write_report(lines.repartition(3), str(tmp_path / "md"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*.txt"))) == "a\nb\nc\nd\n"


def test_empty_run_is_told_from_an_outage(spark):
    some = spark.createDataFrame([("u1",)], "url string")
    none = some.limit(0)
    texts = [[r["generated"] for r in registers.empty_run_record(a, b, "2024-01-01").collect()] for a, b in ((some, some), (none, some), (some, none))]
    assert texts == [["No significant change."], ["No articles were fetched this cycle."], []]


def test_report_window_falls_back(spark):
    df = spark.sql("SELECT id AS seq, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS published_at FROM range(40)")
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    assert stats.report_window(df, at("2024-01-02 00:00:00")).count() == 40
    assert stats.report_window(df, at("2024-01-10 00:00:00")).count() == 25


def test_names_of_any_length(spark):
    text = "Chairman Ada Ngozi Bello Musa met the Federal Republic Nigeria National Petroleum Upstream Bank in New Port Harcourt."
    e = spark.createDataFrame([(text,)], "t string").select(extract.named_entities(c("t")).alias("e")).first()["e"]
    assert e["people"] == ["Ada Ngozi Bello Musa"] and e["locations"] == ["New Port Harcourt"]
    assert e["organizations"] == ["Federal Republic Nigeria National Petroleum Upstream Bank"]


def test_several_names_in_one_article(spark):
    mentions = spark.createDataFrame([(1, "company", "Alpha Holdings"), (1, "company", "Zebra Mining"), (2, "company", "Alpha Holdings"), (2, "person", "Alpha Holdings")], "seq bigint, type string, name string")
    entities = spark.createDataFrame([(10, "company", "Alpha Holdings", ["Alpha"]), (11, "company", "Other", [])], "entity_id bigint, type string, name string, aliases array<string>")
    got = {(r["type"], r["name"]): (r["entity_id"], r["stage"]) for r in resolve.resolve(mentions, entities).collect()}
    assert got == {("company", "Alpha Holdings"): (10, "exact"), ("company", "Zebra Mining"): (12, "new"), ("person", "Alpha Holdings"): (13, "new")}


def test_extraction_rows_fit_the_registers(spark):
    record = "relevant boolean, risk_level string, event_type string, organizations array<struct<name:string,type:string>>, people array<struct<name:string,position:string,organization:string,event:string>>"
    ex = spark.createDataFrame([(1, "T", "2024-01-02", (True, "High", "Merger", [("Lagoon Holdings", "company"), ("Works Ministry", "agency")], [("Ada Obi", None, None, None)]))],
                               f"seq bigint, title string, published_at string, extraction struct<{', '.join(x.strip().replace(' ', ':', 1) for x in record.split(', '))}>")
    register = registers.upsert_companies(extract.company_rows(ex)).first()
    assert (register["company"], register["last_seen"], register["risk_level"]) == ("Lagoon Holdings", "2024-01-02", "High")
    assert extract.agency_rows(ex).first()["date"] == "2024-01-02" == extract.people_rows(ex).first()["date"]


@pytest.mark.parametrize("window,piece", [(32, 16384), (5, 11)])
def test_keys_in_words_of_texts_equal_a_plain_scan(spark, monkeypatch, window, piece):
    """No key held against every text: words, parts of words, several words, separators; and the first ids only."""
    for name, n in (("FEW", 0), ("WINDOW", window), ("PIECE", piece), ("STRIP", 4)):
        monkeypatch.setattr(extract, name, n)
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choices("abcé. -", (4, 4, 4, 1, 1, 1, 1), k=rnd.randint(0, 90)))) for i in range(60)] + [(60, "a" * 300), (61, None), (7, "abc abc"), (7, "abc abc")]
    held = {t[1][j : j + rnd.choice((1, 3, 7, 12, 40))] for t in texts[:60] for j in (rnd.randrange(60),)} | {"a" * 299, "a" * 301, "cab", ".", " . ", "zz", "b zz"}
    keys = [(i, k) for i, k in enumerate(sorted(held - {""}))]
    want = {(s, i) for s, t in texts for i, k in keys if t and k in t}
    arts, asked = spark.createDataFrame(texts, "seq bigint, t string"), spark.createDataFrame(keys, "id bigint, key string")
    got = [tuple(r) for r in extract.contained_keys(arts, c("t"), asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = {tuple(r) for r in extract.contained_keys(arts, c("t"), asked, 3).collect()}
    assert first == {(s, i) for s, i in want if sum(x == s and j < i for x, j in want) < 3}


def test_texts_are_taken_apart_by_words(spark, monkeypatch):
    """Rows between texts and keys follow the words of the texts, not their characters."""
    made, write = [], extract.materialise
    monkeypatch.setattr(extract, "materialise", lambda df, name: made.append((name, out := write(df, name))) or out)
    arts = spark.createDataFrame([(i, "Thentioned barrelful of it " * 50) for i in range(40)], "seq bigint, t string")
    names = spark.createDataFrame([(i, f"{'barrel' if i else 'thention'}{'x' * i}", "company") for i in range(20)], "entity_seq bigint, name string, type string")
    assert {r["seq"] for r in extract.match_entities(arts, names, c("t")).collect()} == set(range(40))
    assert {name: df.count() for name, df in made}["words"] == 80


def test_batch_search_looks_up_the_best_of_each_word(spark, monkeypatch):
    monkeypatch.setattr(extract, "FEW", 0)
    rows = [(i, f"abcd{i % 5} common x{i}", f"2024-01-{1 + i % 28:02d}") for i in range(200)] + [(5, "abcd0 common x5", "2024-01-06")]
    asked = [(0, "COMMON"), (1, "abcd"), (2, "cd3"), (3, "x19"), (4, "mmon x17"), (5, " "), (6, "none"), (7, "common")]
    arts, queries = spark.createDataFrame(rows, "seq bigint, t string, published_at string"), spark.createDataFrame(asked, "query_id bigint, query string")
    got = sorted((r["query_id"], r["rank"], r["seq"]) for r in search.batch_keyword(arts, queries, c("t"), 8).collect())
    want = [(q, k + 1, t[0]) for q, w in asked for k, t in enumerate(sorted((t for t in rows if w.lower() in t[1]), key=lambda t: (-int(t[2][-2:]), t[0]))[:8])]
    assert got == sorted(want)


@pytest.mark.parametrize("own", [8, 1, 0])
def test_batch_concept_equals_scores_of_all_pairs(spark, monkeypatch, own):
    """Words of many queries, of few, both; levels of risk; articles that come twice; the shared words multiply no queries by articles."""
    for module, name, n in ((search, "OWN", own), (extract, "FEW", 0)):
        monkeypatch.setattr(module, name, n)
    made, write = [], search.materialise
    monkeypatch.setattr(search, "materialise", lambda df, name: made.append((name, out := write(df, name))) or out)
    rnd = random.Random(4)
    words = ["company", "merger", "stake", "board", "bank", "lagoon", "hill", "obi"]
    arts = [(i, " ".join(rnd.choices(words, k=2)), " ".join(rnd.choices(words, k=4)), rnd.choice(["Low", "High", None])) for i in range(60)]
    arts += [arts[3], arts[8]]
    asked = [(i, f"{rnd.choice(words[4:])} {rnd.choice(words)} company{' HIGH risk, high' if i % 2 else ' of'}") for i in range(30)] + [(30, "risk of"), (31, None), (32, "obi unheard")]
    rows = spark.createDataFrame(arts, "seq bigint, title string, summary string, risk_level string")
    queries = spark.createDataFrame(asked, "query_id bigint, query string")
    got = sorted((r["query_id"], r["rank"], r["seq"], r["score"]) for r in search.batch_concept(rows, queries, 5).collect())
    want = []
    for q, text in asked:
        score = collections.Counter()
        for token in [w for w in re.split(r"[^a-z0-9']+", (text or "").lower()) if len(w) > 2 and w != "risk"]:
            for a in arts if token in ("low", "medium", "high", "critical") else set(arts):
                score[a[0]] += (2 * ((a[3] or "").lower() == token) if token in ("low", "medium", "high", "critical") else 3 if token in a[1] else int(token in a[2]))
        best = sorted((-n, s) for s, n in score.items() if n)[:5]
        want += [(q, k + 1, s, -n) for k, (n, s) in enumerate(best)]
    assert got == sorted(want)
    assert own != 8 or {name: df.count() for name, df in made}["concept-by-group"] <= 60 * len({frozenset(a[1].split()) for a in asked if a[1]})


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_defaults_evaluate_a_record_once(spark):
    rows = spark.createDataFrame([(1, '{"category": "Legal"}'), (2, None)], "seq long, reply string")
    read = F.from_json(F.concat(c("reply"), F.lit(" ")), schemas.EXTRACTION)
    out = rows.select("seq", extract.with_defaults(read).alias("e"))
    assert optimized(out).count("from_json") == 1
    assert [(r["e"] and (r["e"]["category"], r["e"]["relevant"], r["e"]["people"])) for r in out.orderBy("seq").collect()] == [("Legal", False, []), None]


def test_enrich_looks_for_what_is_read_only(spark):
    text = "Director Musa Bello resigns from Hill Bank in Abuja. The board met at Port Harcourt on Monday."
    rows = spark.createDataFrame([(1, "T", text), (2, "T", "")], "seq long, title string, raw_text string")
    out = extract.enrich(rows, english_only=False)
    assert "in|at|near" not in optimized(out.select("seq", "sentiment", "risk_level", "category", "importance"))
    e = out.filter("seq = 1").first()["entities"]
    assert (e["people"], e["organizations"], e["locations"], e["positions"]) == (["Musa Bello"], ["Hill Bank"], ["Abuja", "Port Harcourt"], ["Director"])
    assert out.select("seq", extract.named_entities(c("text")).alias("n"), "entities").filter("n <> entities").count() == 0


def test_first_verb_is_the_first_of_the_list(spark):
    texts = ["He will buy, then hire", "no verb here", "HIRED", "reſigned", "rebuy", "Suede shoes", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["v"] for r in rows.select("i", extract.first_verb(c("t")).alias("v")).orderBy("i").collect()] == ["hire", None, "hire", "resign", None, "sue", None]


def test_titles_are_cut_before_the_join(spark, tmp_path):
    from ownerlens.plans.fixtures import Tables

    spark.createDataFrame([(i, f"Text {i} " * 200, "en", "s", 1) for i in range(60)] + [(60, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(70).selectExpr("id AS event_id", "timestamp_ntz'2024-01-03 00:00:00' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    whole = t.articles_v.drop("raw_text")
    assert t.headlines().columns == whole.columns
    assert t.headlines().exceptAll(whole).count() == whole.exceptAll(t.headlines()).count() == 0
    plan = optimized(t.headlines().select("seq", "title"))
    assert "180" in plan[plan.index("Join"):]


@pytest.mark.parametrize("hours", [1, 30])
def test_report_window_joins_few_texts(spark, tmp_path, hours):
    from ownerlens.plans.feed_queries import report_articles
    from ownerlens.plans.fixtures import Tables

    spark.createDataFrame([(i, f"Text {i}", "en", "s", 6) for i in [*range(60), 59, 40]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    # Id 59 has a second row outside the window; hours apart by 30, the window holds too few and the latest 25 count.
    spark.range(60).unionAll(spark.sql("SELECT 59L AS id")).selectExpr(
        "id AS event_id", f"timestamp_ntz'2024-01-03 00:00:00' + make_dt_interval(0, CAST(id * {hours} AS INT)) - IF(monotonically_increasing_id() > 1L << 40, INTERVAL '90' DAY, INTERVAL '0' DAY) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    rows = t.articles_v
    whole = stats.report_window(rows, rows.agg(F.max("published_at")).scalar()).select("seq", "raw_text", "published_at")
    got = report_articles(t)
    assert "LeftSemi" in optimized(got)
    got = got.select("seq", "raw_text", "published_at")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and 20 < got.count() < 35
