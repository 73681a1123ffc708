"""Decontamination: planted, re-parameterised and inconsistent questions; clean texts left alone."""
import random

import pytest

from ownerlens.llm import leaks

ITEMS = [
    (1, "A farmer named John has 12 apples and gives John the driver 5 of them after 3 hours. How many apples does John keep?"),
    (2, "A farmer named Mary has 30 apples and gives Mary the driver 7 of them after 9 hours. How many apples does Mary keep?"),
    (3, "The colour of rivers is decided by silt carried down from far mountains in spring."),
    (4, "Tiny item here"),
    (5, None), (6, ""),
]


def filler(rnd, n):
    return " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(3, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(1)
    around = lambda x: f"{filler(rnd, 40)} {x} {filler(rnd, 40)}"
    rows = [
        (10, around(ITEMS[0][1])), (11, around(ITEMS[2][1])),
        (12, around(ITEMS[0][1].replace("John", "Ahmed").replace("12", "48").replace(" 5 ", " 31 "))),
        (13, around(ITEMS[0][1].replace("named John", "named Paul").replace("does John", "does Susan"))),
        (14, around(ITEMS[2][1][:30])), (15, None), (16, ""), (17, around("tiny item here")), (None, around(ITEMS[2][1])),
        (18, around(ITEMS[1][1] + " " + filler(rnd, 8) + " " + ITEMS[0][1])),
        *[(100 + i, filler(rnd, 80)) for i in range(60)],
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    return docs, bench, leaks.contaminated(docs, bench)


def test_verdicts(found):
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in found[2].collect()}
    assert got == {(10, 1): True, (11, 3): True, (12, 1): False, (None, 3): True, (18, 1): True, (17, 4): True}


def test_first_word_inside_a_sentence(spark):
    bench = spark.createDataFrame([(1, "Rivers carry silt from mountains down")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "and so Rivers carry silt from mountains down there"), (2, "and so rivers carry silt from hills down there")], "doc_id bigint, text string")
    assert [(r["doc_id"], r["coverage"]) for r in leaks.contaminated(docs, bench).collect()] == [(1, 1.0)]


def test_clean_keeps_the_rest(found):
    docs, _, bad = found
    left = leaks.clean(docs, bad)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {13, 14, 15, 16, *range(100, 160)}


def test_tokens():
    kind = lambda w, first=False: leaks.token(w, first)[0]
    assert [kind(x) for x in ("12,", "$3.50", "5%", "7kg", "hours.", "Paris,", "river", "(Blue")] == ["<num>", "<num>", "<num>", "<measure>", "<unit>", "<name>", "river", "<name>"]
    assert kind("Paris", True) == "paris"


def test_windows_equal_a_plain_loop():
    rnd = random.Random(2)
    canon = leaks.Canonical()
    for _ in range(30):
        text = " ".join(rnd.choice(["Ann", "has", "3", "kg", "of", "salt.", "now"]) for _ in range(rnd.randint(0, 40)))
        words, hashes, slot, initial = canon(text)
        first = [i == 0 or words[i - 1].endswith(".") for i in range(len(words))]
        tokens = [leaks.token(w, f) for w, f in zip(words, first)]
        assert initial.tolist() == first and slot.tolist() == [v is not None for _, v in tokens]
        at, h = leaks.windows(hashes, slot, 5)
        want = [i for i in range(len(words) - 4) if sum(v is None for _, v in tokens[i : i + 5]) >= 3]
        assert at.tolist() == want
        same = {tuple(t for t, _ in tokens[i : i + 5]) for i in want}
        assert len(set(h.tolist())) == len(same)


def test_empty_tables(spark, found):
    docs, bench, _ = found
    assert leaks.contaminated(docs.limit(0), bench).count() == 0
    assert leaks.contaminated(docs, bench.limit(0)).count() == 0


def reported(spark, items, texts):
    rnd = random.Random(3)
    docs = [(i, f"{filler(rnd, 30)} {t} {filler(rnd, 30)}") for i, t in enumerate(texts)]
    got = leaks.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    return {(r["doc_id"], r["item_id"]): r["coverage"] for r in got.collect()}


def test_variants_are_not_bound_by_each_others_equal_values(spark):
    items = [(1, "A boy has 5 apples and 5 pears in a basket and eats one."), (2, "A boy has 3 apples and 7 pears in a basket and eats one.")]
    got = reported(spark, items, [items[0][1], items[1][1], items[1][1].replace("3", "8")])
    assert got == {(0, 1): 1.0, (0, 2): 1.0, (1, 2): 1.0, (2, 2): 1.0}


def test_items_poor_in_literals_are_found_verbatim(spark):
    items = [(1, "WHAT IS THE CAPITAL OF THE OLD KINGDOM"), (2, "Call Anna Berg Carl Dahl Emma Falk"), (3, "12 * 7 ="), (4, "15 * 3 ="),
             (5, "When did Anna Berg and Carl Dahl sail to Emma Falk in Oslo with the mail")]
    texts = [items[0][1], items[0][1].lower(), items[1][1], items[1][1].lower(), items[2][1], items[3][1], items[4][1].lower(), items[4][1].upper(), "13 * 7 =", "Call Gina Holm Ivan Juhl Karl Lind"]
    assert reported(spark, items, texts) == {(0, 1): 1.0, (1, 1): 1.0, (2, 2): 1.0, (3, 2): 1.0, (4, 3): 1.0, (5, 4): 1.0, (6, 5): 1.0, (7, 5): 1.0}


def test_coverage_is_over_the_whole_item(spark):
    items = [(1, "Anna Berg Carl Dahl Emma Falk Gina Holm Ivan Juhl went to the old mill")]
    assert reported(spark, items, ["went to the old mill", items[0][1]]) == {(1, 1): 1.0}


def test_clean_keeps_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "what is the sum of all the numbers in this long list"), (2, "clean words only")], "doc_id bigint, text string")
    docs = docs.withColumns({n: F.lit("x") for n in ("_leak_doc", "_leak_rid", "rid", "hash", "key", "item", "_h", "_s", "n", "pos", "at")})
    benchmark = spark.createDataFrame([(7, "What is the sum of all the numbers in this long list", 1)], "item_id bigint, text string, hash int")
    left = leaks.clean(docs, leaks.contaminated(docs, benchmark))
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [2]
