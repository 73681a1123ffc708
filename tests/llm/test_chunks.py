"""Anchors and exact passages against plain loops; passages caught, clean texts left alone."""
import random

import pytest
from pyspark.sql import functions as F

from ownerlens.llm import chunks


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("size", [51, 60])
def test_anchors_are_the_least_runs_by_gear_hash(size):
    rnd = random.Random(1)
    for text in ["la " * 90, "", "one two", words(rnd, 50), words(rnd, 51), *[words(rnd, rnd.randint(60, 200)) for _ in range(8)]]:
        hashes = chunks.word_hashes(text.encode())
        n = len(hashes)
        gear = [sum((int(hashes[i - k]) & 0xFFFFFFFF) << k for k in range(16)) % 2**32 for i in range(chunks.ANCHOR - 1, n)]
        want = {min(range(s, s + size - chunks.ANCHOR + 1), key=lambda i: (gear[i], -i)) for s in range(n - size + 1)}
        assert chunks.anchors(hashes, size).tolist() == sorted(want)


def test_passages_of_over_fifty_words_are_always_caught(spark):
    rnd = random.Random(3)
    rows, planted = [], {}
    for i in range(120):
        passage = words(rnd, 51)
        rows.append((2 * i, f"{words(rnd, 30)} {passage} {words(rnd, 30)}"))
        rows.append((2 * i + 1, f"{words(rnd, 25)}\n{passage}\n{words(rnd, 25)}"))
        planted[2 * i + 1] = (2 * i, passage)
    rows += [(1000 + i, words(rnd, 200)) for i in range(100)]
    line = words(rnd, 27)
    rows += [(2000 + i, f"{words(rnd, 40)}\n{line}\n{words(rnd, 40)}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = chunks.repeated_passages(docs)
    got = {r["doc_id"]: r["first_doc_id"] for r in found.collect()}
    assert got == {k: v[0] for k, v in planted.items()}
    left = {r["doc_id"]: r["text"] for r in chunks.remove(docs, found).collect()}
    text = dict(rows)
    for i, t in left.items():
        if i in planted:
            assert len(t.split()) < len(text[i].split()) - 27 and t.split()[0] == text[i].split()[0]
        else:
            assert t == text[i]


def test_edges(spark):
    rnd = random.Random(4)
    p = words(rnd, 60)
    rows = [(1, p, "a"), (2, p, "b"), (2, p, "b"), (3, None, "c"), (4, "", "d"), (None, p, "e"), (5, p + " " + words(rnd, 5), "f"), (6, words(rnd, 40), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    found = chunks.repeated_passages(docs)
    assert {r["doc_id"] for r in found.collect()} == {2, None, 5}
    left = chunks.remove(docs, found)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5, 6]
    assert chunks.repeated_passages(docs.limit(0)).count() == 0 and chunks.remove(docs.limit(0), found).count() == 0


def plain_repeats(rows, m=chunks.MIN_WORDS):
    """Word numbers of each document inside m words that a document with a smaller id holds in a row."""
    grams = {i: [tuple(t.split()[a : a + m]) for a in range(len(t.split()) - m + 1)] for i, t in rows}
    out = {}
    for i in grams:
        before = {g for j in grams if j < i for g in grams[j]}
        if at := {a + k for a, g in enumerate(grams[i]) if g in before for k in range(m)}:
            out[i] = at
    return out


def spans(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    return out


def test_exact_spans_of_any_kind_of_word(spark):
    """Short words, numbers and one word repeated have few cuts or none; spans reach to where the texts differ."""
    rnd = random.Random(5)
    kinds = [lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(1, 2))), lambda: str(rnd.randint(0, 99)), lambda: "la"]
    rows = []
    for i in range(60):
        passage = " ".join(kinds[i % 3]() for _ in range(rnd.randint(51, 58)))
        rows += [(2 * i, f"{words(rnd, 20)} {passage} {words(rnd, 20)}"), (2 * i + 1, f"{words(rnd, 20)}\n{passage}\n{words(rnd, 20)}")]
        short = " ".join(kinds[i % 2]() for _ in range(50))
        rows += [(1000 + 2 * i, f"{words(rnd, 20)} {short} {words(rnd, 20)}"), (1001 + 2 * i, f"{words(rnd, 20)} {short} {words(rnd, 20)}")]
    want = plain_repeats(rows)
    assert len(want) >= 60 and max(want) < 1000
    found = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert spans(found) == want
    left = {r["doc_id"]: r["text"].split() for r in chunks.remove(spark.createDataFrame(rows, "doc_id bigint, text string"), found).collect()}
    assert all(left[i] == [w for k, w in enumerate(t.split()) if k not in want.get(i, ())] for i, t in rows)


def test_lines_side_by_side_are_no_passage_unless_one_document_holds_both(spark):
    rnd = random.Random(6)
    a, b = words(rnd, 40), words(rnd, 40)
    rows = [(1, f"{words(rnd, 30)} {a} {words(rnd, 30)}"), (2, f"{b} {words(rnd, 30)}"), (3, f"{words(rnd, 9)} {a} {b} {words(rnd, 9)}"), (4, f"{words(rnd, 5)} {a} {b}")]
    found = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert spans(found) == {4: set(range(5, 85))} and {r["first_doc_id"] for r in found.collect()} == {3}


def test_clashing_columns_are_kept(spark):
    rnd = random.Random(7)
    p = words(rnd, 60)
    docs = spark.createDataFrame([(1, p), (2, f"{words(rnd, 9)} {p}"), (3, p)], "doc_id bigint, text string")
    names = ("_span_doc", "_span_rid", "_spans", "_left", "left", "d", "rid", "first", "digest", "_d", "_m", "_r", "marks", "holder")
    docs = docs.withColumns({n: F.lit("x") for n in names})
    left = chunks.remove(docs, chunks.repeated_passages(docs))
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], len(r["text"].split()), r["_spans"], r["left"]) for r in left.collect()) == [(1, 60, "x", "x"), (2, 9, "x", "x")]
