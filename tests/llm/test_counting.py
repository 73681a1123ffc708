"""Edit-aware counts against encoding the edited text anew."""
import base64
import random

import pytest
import tiktoken

from ownerlens.llm import counting


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(counting.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=counting.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["the", " The", "ción", " ñ", "12", " 3", "'", "'s", "'r", "e", "l", "ll", "\n", " ", "  ", "\t", "***", "?!", "​", "🙂", "x" * 90]


def noise(rnd, n):
    return "".join(rnd.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_equals_encoding_anew(monkeypatch, library, leaf):
    monkeypatch.setattr(counting, "LEAF", leaf)
    rnd = random.Random(leaf)
    lengths = counting.Lengths()
    for _ in range(250):
        text = noise(rnd, rnd.choice([0, 1, 5, 60, 400]))
        tree = counting.Tree(lengths.words(text), lengths)
        for _ in range(6):
            at, cut, put = rnd.randint(-2, len(text) + 3), rnd.choice([0, 0, 1, 2, 7, 50, 500]), noise(rnd, rnd.choice([0, 0, 1, 2, 9, 120]))
            tree.edit(at, cut, put)
            at = min(max(0, at), len(text))
            text = text[:at] + put + text[at + cut :]
            words = lengths.words(text)
            assert [w for part in tree.words for w in part] == words
            assert tree.tokens[1] == len(library.encode_ordinary(text)) and tree.chars[1] == len(text)


def test_touches_only_the_edited_region():
    lengths = counting.Lengths()
    tree = counting.Tree(lengths.words("some plain words in a row " * 20_000), lengths)
    tree.edit(300_000, 4, "changed")
    assert tree.encoded < 12


def test_in_spark(spark, library):
    rnd = random.Random(9)
    rows = [(i, noise(rnd, rnd.randint(0, 200)), "x") for i in range(40)] + [(40, None, "x"), (41, "", "x"), (3, "same", "x"), (3, "same", "x"), (None, "word " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    edited = counting.sample_edits(docs)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_tokens_edited"]) for r in counting.count_edits(edited).collect())
    want = []
    for r in edited.collect():
        text = r["text"] or ""
        before = len(library.encode_ordinary(text))
        for e in r["edits"]:
            text = text[: e["at"]] + e["put"] + text[e["at"] + e["cut"] :]
        want.append((str(r["doc_id"]), before, len(library.encode_ordinary(text))))
    assert got == sorted(want)
    assert counting.count_edits(edited.limit(0)).count() == 0
    none = edited.withColumn("edits", edited["edits"].cast("array<struct<at:int,cut:int,put:string>>")).selectExpr("doc_id", "text", "if(false, edits, null) AS edits")
    assert all(r["n_tokens"] == r["n_tokens_edited"] for r in counting.count_edits(none).collect())
