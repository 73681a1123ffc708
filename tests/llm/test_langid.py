"""Language identification: held-out accuracy, margins against a plain loop, edges."""
import os
import random

import numpy as np
import pytest

from ownerlens.llm import langid

FOLDER = "/root/testdata/sf0.001"
WORDS = {"xa": "the of and to ing er".split(), "xb": "der die und ung lich sch".split(), "xc": "el la que ción ado os".split()}


def corpus(n=240, seed=1, langs=WORDS):
    rnd = random.Random(seed)
    names = sorted(langs)
    rows = []
    for i in range(n):
        x = names[i % len(names)]
        rows.append((i, " ".join("".join(rnd.choices(langs[x], k=rnd.randint(1, 3))) for _ in range(rnd.randint(6, 60))), x))
    return rows


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [(i, x) for i, _, x in corpus() if got[i]["held_out"]]
    assert 40 < len(held) < 120
    assert np.mean([got[i]["lang_pred"] == x for i, x in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_margins_equal_a_plain_loop(monkeypatch):
    rnd = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], langid.codewords(3), rnd.normal(size=(langid.BUCKETS, 3)).astype(np.float32), np.ones(3))
    texts = [b"", b"A", b"ab", b"abcd", b"Hello World" * 9, b"", b"xyz" * 40]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    want = []
    for t in texts:
        low = np.frombuffer(t.lower(), np.uint8).astype(np.uint32)
        at = np.concatenate([langid.grams(low[i : i + n], n) for n in langid.GRAMS for i in range(len(low) - n + 1)] or [np.zeros(0, np.uint32)])
        want.append(model.weights[at].astype(float).sum(axis=0) / max(1, len(at)))
    for size in (langid.SLICE, 1):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.allclose(model.margins(data, starts, ends), want)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 30])
def test_codewords_tell_languages_apart(n):
    code = langid.codewords(n)
    assert len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_edges(spark):
    rows = corpus(60) + [(900, None, "xa"), (901, "", "xa"), (902, "12 ... 3", None), (903, "the " * 300_000, None), (904, "ñ", None), (None, "der und", "xb"), (1, "the of", "xa"), (1, "the of", "xa")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, lang string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902))
    assert by[903]["lang_pred"] == "xa" and by[904]["lang_pred"] in WORDS and not by[None]["held_out"]
    assert langid.identify(docs.limit(0)).count() == 0
    unlabelled = docs.select("doc_id", "text").selectExpr("*", "CAST(NULL AS string) AS lang")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    single = docs.filter("lang = 'xa'")
    assert {r["lang_pred"] for r in langid.identify(single).collect()} <= {"xa", "und"}


def test_sample_is_a_share_of_different_rows(spark):
    rows = [(5, "the of and", "xa")] * 50 + corpus(900)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    counts = {r["lang"]: r["count"] for r in langid.training_rows(docs, 100).groupBy("lang").count().collect()}
    assert counts.keys() == WORDS.keys() and all(60 <= n <= 140 for n in counts.values())
    assert langid.training_rows(docs, 10**6).count() == 901


def test_training_and_decoding_equal_plain_loops(spark, monkeypatch):
    langs = {f"l{k}": ["".join(random.Random(100 * k + j).choices("abcdefgh", k=4)) for j in range(6)] for k in range(9)}
    rows = corpus(180, langs=langs)
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 10**6)
    names = sorted(langs)
    table = np.zeros((9, langid.BUCKETS))
    for _, t, x in rows:
        data = np.frombuffer(t.lower().encode(), np.uint8).astype(np.uint32)
        for n in langid.GRAMS:
            np.add.at(table[names.index(x)], langid.grams(data, n), 1)
    share = (table + langid.SMOOTHING) / (table.sum(axis=1, keepdims=True) + langid.SMOOTHING * langid.BUCKETS)
    assert model.languages == names
    for b in range(model.code.shape[1]):
        with_, without = [k for k in range(9) if model.code[k, b] > 0], [k for k in range(9) if model.code[k, b] < 0]
        odds = np.log(share[with_].mean(axis=0)) - np.log(share[without].mean(axis=0))
        assert np.allclose(model.weights[:, b], odds, atol=1e-5)
        assert np.isclose(model.trust[b], max(1e-3, min(model.code[k, b] * (share[k] * odds).sum() for k in range(9))), atol=1e-6)
    margins = np.random.default_rng(1).normal(size=(25, model.code.shape[1]))
    want = []
    for m in margins:
        loss = [sum(w * np.log1p(np.exp(-4 * x * c)) for w, x, c in zip(model.trust, m, code)) / model.trust.sum() for code in model.code]
        two = sorted(loss)[:2]
        want.append((int(np.argmin(loss)), 1 / sum(np.exp(-8 * (x - two[0])) for x in loss), two[1] - two[0] < langid.TIE))
    for step in (langid.DECODED, 1):
        monkeypatch.setattr(langid, "DECODED", step)
        best, score, tied = model.decode(margins)
        assert best.tolist() == [w[0] for w in want] and np.allclose(score, [w[1] for w in want]) and tied.tolist() == [w[2] for w in want]


def test_partitions_without_rows(spark):
    """More partitions than languages and buckets met: tasks without rows add nothing."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        docs = spark.createDataFrame(corpus(60), "doc_id bigint, text string, lang string")
        assert langid.train(docs).languages == sorted(WORDS)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_counts_do_not_grow_with_tasks(spark):
    """One row for each language and n-gram, over however many tasks the texts lie."""
    rows = spark.createDataFrame([(x, t) for _, t, x in corpus(120)], "lang string, text string")
    few, many = (langid.task_counts(rows.repartition(n)) for n in (1, 40))
    counted = many.collect()
    assert len(counted) == few.count() == len({(r["lang"], r["bucket"]) for r in counted})
    assert sum(r["n"] for r in counted) == sum(max(0, len(t.encode()) - n + 1) for _, t, _ in corpus(120) for n in langid.GRAMS)


def test_more_languages_than_a_task_holds_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 3)
    langs = {f"l{k}": ["".join(random.Random(100 * k + j).choices("abcdefgh", k=4)) for j in range(6)] for k in range(12)}
    docs = spark.createDataFrame(corpus(360, langs=langs), "doc_id bigint, text string, lang string")
    for name in ("_l", "_c", "_k", "_r", "_s", "k", "r", "score", "lang_pred", "bucket", "n"):
        docs = docs.withColumn(name, docs["text"])
    got = langid.identify(docs).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] % 12}" or sorted(langs)[r["doc_id"] % 12] == r["lang_pred"] for r in got if r["held_out"]]) > 0.9


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
