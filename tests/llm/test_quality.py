"""Quality rules against a plain loop; host prior; edges."""
import random
import re

import pytest

from ownerlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def texts():
    rnd = random.Random(1)
    out = [None, "", " \n\t", "a", "x " * 7, "x " * 8, "x " * 9, "x y " * 400, "é|ñ\x0b#\x1c <b>\n\n<b>\r\n<b>"]
    for _ in range(150):
        words = [rnd.choice(["of", "the", "ñandú", "$5", "a*b", "\n", "\n\n"]) for _ in range(rnd.randint(0, 80))]
        out.append(" ".join(words) + (" " + " ".join(words[:12]) if rnd.random() < 0.4 else ""))
    return out + ["q " * 20_000]


def test_measures_equal_a_plain_loop(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=("doc_id",)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(t), t


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good, f"h{i % 9}", 0.0) for i in range(900)] + [(1000 + i, "bad", "spam", 0.0) for i in range(95)] + [(2000 + i, good, "spam", 0.0) for i in range(5)]
    rows += [(3000, good, None, 0.0), (3001, None, None, 0.0), (3001, None, None, 0.0), (None, good, "new", 0.0), (3002, "bad", "tiny", 0.0), (3003, good, "tiny2", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, host_rate double")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in range(900)) and not any(kept[i] for i in range(1000, 1095))
    assert not any(kept[2000 + i] for i in range(5)), "a host of failures loses its other documents"
    assert kept[3000] and not kept[3001] and kept[None] and not kept[3002] and kept[3003]
    rate = {r["source"]: r["host_rate"] for r in got}
    assert 0.5 < rate["spam"] < 0.95 and rate["h0"] > 0 and rate[None] is None


@pytest.mark.parametrize("rows", [[], [(1, "one two", "a")]])
def test_few_hosts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert quality.judge(docs).count() == len(rows)


def test_no_python(spark):
    plan = quality.measure(spark.createDataFrame([(1, "a", "b")], "doc_id bigint, text string, source string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
