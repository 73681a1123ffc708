"""Merkle manifest against a plain tree built with hashlib."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ownerlens.llm import manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    values = [r[0], r[3], r[2], r[4], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root, and per leaf the list of (left, right) siblings from the bottom up."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for p, i in zip(paths, at):
            run = range(i // 3 * 3, min(len(level), i // 3 * 3 + 3))
            p.append(("".join(level[k] for k in run if k < i), "".join(level[k] for k in run if k > i)))
        at = [i // 3 for i in at]
        level = [h(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        keyed = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r) for r in by[s]), key=lambda x: x[:3])
        trees[s] = ([k[2] for k in keyed], [k[3] for k in keyed], *tree([k[2] for k in keyed]))
    root, tops = tree([trees[s][2] for s in order])
    out = []
    for s, top in zip(order, tops):
        leaves, docs, subroot, paths = trees[s]
        for leaf, r, p in zip(leaves, docs, paths):
            path = p + top
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = plain_leaf(r, text)
            for left, right in path:
                now = h(left, now, right)
            out.append((r[0], leaf, subroot, root, h(*[a + b for a, b in path]), now, now == root))
    return out


def key(r):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in r)


def same(spark, rows):
    got = [tuple(r) for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    want = plain(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_source_of_each_size(spark, n):
    same(spark, [(i * 7 % 31, f"line {i}\nnext", "en", "a", i) for i in range(n)])


def test_many_sources_of_mixed_sizes(spark):
    rnd = random.Random(3)
    rows = [(i, f"texté {i}" + "\nmore" * rnd.randint(0, 2), rnd.choice(["en", None]), rnd.choice(["hot"] * 6 + ["", "über", "z", None, "b", "B"]), i) for i in range(300)]
    got = same(spark, rows)
    assert {r[6] for r in got} == {True, False}


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (5, "a\nb", "en", "s", 3), (5, "a\nb", "en", "s", 3), (5, "other", "en", "s", 5),
            (6, None, "en", "s", None), (8, "x\n" * 60_000, "en", "s", 1), (-3, "\n", "de", "s", 1)]
    same(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    rows = [(i, "t\nu", "en", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert manifest.manifest(docs.limit(0)).collect() == []
    names = ("leaf", "tree", "idx", "size", "hash", "rank", "path", "_s", "_t", "_i", "_p", "_part", "root", "tampered", "run", "slot", "l", "r")
    got = [tuple(r) for r in manifest.manifest(docs.withColumns({name: F.lit("x") for name in names})).collect()]
    assert sorted(got) == sorted(plain(rows))


def test_any_change_of_one_row_changes_the_root(spark):
    rows = [(i, f"t {i}", "en", "s", i) for i in range(20)]
    root = plain(rows)[0][3]
    for k, other in ((3, "T 3"), (19, "t 19 ")):
        changed = [(i, other if i == k else t, *rest) for i, t, *rest in rows]
        got = manifest.manifest(spark.createDataFrame(changed, SCHEMA)).select("root").distinct().collect()
        assert len(got) == 1 and got[0][0] != root
