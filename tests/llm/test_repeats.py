"""Repeated byte strings against a plain dictionary of all strings, and transforms against sorted rotations."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ownerlens.llm import bwt, repeats

SCHEMA = "doc_id bigint, text string"


def plain(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, digest) of rows with distinct ids."""
    seen, out = set(), []
    for doc_id, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0)


def digests(spark, rows, **options):
    return sorted((tuple(r) for r in repeats.digests(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=key)


@pytest.mark.parametrize("seed", range(4))
def test_transform_is_the_last_column_of_the_sorted_rotations(seed):
    rnd = random.Random(seed)
    strings = list({bytes(rnd.choices(b"ab\x00\xc3", k=rnd.randint(1, 30))) for _ in range(20)} | {b"aaaa", b"aa", b"abab", b"ba"})
    made = bwt.transform(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
    # Rotations are compared as if repeated for ever.
    rotations = sorted((((s[i:] + s[:i]) * 80)[:80], s[i - 1]) for s in strings for i in range(len(s)))
    assert [r[1] for r in rotations] == made.symbols.tolist()
    assert [rotations[r][0] for r in made.rows] == [(s * 80)[:80] for s in strings]


@pytest.mark.parametrize("parts,length", [(1, 3), (2, 5), (3, 8), (5, 12)])
def test_merged_blocks_are_the_rotations_with_equal_starts(parts, length):
    rnd = random.Random(length)
    made, starts = [], []
    for _ in range(parts):
        strings = list({bytes(rnd.choices(b"abc", k=rnd.randint(length, 2 * length))) for _ in range(30)})
        t = bwt.transform(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
        made.append(t)
        starts.append(sorted(((s[i:] + s[:i]) * 40)[:40][:length] for s in strings for i in range(len(s))))
    blocks = bwt.merge_blocks(made, length)
    of = {}
    for b, s in zip(blocks, starts):
        for k, w in zip(b.tolist(), s):
            assert of.setdefault(w, k) == k
    assert len(set(of.values())) == len(of)


@pytest.mark.parametrize("length,gram", [(12, 4), (9, 9), (20, 1), (100, 30)])
def test_random_texts_with_copies(spark, length, gram):
    rnd = random.Random(length)
    pool = ["".join(rnd.choices("abcé \n", k=rnd.randint(length // 2, 4 * length))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice([rnd.choice(pool), "".join(rnd.choices("abcé ", k=rnd.randint(0, 9)))]) for _ in range(rnd.randint(0, 8)))) for i in range(60)]
    want = plain(rows, length)
    assert digests(spark, rows, length=length, gram=gram, bucket=2000) == want and sum(r[2] for r in want) > 1000


def test_hot_anchors_are_split_and_give_the_same(spark):
    rnd = random.Random(4)
    line = "".join(rnd.choices("abcdefgh", k=23))
    rows = [(i, "".join(rnd.choices("xyz", k=30)) + line + "".join(rnd.choices("xyz", k=30)) + line[:21] + rnd.choice("xy") * 25) for i in range(200)]
    want = plain(rows, 24)
    for hot in (10**6, 5, 1):
        assert digests(spark, rows, length=24, gram=8, bucket=3000, hot=hot, spans=(4, 1)) == want
    assert sum(r[2] for r in want) > 1000


def test_runs_of_one_byte_and_very_long_texts(spark):
    rnd = random.Random(6)
    long = "".join(rnd.choices("abcdefghijklmnop \n", k=150_000))
    rows = [(1, "a" * 5000), (2, "a" * 99), (3, "b" + "a" * 100), (4, "ab" * 3000), (5, long), (6, "z" + long[:70_000] + "é" + long[70_000:]), (7, "x" * 100 + "y" + "x" * 100)]
    assert digests(spark, rows) == plain(rows, 100)


def test_removed_strings_are_judged_on_the_input(spark):
    a, b = "A" * 50 + "B" * 50 + "C" * 50, "q" * 10 + "A" * 50 + "B" * 50
    rows = [(1, a), (2, b), (3, b + "C" * 50)]
    assert digests(spark, rows) == plain(rows, 100)


def test_spans_and_bytes_left(spark):
    rows = [(1, "0123456789abcdef"), (2, "--56789abc--01234567--")]
    got = {r["doc_id"]: r for r in repeats.remove(spark.createDataFrame(rows, SCHEMA), length=8, gram=3).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(2, 8), (12, 8)] and bytes(got[2]["kept"]) == b"------" and got[1]["spans"] == []


def test_nulls_ties_repeats_empty_table_and_clashing_columns(spark):
    t = "word " * 30
    rows = [(None, t), (1, None), (2, ""), (3, t), (4, t), (5, "short")]
    want = plain(rows, 100)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert digests(spark, rows) == want
    names = ("data", "tid", "no", "marks", "_doc", "_tid", "_no", "key", "seg", "off", "at", "n", "keep", "kept", "spans", "bucket", "shard", "r", "_a", "_k", "rank", "anchor")
    clashing = docs.withColumns({n: F.lit("x") for n in names})
    assert sorted((tuple(r) for r in repeats.digests(clashing).collect()), key=key) == want
    assert repeats.digests(docs.limit(0)).collect() == []
    # Equal rows are one document; texts of one id are ordered.
    twice = digests(spark, [(3, t), (3, t), (4, t)])
    assert twice[0] == twice[1] and twice[2][2] == 150
    other = digests(spark, [(3, t), (3, t + "x")])
    assert len(other) == 2 and sorted(r[2] for r in other) != [0, 0]
