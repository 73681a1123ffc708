"""Extendible hashing against a plain recursive split."""
import hashlib
import os
import random

import duckdb
import pytest

from ownerlens.llm import queries, shards


def plain(rows, limit):
    """(doc_id, bits, fits) by splitting only what is too large; the dealt bits are not modelled."""
    hashed = [(i, int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:9], 16), len((t or "").encode()) + 16) for i, t in rows]
    out = []

    def split(part, depth, bits):
        if sum(b for _, _, b in part) <= limit or depth == 36:
            out.extend((i, bits) for i, _, _ in part)
            return
        for bit in (0, 1):
            if sub := [x for x in part if x[1] >> (35 - depth) & 1 == bit]:
                split(sub, depth + 1, bits + str(bit))

    if hashed:
        split(hashed, 0, "")
    return out


@pytest.mark.parametrize("limit", [10**9, 20_000, 3_000, 900])
def test_equals_a_plain_split(spark, limit):
    rnd = random.Random(1)
    rows = [(i, "é" * rnd.randint(0, 400)) for i in range(500)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), limit).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in got) == sorted(plain(rows, limit))
    sizes = {}
    for r in got:
        n, b = sizes.get(r["shard"], (0, 0))
        sizes[r["shard"]] = (n + 1, b + r["n_bytes"])
    assert all(sizes[r["shard"]] == (r["shard_rows"], r["shard_bytes"]) and r["fits"] == (r["shard_bytes"] <= limit) and len(r["shard"]) == r["depth"] for r in got)
    assert all(r["fits"] for r in got)


def test_hot_ids_equal_rows_and_long_texts(spark):
    rows = [(7, "same" * 25, 0)] * 300 + [(8, f"text {i} " * 12, 0) for i in range(300)] + [(None, None, 0), (9, "", 0), (10, "x" * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, depth int")
    got = shards.shard(docs, 4_000).collect()
    assert len(got) == len(rows)
    assert all(r["fits"] for r in got if r["doc_id"] != 10) and [r["fits"] for r in got if r["doc_id"] == 10] == [False]
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) > 5
    assert shards.shard(docs.limit(0), 4_000).count() == 0


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 50, "x") for i in range(100)], "doc_id bigint, text string, lang string")
    shards.write_shards(docs, str(tmp_path / "out"), 1_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {"text", "lang", "shard"} <= set(back.columns) and back.select("shard").distinct().count() >= 7


def test_files_with_a_column_named_shard(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * 50, "x", "y") for i in range(100)], "doc_id bigint, text string, shard string, _id string")
    shards.write_shards(docs, str(tmp_path / "out"), 1_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and "x" not in {str(r["shard"]) for r in back.select("shard").distinct().collect()} and {r["_id"] for r in back.select("_id").collect()} == {"y"}


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_check_sql_with_a_limit_that_splits(spark):
    """The registered limit holds all rows of the small tables in one shard; this one does not."""
    limit = 8 * 2**10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cur = con.execute(queries.sharding_sql(limit))
    names = [d[0] for d in cur.description]
    got = shards.shard(spark.read.parquet(f"{FOLDER}/documents.parquet"), limit).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall()) and len({r["shard"] for r in got}) > 20
