"""The pipeline: each stage on its own input, and the whole on the small tables."""
import base64
import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from ownerlens.llm import bpe

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(1)
    base, passage, question = words(rnd, 300), words(rnd, 60), words(rnd, 30)
    rows = [(i, words(rnd, 80), "xx") for i in range(40)]
    rows += [(100, base, "xx"), (101, base, "xx"), (102, base + " z", "xx"), (103, f"{words(rnd, 50)} {passage} {words(rnd, 50)}", "xx"), (104, f"{words(rnd, 50)} {passage} {words(rnd, 50)}", "xx")]
    rows += [(105, f"{words(rnd, 40)} {question} {words(rnd, 40)}", None), (106, None, "xx"), (107, " 12 ", "xx"), (108, "", None), (3, rows[3][1], "xx")]
    docs = spark.createDataFrame([(i, t, x, "s", None if t is None else len(t)) for i, t, x in rows], SCHEMA)
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, question), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return docs, folder, {i: t for i, t, _ in rows}


def test_stages(spark, corpus):
    docs, folder, text = corpus
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(kept["language_id"]) == set(text) - {106, 107, 108}
    assert set(kept["near_duplicates"]) == set(text) - {101, 102, 108}
    assert {i for i, t in kept["repeated_passages"].items() if t != text[i]} == {102, 104}
    assert len(kept["repeated_passages"][104].split()) < 130 and 101 not in kept["repeated_passages"]
    assert set(kept["benchmark_leaks"]) == set(text) - {105}


def test_whole(spark, corpus):
    docs, folder, text = corpus
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(text) - {101, 102, 105, 106, 107, 108}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        if i != 104:
            ids = library.encode_ordinary(text[i])
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(text[i].encode()).hexdigest()


def test_empty(spark, corpus):
    docs, folder, _ = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_registered_queries(spark):
    import __spark_entry__

    names = {n.split("_")[0]: n for n in __spark_entry__.queries()}
    docs, pages = (spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "pages"))
    for n, rows in {1: docs, 2: pages, 3: docs, 4: pages, 5: docs, 7: docs, 9: docs, 10: docs}.items():
        assert __spark_entry__.queries()[names[f"op{n}"]](spark, FOLDER).count() == rows
    assert {"op6", "op8", "pipeline"} <= set(names)


def test_rest_does_without_this_package(tmp_path):
    """The entry module imports, with all other queries, where the package and the pipeline are absent."""
    for name in ("ownerlens", "__spark_entry__.py"):
        if name == "ownerlens":
            os.makedirs(tmp_path / name)
            for part in os.listdir(f"{ROOT}/{name}"):
                if part not in ("llm", "__pycache__"):
                    os.symlink(f"{ROOT}/{name}/{part}", tmp_path / name / part)
        else:
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    code = "import sys; sys.path.insert(0, sys.argv[1]); sys.dont_write_bytecode = True; import importlib.util as u; s = u.spec_from_file_location('e', sys.argv[1] + '/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), any(k.startswith('op') or k == 'pipeline' for k in m.queries()))"
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path, timeout=120)
    assert out.returncode == 0, out.stderr
    count, any_new = out.stdout.split()
    assert int(count) >= 160 and any_new == "False"
