"""BPE against the tiktoken library, and exact round trips."""
import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from ownerlens.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    parts = ["the", " The", "ción", " ñ", "über", "é́", "日本語", " 12", "3.5", "'s", "'re", "\n", "  ", "\t", "\x1c", "\x85", "​", "🙂", "a" * 300, " " * 40, "***", "<|endoftext|>", "\x00"]
    return ["", " ", "a", "'", " x  y "] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(400)] + ["ab" * 20_000]


def test_equals_library_and_round_trips(codec, library):
    for t in texts():
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), t[:80]
        assert codec.decode(ids) == t.encode()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(2000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.key_at.tolist()) == list(range(2000))
    assert h.find(keys).tolist() == list(range(2000))
    assert bpe.PerfectHash([]).n == 1


def test_queries_on_edges(spark, codec, library):
    rows = [(1, "The cat", "x"), (2, None, "y"), (2, "", "y"), (None, "über " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.digests(docs, codec).collect()}
    want = np.array(library.encode_ordinary("The cat"), "<u4").tobytes()
    assert got[(1, len(want) // 4)]["ids_sha256"] == hashlib.sha256(want).hexdigest()
    assert got[(2, 0)]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs.limit(0), codec).count() == 0
    back = bpe.decode(bpe.encode(docs, codec), codec)
    assert sorted(bytes(r["bytes"]).decode() for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
