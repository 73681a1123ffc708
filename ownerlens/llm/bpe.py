"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself
a vocabulary entry is resolved by one probe and one comparison. Tier two merges the
others: a heap of candidate pairs over linked bytes, lowest rank first, leftmost on
ties. Each worker keeps a bounded memo of pre-tokens it has resolved.

The hash and the vocabulary travel with the task; their size is the vocabulary's.

Defined cases: a null text encodes to no tokens, like the empty one; special tokens
do not exist; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownerlens.llm.batches import bounded

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pre-tokens remembered per worker; the memo starts anew when full.
MEMO = 400_000
#: Characters of text resolved together, and ids decoded together.
GROUP = 1 << 18
#: Candidate displacements tried at once while the hash is built.
TRIES = 512


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Vocabulary entries by rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    assert [r for r, _ in pairs] == list(range(len(pairs)))
    return [t for _, t in pairs]


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys on n slots.

    Keys fall into buckets; each bucket, largest first, gets the first displacement
    (d, e) that puts all its keys, at (h1 + d * h2 + e) mod n, on free slots.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = max(1, len(keys)), max(1, len(keys) // 4)
        bucket, h1, h2 = self._parts(keys)
        self.d, self.e = np.zeros(self.buckets, np.int64), np.zeros(self.buckets, np.int64)
        self.key_at = np.full(self.n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(first)
        free_from = 0
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[first[b] : first[b + 1]]
            if len(mine) == 0:
                break
            if len(mine) == 1:
                while self.key_at[free_from] >= 0:
                    free_from += 1
                self.e[b] = (free_from - h1[mine[0]]) % self.n
                self.key_at[free_from] = mine[0]
                continue
            self._place(b, mine, h1, h2)

    def _place(self, b: int, mine: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        for t in range(0, self.n * self.n, TRIES):
            k = np.arange(t, t + TRIES)
            d, e = k // self.n, k % self.n
            at = (h1[mine][:, None] + d * h2[mine][:, None] + e) % self.n
            free = (self.key_at[at] < 0).all(axis=0)
            for c in np.flatnonzero(free):
                if len(set(at[:, c].tolist())) == len(mine):
                    self.d[b], self.e[b] = d[c], e[c]
                    self.key_at[at[:, c]] = mine
                    return
        raise ValueError("keys repeat")

    def _parts(self, keys: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        bucket = (h >> np.uint64(32)) % np.uint64(self.buckets)
        h1, h2 = (h & np.uint64(0xFFFFFFFF)) % np.uint64(self.n), (mixed >> np.uint64(32)) % np.uint64(max(1, self.n - 1)) + np.uint64(1)
        return bucket.astype(np.int64), h1.astype(np.int64), h2.astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the number of the one entry it can be."""
        bucket, h1, h2 = self._parts(keys)
        return self.key_at[(h1 + self.d[bucket] * h2 + self.e[bucket]) % self.n]


class _Tables:
    """What a worker derives from a vocabulary, once for all its tasks."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: k for k, t in enumerate(tokens)}
        self.byte = [ids.get(bytes([b]), -1) for b in range(256)]
        #: Entry that two entries make together, by the first's number << 32 | the second's.
        self.pairs: dict[int, int] = {}
        for t, k in ids.items():
            for cut in range(1, len(t)):
                if (a := ids.get(t[:cut])) is not None and (z := ids.get(t[cut:])) is not None:
                    self.pairs[a << 32 | z] = k
        #: All entries one after another, and where each begins.
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.memo: dict[str, bytes] = {}


#: By a digest of the vocabulary; a worker meets one or two.
_tables: dict[bytes, _Tables] = {}


class Codec:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.tokens = read_ranks(path)
        self.hash = PerfectHash(self.tokens)
        self.pattern = pattern
        self.name = hashlib.sha256(pattern.encode() + b"\0" + b"".join(b"%d:%b" % (len(t), t) for t in self.tokens)).digest()
        self._split = None

    def __getstate__(self):
        return {**self.__dict__, "_split": None}

    @property
    def tables(self) -> _Tables:
        if self.name not in _tables:
            _tables[self.name] = _Tables(self.tokens)
        return _tables[self.name]

    def merge(self, piece: bytes) -> list[int]:
        """Numbers of the entries of a piece that is none: heap of pairs over linked bytes."""
        tables = self.tables
        pair, ids, n = tables.pairs.get, [tables.byte[b] for b in piece], len(piece)
        if -1 in ids:
            raise ValueError("the vocabulary lacks a byte of the text")
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # What the pair that starts at each place makes; -1 if nothing, or if the place has been merged away.
        makes = [pair(a << 32 | z, -1) for a, z in zip(ids, ids[1:])]
        makes.append(-1)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [r << bits | i for i, r in enumerate(makes) if r >= 0]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            x = pop(heap)
            r, i = x >> bits, x & mask
            if makes[i] != r:
                continue  # one of the two has been merged meanwhile
            j = after[i]
            k = after[i] = after[j]
            ids[i], makes[j] = r, -1
            if k < n:
                before[k] = i
                made = makes[i] = pair(r << 32 | ids[k], -1)
                if made >= 0:
                    push(heap, made << bits | i)
            else:
                makes[i] = -1
            if (p := before[i]) >= 0:
                made = makes[p] = pair(ids[p] << 32 | r, -1)
                if made >= 0:
                    push(heap, made << bits | p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _resolve(self, words: Iterable[str], memo: dict[str, bytes]) -> None:
        words = list(words)
        pieces = [w.encode("utf-8") for w in words]
        tokens, merge = self.tokens, self.merge
        for word, piece, k in zip(words, pieces, self.hash.find(pieces).tolist()):
            memo[word] = k.to_bytes(4, "little") if tokens[k] == piece else pack("<%dI" % len(ids := merge(piece)), *ids)

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its token ids as little-endian unsigned 32-bit numbers; texts are taken a group at a time."""
        if self._split is None:
            self._split = regex.compile(self.pattern, regex.V1)
        memo, split = self.tables.memo, self._split.findall
        first = 0
        while first < len(texts):
            split_, size = [], 0
            while first < len(texts) and (not split_ or size < GROUP):
                split_.append(split(texts[first]) if texts[first] else [])
                size += len(texts[first] or "")
                first += 1
            new = set().union(*split_)
            if len(memo) + len(new) > MEMO:
                memo.clear()
            self._resolve(new.difference(memo), memo)
            for words in split_:
                yield b"".join(map(memo.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the entries, gathered from one array, a slice of ids at a time."""
        tables, numbers, out = self.tables, np.frombuffer(ids, "<u4"), []
        for s in range(0, len(numbers), GROUP):
            part = numbers[s : s + GROUP]
            sizes = tables.sizes[part]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(tables.starts[part] - ends + sizes, sizes)
            out.append(tables.flat[at].tobytes())
        return b"".join(out)


def encode(docs: DataFrame, codec: Codec | None = None, text: str = "text") -> DataFrame:
    """doc_id and its token ids, an array of int."""
    codec = codec or Codec()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(ids, "<u4").astype(np.int32) for ids in codec.encode_all(list(texts))], dtype=object)

    return bounded(docs).select("doc_id", ids(F.col(text)).alias("ids"))


def decode(tokens: DataFrame, codec: Codec | None = None, ids: str = "ids") -> DataFrame:
    """doc_id and the bytes its ids stand for; null ids give no bytes."""
    codec = codec or Codec()

    @F.pandas_udf("binary")
    def joined(rows: pd.Series) -> pd.Series:
        return pd.Series([b"" if r is None else codec.decode(np.asarray(r, "<u4").tobytes()) for r in rows], dtype=object)

    return tokens.select("doc_id", joined(F.col(ids)).alias("bytes"))


def digests(docs: DataFrame, codec: Codec | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes decoded from them, and the ids if asked for."""
    codec = codec or Codec()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def both(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for ids in codec.encode_all(list(texts)):
            row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
            rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row)
        return pd.DataFrame(rows, columns=names)

    return bounded(docs).select("doc_id", both(F.col(text)).alias("r")).select("doc_id", *[f"r.{c}" for c in names])
