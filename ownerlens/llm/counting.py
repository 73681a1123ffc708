"""Token counts that follow edits without encoding whole texts again.

A document's pre-tokens lie in leaves of a segment tree whose nodes sum characters
and tokens. An edit descends by characters, re-splits from the first pre-token that
could see the edit (its end is within two characters of it, as far as the pattern
looks ahead) until a new boundary falls on an old one, and encodes only the
pre-tokens in between; changed leaves update the sums on their paths.

Defined cases: a null text or null edits count as empty; positions and lengths are
cut to the text; edits apply in order, each to the result of the one before; a null
replacement inserts nothing; repeated rows are counted each; an empty table gives
an empty result; extra columns are ignored.
"""
from __future__ import annotations

import base64

import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownerlens.llm.batches import bounded

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pre-tokens per leaf when a tree is built; a leaf that outgrows LARGE of these has the tree built anew.
LEAF = 64
LARGE = 16
#: How far past its own end the pattern may look.
AHEAD = 2
MEMO = 100_000


class Lengths:
    """Tokens per pre-token, remembered in a bounded memo."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.path, self.pattern = path, pattern
        self._open = False

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "_open": False}

    def _start(self) -> None:
        with open(self.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("counted", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(self.pattern, regex.V1)
        self._memo: dict[str, int] = {}
        self._open = True

    def words(self, text: str) -> list[str]:
        if not self._open:
            self._start()
        return self.split.findall(text)

    def counts(self, words: list[str]) -> list[int]:
        if not self._open:
            self._start()
        memo = self._memo
        if len(memo) > MEMO:
            memo.clear()
        new = [w for w in dict.fromkeys(words) if w not in memo]
        memo.update((w, len(self._encoding.encode_ordinary(w))) for w in new)
        return [memo[w] for w in words]


class Tree:
    """Segment tree over leaves of pre-tokens; node k has children 2k and 2k + 1."""

    def __init__(self, words: list[str], lengths: Lengths):
        self.lengths = lengths
        self.encoded = 0
        self._build(words, lengths.counts(words))

    def _build(self, words: list[str], counts: list[int]) -> None:
        n = max(1, -(-len(words) // LEAF))
        self.size = 1 << (n - 1).bit_length()
        self.words = [words[k * LEAF : (k + 1) * LEAF] for k in range(n)]
        self.counts = [counts[k * LEAF : (k + 1) * LEAF] for k in range(n)]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(n):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(map(len, self.words[k])), sum(self.counts[k])
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _set(self, leaf: int, words: list[str], counts: list[int]) -> None:
        self.words[leaf], self.counts[leaf] = words, counts
        k = self.size + leaf
        self.chars[k], self.tokens[k] = sum(map(len, words)), sum(counts)
        while k > 1:
            k //= 2
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf and place of the pre-token that holds character ``at``, and where it starts."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at - before >= self.chars[k]:
                before += self.chars[k]
                k += 1
        leaf = k - self.size
        for i, w in enumerate(self.words[leaf]):
            if at < before + len(w):
                return leaf, i, before
            before += len(w)
        raise IndexError(at)

    def _after(self, leaf: int, i: int):
        """Places and pre-tokens from (leaf, i) on."""
        while leaf < len(self.words):
            for j in range(i, len(self.words[leaf])):
                yield leaf, j, self.words[leaf][j]
            leaf, i = leaf + 1, 0

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replace ``cut`` characters from ``at`` on by ``put``."""
        total = self.chars[1]
        at = min(max(0, at), total)
        cut = min(max(0, cut), total - at)
        if not cut and not put:
            return
        if not total:
            words = self.lengths.words(put)
            self.encoded += len(words)
            self._build(words, self.lengths.counts(words))
            return
        leaf, i, start = self._find(max(0, at - AHEAD))
        # Old text from ``start`` on is read as far as the new split needs it.
        source = self._after(leaf, i)
        read: list[str] = []
        ends: dict[int, tuple[int, int]] = {}  # old boundaries past the edit, in new positions, with the place that follows
        shift = len(put) - cut
        size, here, done, want = 0, (leaf, i), False, at + cut - start
        while True:
            while size < want and not done:
                nxt = next(source, None)
                if nxt is None:
                    done = True
                    break
                l, j, w = nxt
                read.append(w)
                size += len(w)
                if size >= at + cut - start:
                    ends[size + shift] = (l, j + 1)
                here = (l, j + 1)
            done = done or size == total - start
            old = "".join(read)
            text = old[: at - start] + put + old[at - start + cut :]
            new, stop = [], None
            for m in self.lengths.split.finditer(text):
                if not done and m.end() > len(text) - AHEAD:
                    break
                new.append(m.group())
                if m.end() >= at - start + len(put) and m.end() in ends:
                    stop = ends[m.end()]
                    break
            if stop is not None:
                break
            if done:
                stop = here
                break
            want = 2 * size + 64
        self.encoded += len(new)
        counts = self.lengths.counts(new)
        last, j = stop
        words = self.words[leaf][:i] + new + self.words[last][j:]
        numbers = self.counts[leaf][:i] + counts + self.counts[last][j:]
        for k in range(leaf + 1, last + 1):
            self._set(k, [], [])
        self._set(leaf, words, numbers)
        if len(words) > LARGE * LEAF:
            self._build([w for part in self.words for w in part], [c for part in self.counts for c in part])


def count_edits(docs: DataFrame, lengths: Lengths | None = None) -> DataFrame:
    """From doc_id, text and edits (array of struct at, cut, put): token counts before and after.

    Also the pre-tokens after the edits and those encoded because of them.
    """
    lengths = lengths or Lengths()

    @F.pandas_udf("n_tokens bigint, n_tokens_edited bigint, n_pretokens bigint, n_reencoded bigint")
    def count(texts: pd.Series, edits: pd.Series) -> pd.DataFrame:
        rows = []
        for text, changes in zip(texts, edits):
            tree = Tree(lengths.words(text or ""), lengths)
            before = tree.tokens[1]
            for e in changes if changes is not None else ():
                tree.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
            rows.append((before, tree.tokens[1], sum(map(len, tree.words)), tree.encoded))
        return pd.DataFrame(rows, columns=["n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded"])

    return bounded(docs).select("doc_id", count("text", "edits").alias("r")).select("doc_id", "r.*")


def sample_edits(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, text and ``n`` edits per document, placed and sized by hashes of the id; inserted text is the document's own."""
    text = F.coalesce("text", F.lit(""))

    def edit(k: int):
        spot = lambda salt, top: F.pmod(F.xxhash64("doc_id", F.lit(3 * k + salt)), top).cast("int")
        size = F.length(text) + 1
        return F.struct(spot(0, size).alias("at"), spot(1, F.lit(40)).alias("cut"), F.substring(text, spot(2, size), spot(3, F.lit(60))).alias("put"))

    return docs.select("doc_id", "text", F.array(*[edit(k) for k in range(n)]).alias("edits"))
