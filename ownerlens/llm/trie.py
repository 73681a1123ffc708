"""Self-join of a binary trie over 64-bit keys, inside one task.

Keys are sorted, so a trie node is an interval and its children are found by
binary search on the next bit. Pairs of nodes descend together; bits in which they
differ are added up and a pair ends when it exceeds the budget. Small pairs are
compared key by key. Pairs whose keys are already connected are not compared again.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Node pairs of at most this many key pairs are compared directly.
LEAF = 256
#: Key pairs compared at once, and node pairs expanded at once.
BLOCK = 1 << 20
FRONT = 1 << 16


def _first_set(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: int) -> np.ndarray:
    """First position in each [lo, hi) whose bit ``shift`` is set; keys agree on all higher bits."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = ((keys[np.where(open_, mid, 0)] >> np.uint64(shift)) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _pairs(a0, a1, b0, b1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of the interval pairs, in blocks."""
    sizes = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    for s in range(0, total, BLOCK):
        k = np.arange(s, min(total, s + BLOCK))
        p = np.searchsorted(ends, k, side="right")
        r = k - (ends[p] - sizes[p])
        w = (b1 - b0)[p]
        yield a0[p] + r // w, b0[p] + r % w


class Forest:
    """Union by least label over positions 0..n-1, a batch of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            open_ = lo != hi
            if not open_.any():
                return
            i, j = i[open_], j[open_]
            np.minimum.at(root, hi[open_], lo[open_])
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def connect(keys: np.ndarray, a0, a1, b0, b1, top: int, budget: int) -> np.ndarray:
    """Root position of every key, where the start pairs (a, b) of nodes with ``64 - top`` bits left are joined.

    A start pair with a == b is a self-join. All keys of a start pair share their first ``top`` bits.
    """
    forest = Forest(len(keys))
    stack = [(np.asarray(a0), np.asarray(a1), np.asarray(b0), np.asarray(b1), np.zeros(len(a0), np.int64), top)]
    while stack:
        a0, a1, b0, b1, diff, depth = stack.pop()
        if len(a0) > FRONT:
            for s in range(0, len(a0), FRONT):
                stack.append(tuple(x[s : s + FRONT] for x in (a0, a1, b0, b1, diff)) + (depth,))
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth == 64)
        for i, j in _pairs(a0[small], a1[small], b0[small], b1[small]):
            new = forest.root[i] != forest.root[j]
            i, j = i[new], j[new]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            forest.link(i[near], j[near])
        a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        am, bm = _first_set(keys, a0, a1, 63 - depth), _first_set(keys, b0, b1, 63 - depth)
        same = (a0 == b0) & (a1 == b1)
        # Children (zero, zero), (one, one) keep the count; (zero, one) and, unless it is a self-pair, (one, zero) add a bit.
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1),
                 tuple(x[~same] for x in (am, a1, b0, bm, diff + 1))]
        x = [np.concatenate(c) for c in zip(*parts)]
        live = (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= budget)
        if live.any():
            stack.append(tuple(c[live] for c in x) + (depth + 1,))
    return forest.root
