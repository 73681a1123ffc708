"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

Strings are cyclic: the rows of a transform are all rotations of all strings in
order, and a row's symbol is the byte before its rotation. Two or more transforms are
merged without sorting rotations again: the interleave says from which transform each
row of the merged order comes. Rows ordered by their first h bytes are, read by their
symbols, a stable bucket sort away from the order by h + 1; as many symbols are taken
at once as have 65,536 combinations at most. Rows that agree so far form blocks; where
a block splits the common prefix ends, and blocks that hold together are repeats.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Keys up to which numbers are found through a table.
TABLE = 1 << 22
#: Combinations of k symbols beyond which those of 2 k are not tried, and most symbols taken at once.
MANY = 40_000
LONGEST = 16


@dataclass
class Transform:
    """``symbols``: the transform; ``sizes``: the strings' lengths; ``rows``: the row of each string as it is."""

    symbols: np.ndarray
    sizes: np.ndarray
    rows: np.ndarray


def _next(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every string, and for every byte the one after it in its string, round the end."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    after = np.arange(1, int(ends[-1]) + 1)
    after[ends - 1] = starts
    return starts, after


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order, class number in that order by place, and how many classes."""
    order = np.argsort(key)
    sorted_ = key[order]
    number = np.empty(len(key), np.int64)
    number[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
    return order, number, int(number[order[-1]]) + 1


def transform(data: np.ndarray, sizes: np.ndarray) -> Transform:
    """Transform of the strings that lie one after another in ``data``; none is empty."""
    starts, after = _next(sizes)
    key, jump = data.astype(np.uint64), after
    for bits in (8, 16, 32):
        key = (key << np.uint64(bits)) | key[jump]
        jump = jump[jump]
    order, number, count = _classes(key)
    while count < len(data):
        order, finer, found = _classes(number * count + number[jump])
        if found == count:
            break  # rotations that still agree are equal for ever
        number, count, jump = finer, found, jump[jump]
    before = np.empty(len(data), np.int64)
    before[after] = np.arange(len(data))
    place = np.empty(len(data), np.int64)
    place[order] = np.arange(len(data))
    return Transform(data[before[order]], sizes, place[starts])


def forward(symbols: np.ndarray) -> np.ndarray:
    """For every row the row of the rotation that starts one byte later."""
    return np.argsort(symbols, kind="stable")


def _dense(keys: list[np.ndarray], top: int) -> tuple[list[np.ndarray], int]:
    """The keys, all below ``top``, numbered in their order without gaps."""
    if top > TABLE:
        _, number, count = _classes(np.concatenate(keys))
        return np.split(number, np.cumsum([len(k) for k in keys])[:-1]), count
    met = np.zeros(top, bool)
    for k in keys:
        met[k] = True
    number = np.cumsum(met) - 1
    return [number[k] for k in keys], int(number[-1]) + 1


def _grams(parts: list[Transform]) -> list[tuple[int, np.ndarray]]:
    """(k, number of the k bytes before each row's rotation) for k = 1, 2, 4 ... while 16 bits hold the numbers."""
    steps = []
    for p in parts:
        step = forward(p.symbols)
        back = np.empty(len(step), np.int64)
        back[step] = np.arange(len(step))
        steps.append(back)
    numbers, count = _dense([p.symbols.astype(np.int64) for p in parts], 256)
    out, k = [], 1
    while True:
        out.append((k, np.concatenate(numbers).astype(np.uint16 if count > 256 else np.uint8)))
        if count > MANY or k >= LONGEST:
            return out
        numbers, count = _dense([n[b] * count + n for n, b in zip(numbers, steps)], count * count)
        if count > 1 << 16:
            return out
        steps, k = [b[b] for b in steps], 2 * k


def merge_blocks(parts: list[Transform], length: int) -> list[np.ndarray]:
    """For every row of every transform the number of its block: rows of one block have ``length`` bytes in common."""
    total = sum(len(p.symbols) for p in parts)
    interleave = np.repeat(np.arange(len(parts), dtype=np.uint8 if len(parts) < 256 else np.int64), [len(p.symbols) for p in parts])
    block, count = np.zeros(total, np.int32), 1
    new = np.zeros(total, bool)
    left = length
    for k, symbols in reversed(_grams(parts)):
        while left >= k:
            left -= k
            # The rows of each transform come in their own order.
            read = np.empty(total, symbols.dtype)
            read[np.argsort(interleave, kind="stable")] = symbols
            order = np.argsort(read, kind="stable")
            interleave, read, block = interleave[order], read[order], block[order]
            np.not_equal(read[1:], read[:-1], out=new[1:])
            new[1:] |= block[1:] != block[:-1]
            block = np.cumsum(new, dtype=np.int32)
            found, before = int(block[-1]) + 1, count
            if found == before:
                left = 0  # nothing has split, so nothing will
            count = found
    return [block[interleave == n] for n in range(len(parts))]


def first_holders(parts: list[Transform], starts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (start, n) of positions whose ``length`` bytes stand nowhere earlier.

    A string of n bytes has the positions from its start on whose ``length`` bytes it holds: n - length + 1.
    """
    blocks = merge_blocks(parts, length)
    found = []
    for p, b in zip(parts, blocks):
        step, row, left = forward(p.symbols), p.rows.copy(), p.sizes - length + 1
        grid = np.full((len(row), int(left.max())), -1, np.int32)
        for k in range(grid.shape[1]):
            on = left > k
            grid[on, k] = b[row[on]]
            row[on] = step[row[on]]
        found.append(grid)
    low = np.full(max(int(b.max()) for b in blocks) + 1, np.iinfo(np.int64).max)
    for grid, at in zip(found, starts):
        held = grid >= 0
        np.minimum.at(low, grid[held], (at[:, None] + np.arange(grid.shape[1]))[held])
    at, size = [], []
    for grid, start in zip(found, starts):
        place = start[:, None] + np.arange(grid.shape[1])
        first = np.zeros((grid.shape[0], grid.shape[1] + 2), np.int8)
        first[:, 1:-1] = (grid >= 0) & (low[grid] == place)
        turn = np.diff(first, axis=1)
        (i, a), (_, z) = np.nonzero(turn == 1), np.nonzero(turn == -1)
        at.append(start[i] + a)
        size.append(z - a)
    return np.concatenate(at), np.concatenate(size)
