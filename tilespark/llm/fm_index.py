"""An FM-index over a sequence of symbols: wavelet-matrix ranks, backward search
for many phrases at once, positions by sampled suffixes.

The sequence consists of segments (runs of symbols >= 1) that matches never
leave.  Suffixes are ordered with a separator of its own after each segment, so
sorting goes no deeper than the longest segment.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


class BitRank:
    """Bits packed in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.total = int(ones.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix of a symbol array."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.bits = max(1, int(most).bit_length())
        self.levels, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = symbols >> b & 1
            self.levels.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position i."""
        start = np.zeros_like(i)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            oi, os = level.ones(i), level.ones(start)
            i, start = np.where(one, zeros + oi, i - oi), np.where(one, zeros + os, start - os)
        return i - start

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and how often it occurs before i."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros):
            one = level.get(i)
            oi, os = level.ones(i), level.ones(start)
            i, start = np.where(one, zeros + oi, i - oi), np.where(one, zeros + os, start - os)
            symbol = symbol << 1 | one
        return symbol, i - start


def suffix_array(key: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes still tied are sorted again."""
    n = len(key)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width, active = 1, np.arange(n)  # active: positions in ``order`` whose rank is shared
    # rank = position in ``order`` of the first suffix of the tied group
    first = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0]) if n else np.zeros(0, np.int64)
    group = np.repeat(first, np.diff(np.r_[first, n]))
    rank[order] = group
    while True:
        tied = np.r_[group[1:] == group[:-1], False] | np.r_[False, group[1:] == group[:-1]] if len(group) else np.zeros(0, bool)
        active, group = active[tied], group[tied]
        if not len(active):
            return order
        at = order[active]
        nxt = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        by = np.lexsort((nxt, group))
        at, nxt = at[by], nxt[by]
        order[active] = at
        new = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        head = active[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        # a group's members are neighbours in ``order``, so a subgroup's rank is its first place
        rank[at] = head
        group = head
        width *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, most: int):
        """``symbols``: segments of symbols in 1..most, each followed by one 0."""
        self.n = n = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        key = symbols.astype(np.int64) + len(ends)
        key[ends] = np.arange(len(ends))
        suffix = suffix_array(key)
        before = symbols[suffix - 1]  # position 0 wraps to the last separator
        self.wavelet = Wavelet(before.astype(np.int64), most)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=most + 1))])
        sampled = (suffix % SAMPLE == 0) | (before == 0)  # a walk to a sample never leaves its segment
        self.marks, self.samples = BitRank(sampled), suffix[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases (one a row of equal length), all stepped together."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k].astype(np.int64)
            low[live] = self.start[c] + self.wavelet.rank(c, low[live])
            high[live] = self.start[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of suffix rows, by walking back to a sampled suffix."""
        rows = rows.copy()
        at, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            hit = self.marks.get(r)
            at[open_[hit]] = self.samples[self.marks.ones(r[hit])] + steps[open_[hit]]
            open_, r = open_[~hit], r[~hit]
            symbol, rank = self.wavelet.symbol_and_rank(r)
            rows[open_] = self.start[symbol] + rank
            steps[open_] += 1
        return at
