"""Elias-Fano sequences in numpy arrays that can stand in a memory-mapped file.

A value is cut into ``low_bits`` packed bits and a high part; the high parts are
a bit vector with a one at (high part + index).  Selecting the k-th zero leads to
the few values with one high part, a binary search over these finds a successor.
All operations take arrays of queries.
"""

from __future__ import annotations

import json

import numpy as np


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each word."""
    place, k, word = np.zeros_like(k), k.copy(), word.copy()
    for step in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
        up = k >= ones
        k -= ones * up
        place += step * up
        word = np.where(up, word >> np.uint64(step), word)
    return place


def _packed_low(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, one after the other, and eight bytes to spare."""
    out = []
    for i in range(0, len(values) if bits else 0, 1 << 16):
        part = values[i:i + (1 << 16), None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
        out.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


class EliasFano:
    NAMES = ("head", "low", "words", "before")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.n, self.low_bits = (int(x) for x in arrays["head"])
        self.low, self.words, self.before = arrays["low"], arrays["words"], arrays["before"]

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """``values`` ascend (equal ones allowed) and are below ``universe``."""
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64)
        size = n + (universe >> bits) + 2
        flags = np.zeros((size // 64 + 1) * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        words = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        return cls({"head": np.array([n, bits], np.int64), "low": _packed_low(values, bits), "words": words,
                    "before": np.cumsum(ones) - ones})

    def _ones_at(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, "right") - 1
        return word * 64 + _select_in_word(self.words[word], k - self.before[word])

    def _zeros_at(self, k: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.before)) * 64 - self.before
        word = np.searchsorted(zeros, k, "right") - 1
        return word * 64 + _select_in_word(~self.words[word], k - zeros[word])

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        view = np.ndarray((len(self.low) - 7,), "<u8", buffer=self.low, strides=(1,))
        return (view[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._ones_at(i) - i) << self.low_bits | self._low_at(i)

    def successor(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value >= x, among the indexes [low, high) if given (else ``high``)."""
        x = x.astype(np.int64)
        part = x >> self.low_bits
        start = np.where(part > 0, self._zeros_at(np.maximum(part - 1, 0)) - part + 1, 0)
        stop = self._zeros_at(part) - part
        if low is not None:
            start, stop = np.clip(start, low, high), np.clip(stop, low, high)
        rest = x & ((1 << self.low_bits) - 1)
        while len(open_ := np.flatnonzero(start < stop)):
            mid = (start[open_] + stop[open_]) >> 1
            less = self._low_at(mid) < rest[open_]
            start[open_[less]], stop[open_[~less]] = mid[less] + 1, mid[~less]
        return start

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where it is no value."""
        if not self.n:
            return np.full(len(x), -1)
        i = self.successor(x)
        at = np.minimum(i, self.n - 1)
        return np.where((i < self.n) & (self.get(at) == x), i, -1)


def to_file(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays behind a header that says where each begins; all are aligned to eight bytes."""
    where, at = {}, 0
    for name, a in arrays.items():
        where[name] = (a.dtype.str, at, len(a))
        at += (a.nbytes + 7) // 8 * 8
    head = json.dumps(where).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays.values())])


def from_file(data) -> dict[str, np.ndarray]:
    """Views into a buffer (such as a memory-mapped file); nothing is copied."""
    size = int.from_bytes(bytes(data[:8]), "little")
    where = json.loads(bytes(data[8:8 + size]))
    return {name: np.frombuffer(data, dtype, n, 8 + size + at) for name, (dtype, at, n) in where.items()}
