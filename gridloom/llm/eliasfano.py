"""Elias-Fano coding of sorted integers, over arrays that may be memory-mapped, with lookups of many keys at once."""

from __future__ import annotations

import numpy as np

U = np.uint64


def _gathered(words: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Values summed into the words (ascending) that they belong to; their bits are apart, so that is a union."""
    out = np.zeros(size, U)
    if len(words):
        begins = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        out[words[begins]] = np.add.reduceat(values, begins)
    return out


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one of each word."""
    place = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
        on = k >= ones
        k = np.where(on, k - ones, k)
        word = np.where(on, word >> U(width), word)
        place += on * width
    return place


class EliasFano:
    """Ascending values: low bits packed, high bits as a unary sequence with counts of ones before each word."""

    FIELDS = ("low", "high", "ranks")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ranks = n, bits, low, high, ranks
        self._zeros: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(U), len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        at = np.arange(n, dtype=np.int64)
        if bits:
            cut, start = values & U((1 << bits) - 1), at * bits
            word, off = start >> 6, (start & 63).astype(U)
            size = (n * bits >> 6) + 2
            low = _gathered(word, cut << off, size)
            over = off.astype(np.int64) + bits > 64
            low |= _gathered(word[over] + 1, cut[over] >> (U(64) - off[over]), size)
        else:
            low = np.zeros(0, U)
        ones = (values >> U(bits)).astype(np.int64) + at
        length = n + (max(1, universe) >> bits) + 2
        high = _gathered(ones >> 6, U(1) << (ones & 63).astype(U), (length >> 6) + 1)
        counts = np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.cumsum(counts) - counts)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        start = i * self.bits
        word, off = start >> 6, (start & 63).astype(U)
        above = np.where(off > U(0), self.low[word + 1] << (U(64) - np.maximum(off, U(1))), U(0))
        return (self.low[word] >> off | above) & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ranks, i, "right") - 1
        ones = (word << 6) + _select_in_word(self.high[word], i - self.ranks[word])
        return (ones - i).astype(U) << U(self.bits) | self._low(i)

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        if self._zeros is None:
            self._zeros = np.arange(len(self.ranks), dtype=np.int64) * 64 - self.ranks
        word = np.searchsorted(self._zeros, k, "right") - 1
        return (word << 6) + _select_in_word(~self.high[word], k - self._zeros[word]) - k

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key (below the universe): the first index whose value isn't less, and whether it is equal."""
        high, low = (keys >> U(self.bits)).astype(np.int64), keys & U((1 << self.bits) - 1)
        a = np.where(high > 0, self._ones_before_zero(np.maximum(high - 1, 0)), 0)
        # the bucket's ones follow each other up to the next zero, mostly within the word
        bit = a + high
        word, off = bit >> 6, (bit & 63).astype(U)
        left = ~self.high[word] >> off
        end = a + np.bitwise_count((left & (~left + U(1))) - U(1)).astype(np.int64)
        if len(over := np.flatnonzero(left == 0)):
            end[over] = self._ones_before_zero(high[over])
        b = end.copy()
        while len(open_ := np.flatnonzero(a < b)):
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
        inside = np.flatnonzero(a < end)
        same = np.zeros(len(keys), bool)
        same[inside] = self._low(a[inside]) == low[inside]
        return a, same
