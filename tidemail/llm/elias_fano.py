"""Elias-Fano coded monotone sequences over plain arrays.

A value's high bits stand in unary in a bit vector (0.5 bit a word of rank
besides), its low bits packed: about 2 + log2(universe / n) bits a value.
Queries take arrays and answer all at once.
"""

from __future__ import annotations

import numpy as np

_U1 = np.uint64(1)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word."""
    at = np.zeros(len(word), np.uint64)
    k = k.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = (word >> at) & np.uint64((1 << half) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        up = k >= n
        k -= np.where(up, n, 0)
        at += np.where(up, np.uint64(half), np.uint64(0))
    return at.astype(np.int64)


class EliasFano:
    """``values``: sorted, not negative (uint64)."""

    def __init__(self, values: np.ndarray):
        v = values.astype(np.uint64)
        self.n = len(v)
        top = int(v[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        shift = np.uint64(self.low_bits)
        high = (v >> shift).astype(np.int64)
        size = self.n + (int(high[-1]) if self.n else 0) + 1
        bits = np.zeros((size // 64 + 1) * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32 if self.n < 1 << 31 else np.int64)
        self.zeros_n = size - self.n
        self.low = _pack(v & np.uint64((1 << self.low_bits) - 1), self.low_bits)

    def nbytes(self) -> int:
        return self.high.nbytes + self.ones.nbytes + self.low.nbytes

    def _low(self, i: np.ndarray) -> np.ndarray:
        return _unpack(self.low, self.low_bits, i)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """Number of values whose high part is under ``high``: the ones before
        the zero number high - 1."""
        k = high - 1
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.clip(np.searchsorted(zeros, k, "right") - 1, 0, len(self.high) - 1)
        at = word * 64 + _select_in_word(~self.high[word], np.maximum(k - zeros[word], 0))
        return np.where(high <= 0, 0, np.minimum(at - k, self.n))

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of x (successor search, inside [first, end) where given), or
        -1 where the successor is another value."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        most = int(self.zeros_n) - 1
        inside = high <= most
        h = np.minimum(high, most)
        lo, hi = self._bucket(h), self._bucket(h + 1)
        hi = np.where(h >= most, self.n, hi)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, end)
        low = x & np.uint64((1 << self.low_bits) - 1)
        out = np.full(len(x), -1, np.int64)
        live = np.flatnonzero(inside & (lo < hi))
        lo, hi, low = lo[live], hi[live], low[live]
        while len(live):                     # halve the few values of a bucket
            mid = (lo + hi) >> 1
            v = self._low(mid)
            hit = v == low
            out[live[hit]] = mid[hit]
            lo, hi = np.where(v < low, mid + 1, lo), np.where(v < low, hi, mid)
            keep = ~hit & (lo < hi)
            live, lo, hi, low = live[keep], lo[keep], hi[keep], low[keep]
        return out


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits one after the other in 64-bit words."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << bit)
        over = bit + np.uint64(width) > np.uint64(64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - bit[over]))
    return out


def _unpack(packed: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.uint64) * np.uint64(width)
    word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    high = np.where(bit > 0, packed[word + 1] << ((np.uint64(64) - bit) & np.uint64(63)), np.uint64(0))
    return ((packed[word] >> bit) | high) & np.uint64((1 << width) - 1)
