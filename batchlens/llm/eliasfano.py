"""Monotone sequences of 64-bit integers in Elias-Fano form, searched many at a time.

A sequence of n values below u keeps the low l = log2(u / n) bits of each packed, and the high bits in
unary: about 2 + l bits a value. The parts are plain arrays, so they can be memory-mapped.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def pack_arrays(arrays: list[np.ndarray]) -> list[bytes]:
    """Arrays one after the other, each from a multiple of 8 bytes on, after a table of their types and sizes."""
    table, parts = [len(arrays)], []
    for a in arrays:
        table += [a.dtype.itemsize, len(a)]
        parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
    return [np.array(table, "<i8").tobytes(), *parts]


def unpack_arrays(raw: np.ndarray) -> list[np.ndarray]:
    """Views of the arrays in ``raw`` (bytes, for example memory-mapped)."""
    n = int(raw[:8].view("<i8")[0])
    table = raw[8 : 8 + 16 * n].view("<i8").reshape(n, 2)
    out, at = [], 8 + 16 * n
    for size, length in table.tolist():
        out.append(raw[at : at + size * length].view(f"<u{size}"))
        at += -(-size * length // 8) * 8
    return out


def build(values: np.ndarray) -> list[np.ndarray]:
    """The arrays of an ascending sequence (uint64)."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    high = values >> np.uint64(low_bits)
    size = n + (top >> low_bits) + 2
    bits = np.zeros(-(-size // 64) * 64, bool)
    bits[high.astype(np.int64) + np.arange(n)] = True
    upper = np.packbits(bits, bitorder="little").view("<u8")
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(upper).astype(np.int64))])[:-1].astype("<u8")
    lower = np.zeros(n * low_bits // 64 + 2, np.uint64)
    if n and low_bits:
        v = values & np.uint64((1 << low_bits) - 1)
        bit = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        lower[word[first]] = np.bitwise_or.reduceat(v << shift, first)
        lower[word[first] + 1] |= np.bitwise_or.reduceat((v >> _ONE) >> (np.uint64(63) - shift), first)
    return [np.array([n, low_bits], "<u8"), upper, zeros, lower.astype("<u8")]


class EliasFano:
    """Look up keys in the arrays that ``build`` made."""

    def __init__(self, arrays: list[np.ndarray]):
        (n, low_bits), self.upper, self.zeros, self.lower = arrays[0].tolist(), arrays[1], arrays[2], arrays[3]
        self.n, self.low_bits = int(n), int(low_bits)
        self.ones = (np.arange(len(self.upper), dtype=np.uint64) << np.uint64(6)) - self.zeros
        self.most = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.upper[-1])) if len(self.upper) else 0

    @staticmethod
    def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The place of the r-th set bit (from 0) of each word."""
        at = np.zeros(len(word), np.uint64)
        r = r.astype(np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            h = np.uint64(half)
            low = np.bitwise_count((word >> at) & np.uint64((1 << half) - 1)).astype(np.uint64)
            up = r >= low
            r = np.where(up, r - low, r)
            at = np.where(up, at + h, at)
        return at

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``high``: ones before the high-th zero."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        k = high[some] - _ONE
        w = np.searchsorted(self.zeros, k, "right") - 1
        place = (w.astype(np.uint64) << np.uint64(6)) + self._in_word(~self.upper[w], k - self.zeros[w])
        out[some] = (place - k).astype(np.int64)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        w, s = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        v = (self.lower[w] >> s) | ((self.lower[w + 1] << _ONE) << (np.uint64(63) - s))
        return v & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        w = np.searchsorted(self.ones, i.astype(np.uint64), "right") - 1
        place = (w.astype(np.uint64) << np.uint64(6)) + self._in_word(self.upper[w], i.astype(np.uint64) - self.ones[w])
        return ((place - i.astype(np.uint64)) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the place of the first value not below it among those with its high bits, and whether it is equal."""
        if not self.n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        high = np.minimum(keys >> np.uint64(self.low_bits), np.uint64(self.most - 1))
        low = keys & np.uint64((1 << self.low_bits) - 1)
        lo, end = self._before(high), self._before(high + _ONE)
        hi, active = end.copy(), np.flatnonzero(lo < end)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self._low(mid) < low[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
            active = active[lo[active] < hi[active]]
        found = np.flatnonzero(lo < end)
        same = np.zeros(len(keys), bool)
        same[found] = (self._low(lo[found]) == low[found]) & (keys[found] >> np.uint64(self.low_bits) == high[found])
        return lo, same
