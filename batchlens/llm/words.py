"""Words and shingles of whole texts as 64-bit hashes, a column of texts at a time.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lowered. A word's hash is a polynomial of its bytes modulo 2**64 over random
odd coefficients, so one running sum over a block of bytes gives all words of it.
Two different words have the same hash with a chance of about 2**-60 for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240607))
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[65:91] = _CODE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts and ends in them; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _block_words(data: np.ndarray, space: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(first)
    ends = space.copy()
    ends[:-1] |= first[1:] & ~space[:-1]
    word = ~space
    last = word.copy()
    last[:-1] &= ends[1:] & space[1:] | first[1:]
    stops = np.flatnonzero(last) + 1
    power, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_CODE[data] * power, out=sums[1:])
    h = (sums[stops] - sums[starts]) * inverse[starts]
    return mix(h ^ (stops - starts).astype(np.uint64)), starts


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and the bounds of each text's words in them."""
    data, offsets = texts_of(column)
    n = len(data)
    hashes, starts, at = [], [], 0
    text_start = np.zeros(n + 1, bool)
    text_start[offsets[:-1]] = True
    while at < n:
        stop = min(n, at + _BLOCK)
        space = _SPACE[data[at:stop]]
        while stop < n and not space[-1] and not text_start[stop]:
            gaps = np.flatnonzero(space | False)
            cut = gaps[-1] + 1 if len(gaps) else 0
            begun = np.flatnonzero(text_start[at + 1 : stop])
            cut = max(cut, begun[-1] + 1 if len(begun) else 0)
            if cut:
                stop = at + int(cut)
                space = space[:cut]
                break
            stop = min(n, stop + _BLOCK)
            space = _SPACE[data[at:stop]]
        first = ~space
        first[1:] &= space[:-1] | text_start[at + 1 : stop]
        h, s = _block_words(data[at:stop], space, first)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text (fewer words: one of all of them), and their bounds."""
    counts = np.diff(bounds)
    n = np.maximum(counts - k + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(n)])
    odd = [np.uint64(pow(_BASE, 2 * i + 1, 1 << 64)) for i in range(k)]
    total = len(words) - k + 1
    every = np.zeros(max(total, 0), np.uint64)
    for i in range(k):
        if total > 0:
            every += words[i : i + total] * odd[i]
    out = np.empty(int(out_bounds[-1]), np.uint64)
    long = counts >= k
    if total > 0:
        keep = np.zeros(len(words) + 1, np.int64)
        np.add.at(keep, bounds[:-1][long], 1)
        np.add.at(keep, bounds[1:][long] - k + 1, -1)
        where = np.zeros(len(out) + 1, np.int64)
        np.add.at(where, out_bounds[:-1][long], 1)
        np.add.at(where, out_bounds[1:][long], -1)
        out[np.cumsum(where)[:-1] > 0] = every[np.cumsum(keep)[:total] > 0]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        x = words[bounds[d] : bounds[d + 1]]
        out[out_bounds[d]] = np.bitwise_xor.reduce((x * np.array(odd[: len(x)], np.uint64)) + np.uint64(len(x)))
    return mix(out), out_bounds


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text and of ``rows`` rows (one row at least)."""
    for batch in batches:
        column = batch.column(text)
        if not len(column):
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, base + most, "right"))))
            yield batch.slice(at, stop - at)
            at = stop
