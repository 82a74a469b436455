"""Words of UTF-8 bytes in numpy: places, hashes, and equality that is checked byte by byte.

Works on the buffers of an Arrow column.  A word is a maximal run of bytes other than
space and U+0009 to U+000D, and never reaches from one value into the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Bytes that are hashed at a time, unless one word is longer.
_SPAN = 1 << 20
_powers: list[np.ndarray] = []


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins and the last one ends; no copies."""
    places = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[places[0] : places[-1]]
    return data, places - places[0]


def word_places(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and how many words the values before each value have."""
    inside = ~_IS_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = places[:-1][places[:-1] < places[1:]]  # of values that have a byte
    starts[first] = inside[first]
    last = places[1:][places[:-1] < places[1:]] - 1
    ends[last] = inside[last]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, places)


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _SPAN)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n - 1, b, dtype=np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges in ascending order, by differences of prefix sums of a polynomial."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(int(np.searchsorted(ends, base + _SPAN, side="right")), at + 1)
        s, e = starts[at:upto] - base, ends[at:upto] - base
        power, inverse = _tables(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
        np.cumsum(data[base : base + e[-1]] * power[: e[-1]], out=sums[1:])
        out[at:upto] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _MIX[1]
        at = upto
    for mix in _MIX:
        out ^= out >> np.uint64(33)
        out *= mix
    return out ^ (out >> np.uint64(33))


def ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()))


def same_bytes(data: np.ndarray, begin_a: np.ndarray, length_a: np.ndarray, begin_b: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """Whether range a and range b of each pair hold the same bytes."""
    same = length_a == length_b
    at = np.flatnonzero(same & (length_a > 0))
    step = 1 << 18  # pairs at a time
    for low in range(0, len(at), step):
        some = at[low : low + step]
        lengths = length_a[some]
        differ = data[ranges(begin_a[some], lengths)] != data[ranges(begin_b[some], lengths)]
        if differ.any():
            same[some[np.unique(np.repeat(np.arange(len(some)), lengths)[differ])]] = False
    return same
