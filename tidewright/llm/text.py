"""Words of Arrow string columns as 64-bit hashes, in numpy passes over the column's own bytes.

A word is a maximal run of word bytes inside one row. The hash of a word is a polynomial over
random byte values modulo 2**64, finished by a mixing step: equal words always agree, different
words agree with odds of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes tokenised in one numpy pass, and text bytes of one slice of a batch.
PIECE, SLICE = 1 << 19, 4 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _ODD(256)[_LOWER]
_BASE = int(_ODD(1)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_FOLD = [int(x) for x in _ODD(2)]


def _word_table(separators) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table[_LOWER]


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, both after lower-casing A-Z.
SPACED = _word_table([0x20, *range(0x09, 0x0E)])
ALNUM = _word_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        grown = np.full(max(n, PIECE + 4096), base, np.uint64)
        grown[0] = 1
        have = _powers[str(base)] = np.cumprod(grown)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the rows' offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, name: str, size: int = SLICE, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most so many rows, whose texts together stay near size bytes (one row at least)."""
    _, off = raw(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to
    trim()


def trim() -> None:
    """Gives freed memory back to the system, so that a worker kept for later tasks stays small."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Words(NamedTuple):
    """Hashes of all words in order; the words of row r are hash[ptr[r]:ptr[r + 1]]."""

    hash: np.ndarray
    ptr: np.ndarray
    heads: list[np.ndarray] = []

    def row(self, r: int) -> np.ndarray:
        return self.hash[self.ptr[r] : self.ptr[r + 1]]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all runs of k words inside one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.ptr[1:], np.diff(self.ptr))[:n] - np.arange(n)
        at = np.flatnonzero(left >= k)
        return at, fold([self.hash[at + i] for i in range(k)])


def fold(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full_like(parts[0], np.uint64(_FOLD[0] ^ len(parts)))
    for p in parts:
        h = mix(h * np.uint64(_FOLD[1]) + p)
    return h


def words(column: pa.Array, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """All words; with prefixes, also the hashes of each word's first so many bytes (0 if it has fewer)."""
    data, off = raw(column)
    starts, hashes, heads = [], [], [[] for _ in prefixes]
    lo, end = 0, len(data)
    while lo < end:
        hi = min(lo + PIECE, end)
        while hi < end and table[data[hi]] and table[data[hi - 1]] and off[np.searchsorted(off, hi)] != hi:
            step = data[hi : hi + 4096]
            stop = np.flatnonzero(~table[step])
            hi = hi + int(stop[0]) if len(stop) else min(hi + len(step), end)
        piece, n = data[lo:hi], hi - lo
        is_word = table[piece]
        first = off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        begins[first] = is_word[first]
        stops = np.zeros(n + 1, bool)
        stops[1:] = is_word
        stops[1:n] &= ~is_word[1:]
        cut = first[first > 0]
        stops[cut] = is_word[cut - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(stops)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[piece] * _power(_BASE, n), out=sums[1:])
        hashes.append(mix((sums[e] - sums[b]) * _power(_INVERSE, n)[b] + (e - b).astype(np.uint64)))
        for own, k in zip(heads, prefixes, strict=True):
            stop = np.minimum(b + k, n)
            own.append(np.where(e - b >= k, mix((sums[stop] - sums[b]) * _power(_INVERSE, n)[b] + np.uint64(k << 32)), np.uint64(0)))
        starts.append(b + lo)
        lo = hi
    if not starts:
        return Words(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), [np.zeros(0, np.uint64) for _ in prefixes])
    return Words(np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off).astype(np.int64), [np.concatenate(x) for x in heads])
