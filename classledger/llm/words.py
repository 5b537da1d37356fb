"""Words of whole texts as numpy arrays, straight from an Arrow buffer.

A word is a run of bytes other than space and \\x09-\\x0D (the class
``[^\\x20\\x09-\\x0D]+`` of the contracts; no byte of a multi-byte UTF-8
character falls in the separators). Words are 64-bit hashes here: a polynomial
over a table of random values, then mixed. Two different words share a hash
with odds of about 2**-64; queries whose result is a text cut the words out of
the text itself, never out of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_PLAIN = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLAIN[list(SEPARATORS)] = 0
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _LOWER[97:123]
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; grown by doubling and kept."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if size <= 4 * CHUNK_BYTES:  # a single very long text shall not keep its table
            _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words(NamedTuple):
    """``first[d]:first[d+1]`` are the words of text d; start and end are bytes in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, offsets = texts_of(column)
    for at, to in runs(offsets, limit):
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(from row, to row) of runs of about ``limit``, a row at least."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to
        at = to


def hash_runs(data: np.ndarray, start: np.ndarray, table: np.ndarray = _PLAIN) -> np.ndarray:
    """Hash of the bytes from each start to the next, separators left out."""
    values = table[data]
    values *= _power(_BASE, len(data))
    return mix(np.add.reduceat(values, start) * _power(_INVERSE, len(data))[start])


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts ``data[offsets[d]:offsets[d+1]]``; ``lower``: A-Z hash as a-z."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, np.zeros(len(offsets), np.int64), none.astype(np.uint64), none, none)
    sep = _IS_SEP[data]
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = sep[:-1]
    inner = offsets[:-1]
    begins[inner[inner < n]] = True
    begins &= ~sep
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, first, none.astype(np.uint64), none, none)
    h = hash_runs(data, start, _LOWER if lower else _PLAIN)
    ends = sep.copy()
    ends[inner[(inner > 0) & (inner < n)]] = True  # a text's start ends the word before it
    stops = np.append(np.flatnonzero(ends), n)
    end = stops[np.searchsorted(stops, start, "right")]
    return Words(data, offsets, first, h, start, end)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words that starts at word i, and whether it lies in one text.

    The last ``size - 1`` entries, and runs over a text's end, are not valid.
    """
    n = len(words.hash)
    out = np.zeros(n, np.uint64)
    if n >= size:
        if size <= 8:
            powers = _power(_BASE, size + 1)
            for j in range(size):
                out[: n - size + 1] += words.hash[j : n - size + 1 + j] * powers[j]
        else:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(words.hash * _power(_BASE, n), out=sums[1:])
            out[: n - size + 1] = (sums[size:] - sums[: n - size + 1]) * _power(_INVERSE, n)[: n - size + 1]
        out = mix(out)
    return out, inside(words, size)


def inside(words: Words, size: int) -> np.ndarray:
    """Whether the run of ``size`` words from word i lies in one text."""
    counts = words.counts()
    left = np.repeat(words.first[1:], counts) - np.arange(len(words.hash))
    return left >= size
