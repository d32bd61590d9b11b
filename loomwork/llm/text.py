"""Vectorised words and hashes over Arrow string columns, for use inside tasks.

A word is a maximal run of bytes other than blank, tab, newline, vertical tab,
form feed and carriage return. Hashes are 64-bit, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), _BASE if kind == "up" else _BASE_INVERSE)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if n <= 1 << 22:  # a single very long text doesn't stay in memory
            _powers[kind] = have
    return have[:n]


@dataclass
class Words:
    """Words of a run of texts. `first[i]:first[i + 1]` are the words of text i."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The text's index, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, data: np.ndarray | None = None, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word's bytes; other bytes (say, lower-cased) or spans may stand in."""
        data = self.data if data is None else data
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        n = len(data) + 1
        sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", n)[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _power("down", n)[starts] + (ends - starts).astype(np.uint64))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, space: np.ndarray = SPACE) -> Words:
    data, offsets = texts(column)
    inner = ~space[data]
    n = len(data)
    begins, stops = inner.copy(), inner.copy()
    if n:
        begins[1:] &= ~inner[:-1]
        stops[:-1] &= ~inner[1:]
        edge = offsets[:-1][offsets[:-1] < n]
        begins[edge] |= inner[edge]
        edge = offsets[1:][offsets[1:] > 0] - 1
        stops[edge] |= inner[edge]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word, for all but the last n - 1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= _BASE
        out += hashes[j : j + m]
    return mix(out)


def gram_mask(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the words that n-grams() starts at have n words left in their own text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return left[: total - n + 1] >= n


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i; 0 where that is empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `most` bytes of text, or a single text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        at, total = 0, np.cumsum(sizes)
        while at < len(sizes):
            before = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end
