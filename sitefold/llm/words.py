"""Words and hashes of many texts at a time, with numpy over Arrow buffers.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. Hashes are polynomial
over 64 bits, taken from prefix sums, so any run of words is hashed in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTERS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256).astype(U64) | U64(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 2**64))
        self.tables = [np.ones(1, U64), np.ones(1, U64)]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 1 << 16)
            self.tables = [
                np.cumprod(np.append(np.ones(1, U64), np.full(size - 1, b, U64)), dtype=U64)
                for b in self.bases
            ]
        return self.tables[0][:n], self.tables[1][:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes: (first, end, bytes, offsets in bytes); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Words of a run of texts: starts, ends (bytes), hash, and offsets of the texts in words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data = data
        inside = ~_SPACE[data]
        edge = np.empty_like(inside)
        edge[:1] = True
        edge[1:] = ~inside[:-1]
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        self.starts = np.flatnonzero(inside & edge)
        edge[:-1] = ~inside[1:]
        edge[-1:] = True
        edge[offsets[1:][offsets[1:] > 0] - 1] = True
        self.ends = np.flatnonzero(inside & edge) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), U64)
        low = 0
        while low < len(out):
            base = self.starts[low]
            high = max(low + 1, int(np.searchsorted(self.ends, base + SLICE_BYTES, "right")))
            part = self.data[base : self.ends[high - 1]]
            powers, inverse = _BYTE_POWERS.get(len(part) + 1)
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(_LETTERS[part] * powers[:-1], out=total[1:])
            s, e = self.starts[low:high] - base, self.ends[low:high] - base
            out[low:high] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
            low = high
        return out

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


class Runs:
    """Hashes of runs of words, by prefix sums over word hashes."""

    def __init__(self, words: np.ndarray):
        powers, self.inverse = _WORD_POWERS.get(len(words) + 1)
        self.total = np.zeros(len(words) + 1, U64)
        np.cumsum(words * powers[:-1], out=self.total[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts])

    def every(self, length: int) -> np.ndarray:
        """Hash of each run of ``length`` words."""
        n = len(self.total) - length
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.total[length:] - self.total[:n]) * self.inverse[:n])


def starts_of_runs(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``length`` words that lie in one text, and the text of each."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    return np.arange(len(text)) - before[text] + offsets[:-1][text], text
