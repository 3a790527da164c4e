"""Vectorised word scanning of Arrow string columns, for use inside Spark tasks.

A batch is walked in slices of a few MB so that the working arrays stay small whatever the batch
holds; a document is never split and never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text per slice. A longer document is a slice of its own.
SLICE_BYTES = 2 << 20
#: Characters of a word that are hashed column by column; what is longer goes through blake2b.
LONG_WORD = 32

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and every byte of a non-ASCII character.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Slice:
    """Rows ``lo:hi`` of a batch. Words ``bounds[k]:bounds[k + 1]`` belong to row ``lo + k``."""

    lo: int
    hi: int
    data: np.ndarray  # bytes of all texts, lower-cased if asked for
    offsets: np.ndarray  # of each text in data
    starts: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.zeros(len(self.starts), np.uint64)
        live = np.arange(len(self.starts))
        for k in range(LONG_WORD):
            if k:
                live = live[self.lengths[live] > k]
            if not len(live):
                break
            out[live] = out[live] * _STEP + _BYTE_CODES[self.data[self.starts[live] + k]]
        for i in np.flatnonzero(self.lengths > LONG_WORD):
            word = self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()
            out[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return mix64(out)

    def prefix_hashes(self, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size, in ascending order: the words that are longer, and hashes of their first bytes."""
        live, value = np.arange(len(self.starts)), np.zeros(len(self.starts), np.uint64)
        for k in range(max(sizes)):
            inside = self.lengths[live] > k
            live, value = live[inside], value[inside]
            value = value * _STEP + _BYTE_CODES[self.data[self.starts[live] + k]]
            if k + 1 in sizes:
                longer = self.lengths[live] > k + 1
                yield live[longer], mix64(value[longer] + np.uint64(k + 1))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.bounds))


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def slices(column: pa.Array | pa.ChunkedArray, word: np.ndarray = NOT_SPACE, lower: bool = False) -> Iterator[Slice]:
    """The words of every text, slice by slice."""
    column = as_strings(column)
    data, offsets = buffers(column)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if lower:
            part = LOWER[part]
        inside = word[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = own[(own > 0) & (own < len(part))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        starts = np.flatnonzero(first)
        lengths = np.flatnonzero(last) - starts + 1
        yield Slice(lo, hi, part, own, starts, lengths, np.searchsorted(starts, own))
        lo = hi


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows that lie in one row, and the index of each one's first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:n].copy()
    for j in range(1, width):
        total *= _STEP
        total += hashes[j : n + j]
    whole = np.ones(n, bool)
    for back in range(1, width):
        at = bounds[1:-1] - back
        whole[at[(at >= 0) & (at < n)]] = False
    first = np.flatnonzero(whole)
    return mix64(total[first]), first


def per_row_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])
