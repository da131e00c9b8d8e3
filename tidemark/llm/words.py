"""Words of whole Arrow text columns as numpy arrays: places, hashes, k-grams and winnowed anchors.

Everything works on slices of a few megabytes of consecutive documents, so that memory in a task
does not depend on how many or how long the documents of a partition are (one document is never
cut). Hashes have 64 bits and depend on the words alone, not on what stands between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

U64 = np.uint64
_LOW32 = U64(0xFFFFFFFF)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that tells for each of the 256 bytes whether it lies in one of the ranges."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first:last + 1] = True
    return table


# Words between white space: all bytes but space and 0x09 to 0x0D.
BETWEEN_SPACES = ~byte_class((0x20, 0x20), (0x09, 0x0D))
# Words of digits, letters and everything beyond ASCII.
ALPHANUMERIC = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of each number over all 64 (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Polynomial:
    """Hashes of all ranges of a sequence from one running sum, modulo 2**64."""

    def __init__(self, base: int, seed: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.values = mix(np.arange(256, dtype=U64) + U64(seed * 1_000_003 + 1))
        self._powers = self._inverses = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, step in (("_powers", self.base), ("_inverses", self.inverse)):
                powers = np.full(size, step, dtype=U64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * self._powers[:len(values)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self._inverses[starts] + (ends - starts).astype(U64))


BYTE_HASHES = (Polynomial(0x9E3779B97F4A7C15, 1), Polynomial(0xD6E8FEB86659FD93, 2))
_WORDS = (Polynomial(0xA0761D6478BD642F, 3), Polynomial(0xE7037ED1A0B428DB, 4))


@dataclass
class Words:
    """The words of some documents. ``bounds`` has for each document where its words begin."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def documents(self) -> np.ndarray:
        """The document each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, which: int = 0) -> np.ndarray:
        kind = BYTE_HASHES[which]
        return kind.ranges(kind.sums(kind.values[self.data]), self.starts, self.ends)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """All maximal runs of bytes in ``table``, none across the end of a document."""
    inside = table[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:len(data)] = inside
    after[offsets[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


class Grams:
    """Hashes of runs of words, each within one document."""

    def __init__(self, words: Words, which: int = 0):
        self.kind = _WORDS[which]
        self.sums = self.kind.sums(words.hashes(which))

    def of(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.kind.ranges(self.sums, first, after)


def starts_of_runs(words: Words, length: int) -> np.ndarray:
    """The first word of every run of ``length`` words within one document."""
    room = np.maximum(words.counts - length + 1, 0)
    offset = words.bounds[:-1] - (np.cumsum(room) - room)
    return np.arange(room.sum()) + np.repeat(offset, room)


def winnow(words: Words, grams: Grams, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of every window of ``length`` words: its smallest k-gram, the rightmost of ties.

    Returns for each anchor its place and the first and last window (by their first word) that it
    stands for. Two equal windows have equal anchors at equal places within them.
    """
    windows = starts_of_runs(words, length)
    if not len(windows):
        return windows, windows, windows
    n = int(words.bounds[-1]) - k + 1
    at = np.arange(n)
    key = (grams.of(at, at + k) & ~_LOW32) | (_LOW32 - at.astype(U64))
    width, least = 1, key
    span = length - k + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    anchors = (_LOW32 - (least[windows] & _LOW32)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    last = np.concatenate((new[1:], [len(windows)])) - 1
    return anchors[new], windows[new], windows[last]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    held = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return held, offsets - first if len(column) else np.zeros(1, np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about ``limit`` bytes of text, each with bytes and offsets."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            part = offsets[row:end + 1]
            yield batch.slice(row, end - row), data[part[0]:part[-1]], part - part[0]
            row = end


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the longs that Spark has."""
    return np.ascontiguousarray(x).view(np.int64)
