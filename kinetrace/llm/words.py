"""Vectorised word splitting and hashing of Arrow string columns.

A word is a run of bytes other than space and \\t-\\r; A-Z is lower-cased.  All functions work on whole texts, in slices
of about a quarter megabyte so that temporary arrays stay small whatever the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_IS_WORD = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 2**64)


def trimmed(run):
    """A function over batches that hands what its worker has freed back to the system when it ends."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            # Not every C library has it.
            return

    return whole


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, with a salt."""
    x = x + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 11)
_LOW_BYTE = _BYTE[_LOWER]


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, made as long as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * SLICE)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base % 2**64, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of consecutive rows of about SLICE bytes."""
    data, offsets = raw(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        yield row, to, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each row's first word (n + 1)."""
    inside = _IS_WORD[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data) + 1, bool)
    after[:-1] = inside
    after[-1] = False
    after[offsets[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOW_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


_PLACES = [int(x) | 1 for x in mix(np.arange(64, dtype=np.uint64), 5)]


def windows(words: np.ndarray, places) -> np.ndarray:
    """Hashes of the words at ``places`` (offsets) of every window; len(words) - max(places) of them at most."""
    n = len(words) - max(places)
    if n <= 0:
        return np.zeros(0, np.uint64)
    return hashed([words[i : i + n] for i in places], places)


def hashed(columns: list[np.ndarray], places) -> np.ndarray:
    """The hashes of windows, given the words at each of ``places``."""
    out = np.zeros(len(columns[0]), np.uint64)
    for words, i in zip(columns, places, strict=True):
        out += words * U64(_PLACES[i % 64])
    return mix(out, 3)


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, at a cost that n doesn't change."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1], 7)


class Buckets:
    """Collects arrays of equal length and hands them out as one binary row per bucket.

    Packed rows cost the shuffle a few objects per task instead of one row per entry.
    """

    def __init__(self, buckets: int, kinds: tuple, limit: int = 1 << 18):
        self.buckets, self.kinds, self.limit, self.held, self.parts = buckets, kinds, limit, 0, []

    def add(self, where: np.ndarray, *arrays: np.ndarray) -> None:
        """Entries, each bound for the bucket that its hash ``where`` names."""
        self.parts.append(((where % U64(self.buckets)).astype(np.uint32), *arrays))
        self.held += len(where)

    def full(self) -> bool:
        return self.held >= self.limit

    def take(self) -> Iterator[tuple]:
        """(bucket, bytes of each array) rows; forgets what was held."""
        if not self.held:
            return
        bucket, *arrays = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.held = [], 0
        order = np.argsort(bucket.astype(np.uint16) if self.buckets < 65536 else bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        arrays = [a[order] for a in arrays]
        for b in np.flatnonzero(np.diff(bounds)):
            yield (int(b), *(a[bounds[b] : bounds[b + 1]].astype(k).tobytes() for a, k in zip(arrays, self.kinds, strict=True)))

    def batch(self, *names: str) -> Iterator[pa.RecordBatch]:
        """What was held as a batch of columns bucket and ``names``; nothing if that is empty."""
        rows = list(self.take())
        if rows:
            bucket, *columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", *names])


def gathered(batches, kinds: tuple) -> Iterator[list[np.ndarray]]:
    """Per bucket of a partition of packed rows: its arrays, put together again.  Column 0 holds the bucket.

    An array that no row of the bucket has (nulls) is empty.
    """
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(1 + len(kinds))), strict=True):
            held.setdefault(bucket, []).append(row)
    for b in list(held):
        rows = held.pop(b)
        yield [np.frombuffer(b"".join(y for y in x if y is not None), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
