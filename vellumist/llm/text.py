"""Whole Arrow text columns as numpy arrays: words, hashes and slices bounded by bytes.

Words are maximal runs of bytes other than space and \\x09-\\x0D. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LONG = 1024  # words beyond so many bytes are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(30))
    x *= _C2
    x ^= x >> np.uint64(27)
    x *= _C3
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together, and the offsets of each (one more than there are texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or pa.types.is_null(column.type):
        column = pc.fill_null(column.cast(pa.string()), "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Gives freed memory back to the system: a Python worker lives on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library's
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """Consecutive parts of a batch with about ``limit`` bytes of text each (one longer text stays whole)."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    trim()


class Words:
    """The words of all texts of a column: starts, lens, and first[i]:first[i+1] as those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = np.zeros(len(data) + 16, np.uint8)
        self.data[: len(data)] = _LOWER[data] if lower else data
        self.offsets, n = offsets, len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = _IS_WORD[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:n] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]  # a word ends with its text
        begin[edges] |= inside[edges]
        end[edges - 1] |= inside[edges - 1]
        self.starts = np.flatnonzero(begin)
        self.lens = np.flatnonzero(end) + 1 - self.starts
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_pieces(self.data, self.starts, self.lens, seed)

    def get(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lens[i]].tobytes()


def hash_pieces(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each piece; ``data`` has at least 8 bytes of padding behind the last piece."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = (lens.astype(np.uint64) + np.uint64(seed)) * _C1
    h = mix(h ^ (eight[starts] & _TAIL[np.minimum(lens, 8)]))
    left, k = np.flatnonzero((lens > 8) & (lens <= _LONG)), 8
    while len(left):
        part = eight[starts[left] + k] & _TAIL[np.minimum(lens[left] - k, 8)]
        h[left] = mix((h[left] ^ part) + _C1)
        k += 8
        left = left[lens[left] > k]
    for i in np.flatnonzero(lens > _LONG):
        piece = data[starts[i] : starts[i] + lens[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(piece, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h


def distinct(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word windows of each text, sorted within the text, and where each text's begin.

    A text of 1 to ``width - 1`` words has its whole sequence as one window; without words it has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][owner]
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    value = np.repeat(np.minimum(n, width).astype(np.uint64), count) * _C1
    short = np.repeat(np.minimum(n, width), count)
    for k in range(width):
        value = np.where(k < short, mix((value ^ padded[at + k]) + _C1), value) if (n < width).any() else mix((value ^ padded[at + k]) + _C1)
    out = [np.sort(value[a:b]) for a, b in zip(np.cumsum(count) - count, np.cumsum(count))]
    out = [x[distinct(x)] for x in out]
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(x) for x in out], dtype=np.int64)))
