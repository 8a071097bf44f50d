"""Vectorised text kernels over Arrow batches.

A batch is cut into slices of a few MB of text (one row at least), so that memory stays bounded whatever the
number of rows in a batch. Within a slice words, their hashes and the hashes of word windows come from whole-array
numpy operations: a word's hash is a sum of one random value for each byte and its place in the word, and the hash of a
window is mixed from the hashes of its halves, so that no two texts collide by their structure.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = (1 << 20) - 4096


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
    _LIBC.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
except (OSError, AttributeError):  # another C library
    _LIBC = None
pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """Workers of Python live long beside each other: what a task has freed goes back to the machine."""
    if _LIBC:
        _LIBC.malloc_trim(0)

#: Bytes that separate words: space and 0x09 to 0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_R2 = np.uint64(0xD6E8FEB86659FD93)
_R3 = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: A value for each byte at each of a word's first places; beyond, mix() gives them.
PLACES = 64
_BYTES = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _R3)


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of what stands before each place, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def binary(column: pa.Array) -> pa.LargeBinaryArray:
    """A text column as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column and the offsets of its rows in them."""
    a = binary(column)
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    if not len(a) or a.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a piece has one row or at most `most` bytes in the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    trim()


class Words:
    """Words of each row of a slice: start and end in data, hashes, and where each row's words begin."""

    def __init__(self, column: pa.Array, lower: bool = False, white: np.ndarray = WHITE):
        self.data, self.offsets = buffers(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        black = ~white[self.data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = ~black[:-1]
        edge[self.offsets] = True
        self.start = np.flatnonzero(black & edge[:n])
        edge = np.ones(n + 1, bool)
        if n:
            edge[1:n] = ~black[1:]
        edge[self.offsets] = True
        self.end = np.flatnonzero(black & edge[1:]) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self._black = black
        self._hash: np.ndarray | None = None
        self._parts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def heads(self, most: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their first `most` bytes."""
        if self._parts is None:
            size = self.end - self.start
            begin = np.cumsum(size) - size
            byte = self.data[self._black]
            place = np.arange(len(byte), dtype=np.int64) - np.repeat(begin, size)
            value = _BYTES[np.minimum(place, PLACES - 1) << 8 | byte]
            far = np.flatnonzero(place >= PLACES)
            value[far] = mix((place[far] << 8 | byte[far]).astype(np.uint64) * _R3 + _R2)
            self._parts = _sums(value), begin, size
        sums, begin, size = self._parts
        size = size if most is None else np.minimum(size, most)
        return mix(sums[begin + size] - sums[begin] + size.astype(np.uint64) * _R2)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.heads()
        return self._hash

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def rolling(self, k: int, seed: int = 0) -> np.ndarray:
        """Hashes of k words from each word on, without regard to rows; it has a value for every start of windows(k)."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.uint64)
        x = mix(self.hash + np.uint64((seed + 1) * int(_R3) % (1 << 64)))
        out, have, span = None, 0, 1
        while span <= k:
            if k & span:
                out = x if out is None else mix(out[: n - have - span + 1] * _R2 + x[have : n - span + 1] + np.uint64(span))
                have += span
            if 2 * span <= k:
                x = mix(x[: n - 2 * span + 1] * _R3 + x[span:])
            span *= 2
        return out

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs [start, end) of words, one after the other and disjoint."""
        size = end - start
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        sums = _sums(mix(self.hash[np.repeat(start, size) + place] + mix((place + 1).astype(np.uint64) * _R3)))
        return mix(sums[begin + size] - sums[begin] + size.astype(np.uint64) * _R2)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start of each window of k words of one row, and its row."""
        n = np.maximum(self.counts - k + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        begin = np.cumsum(n) - n
        return np.arange(int(n.sum())) - begin[row] + self.first[:-1][row], row

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values of a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return start, np.diff(np.append(start, len(keys)))


def crc_of_id(doc_id: np.ndarray) -> np.ndarray:
    """CRC-32 of the decimal text of each id."""
    import zlib

    return np.fromiter((zlib.crc32(str(int(x)).encode()) for x in doc_id), np.int64, len(doc_id))
