"""Whole-batch word tables over Arrow string columns, in numpy.

A batch of texts is one byte buffer; words are runs of bytes outside
``[\\x20\\x09-\\x0D]``.  As all white space is ASCII, cutting UTF-8 bytes there is
exact.  A word's hash is a random-table polynomial over its bytes, taken as a
difference of prefix sums modulo 2**64, so that hashing costs a few array passes
per byte and never a Python call per word.  Hashes depend on the bytes alone:
they agree between executors, runs and batch layouts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 17
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []
_LIBC = ctypes.CDLL(None)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def give_back() -> None:
    """Returns freed memory to the system: workers idle next to others, in one executor's limit."""
    try:
        _LIBC.malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def keyed(x: np.ndarray, key: int) -> np.ndarray:
    """Hashes of 64-bit values under a key."""
    return mix(np.asarray(x).astype(_U) ^ _U((key * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64)))


class Texts:
    """Some whole texts of a batch: bytes, offsets of documents and of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw, self.offsets = data, offsets
        self.data = _LOWER[data] if lower else data
        n = len(data)
        word = ~_SPACE[self.data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | first[:-1]))
        self.end = np.flatnonzero(word & (~after | first[1:])) + 1
        #: Word numbers at which each document begins, and the end.
        self.bounds = np.searchsorted(self.start, offsets)
        self._sums = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        """Each word's document number within this chunk."""
        return np.repeat(np.arange(len(self)), self.n_words)

    def hash_ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        n = len(self.data)
        up, down = _powers(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, _U)
            np.cumsum(_TABLE[self.data] * up[:n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * down[start])

    def word_hashes(self) -> np.ndarray:
        return self.hash_ranges(self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Per document, the sum of a value given for each byte."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Per document, the sum of a value given for each word."""
        total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=total[1:])
        return np.diff(total[self.bounds])


def code_points(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8, hi - lo, lo), offsets - lo


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of consecutive whole rows of about ``size`` bytes."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        yield at, to, Texts(data[lo:hi], offsets[at : to + 1] - lo, lower)
        at = to
    if len(data) > size:
        give_back()


def ngrams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside documents, and the number of each window's first word."""
    if len(words) < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    out = np.zeros(len(at), _U)
    for k in range(n):
        out = (out + words[at + k]) * _U(0xD6E8FEB86659FD93 + 2 * k)
    return mix(out), at


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Held:
    """Arrays that are gathered over chunks and given on together once they have so many entries, so that the distinct of many chunks cost no larger chunk."""

    def __init__(self, most: int = 1_500_000):
        self.most, self.parts, self.n = most, [], 0

    def add(self, *arrays: np.ndarray) -> bool:
        """True if it is time to take()."""
        self.parts.append(arrays)
        self.n += len(arrays[0])
        return self.n >= self.most

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*self.parts, strict=True)] if self.parts else []
        self.parts, self.n = [], 0
        return out
