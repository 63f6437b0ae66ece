"""Whole-batch text kernels shared by the operators.

A slice of an Arrow column is handled as one byte buffer: word boundaries,
word hashes and window hashes of all its texts come from a few numpy passes,
so the cost per word is tens of nanoseconds and no text is ever cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U64 = np.uint64
SLICE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_ODD2 = 0xD1342543DE82EF95


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def released(run):
    """``run`` (batches to batches) that gives the memory it has freed back to the machine when its task ends.

    A worker process lives on for the tasks and stages that follow; what its
    allocators keep would add up with theirs and with the executor's own.
    """
    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            give_back()
    return over


def give_back() -> None:
    for powers in (*_BYTE_POWERS, *_WORD_POWERS):
        powers.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):       # another C library than glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.forget()

    def forget(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def take(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` powers of each, however far the tables have grown."""
        if len(self.up) < n:
            size = max(n + (n >> 3), 1 << 16)
            grown = []
            for b in (self.base, self.inverse):
                a = np.full(size, b, U64)
                a[0] = 1
                grown.append(np.multiply.accumulate(a))
            if size > 2 << 20:  # one huge text: do not keep its tables
                return grown[0][:n], grown[1][:n]
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_BYTE_POWERS = (_Powers(_ODD), _Powers(_ODD2))
_BYTE_TABLES = tuple(mix(np.arange(1, 257, dtype=U64) * U64(k)) for k in (_ODD, _ODD2))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is true for the bytes inside the inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


#: words of op5: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased (UTF-8 bytes)
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: words of op6: [^\x20\x09-\x0D]+
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def lowered_table(table: np.ndarray) -> np.ndarray:
    table = table.copy()
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


@dataclass
class Texts:
    """The texts of a slice: one buffer and n + 1 offsets; nulls are empty."""

    data: np.ndarray
    offsets: np.ndarray
    column: pa.Array

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column: pa.Array) -> Texts:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(d[o[0]:o[-1]], o - o[0], column)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes; one longer text stands alone."""
    n = batch.num_rows
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


@dataclass
class Words:
    """Words of a slice in text order. ``first`` has n_texts + 1 word indexes."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    hash2: np.ndarray | None

    def doc(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0,
              lower: bool = False) -> np.ndarray:
    table = lowered_table(_BYTE_TABLES[which]) if lower else _BYTE_TABLES[which]
    up, down = _BYTE_POWERS[which].take(len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(table[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def words_of(texts: Texts, is_word: np.ndarray, lower: bool = False, double: bool = False) -> Words:
    data, offsets = texts.data, texts.offsets
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    ends[cuts] = inside[cuts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets, "left")
    return Words(start, end, first, span_hash(data, start, end, 0, lower),
                 span_hash(data, start, end, 1, lower) if double else None)


_WORD_POWERS = (_Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB))


def window_hash(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every k consecutive entries (len - k + 1 values, or none)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    up, down = _WORD_POWERS[which].take(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[k:] - total[:n - k + 1]) * down[:n - k + 1] + U64(k))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word indexes at which a window of k words of one text begins."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    return ranges(first[:-1], count)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .. and so on."""
    total = int(count.sum())
    skip = np.cumsum(count) - count
    return np.arange(total) + np.repeat(np.asarray(start) - skip, count)


def union_of_spans(start: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the n positions covered by spans of one length."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + length, -1)
    return np.cumsum(delta)[:n] > 0
