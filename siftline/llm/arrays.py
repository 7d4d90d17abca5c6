"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on Arrow string arrays and numpy vectors: a batch of
documents becomes one byte vector, words become start/end offsets into it, and
hashes come from tabulation hashing. No per-word Python objects are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are held as numpy vectors at a time; a longer document is taken alone.
CHUNK_BYTES = 1 << 21

_CLASS = np.zeros(256, np.uint8)
for _b in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _CLASS[_b] = _b
_CLASS[128:] = np.arange(128, 256)
_MARKED = _CLASS.copy()
for _b in b"#$%&*+/<=>@[]^_`{|}~\\":
    _MARKED[_b] = _b
_SPAN = 64
_TABLE = np.random.Generator(np.random.PCG64(20240131)).integers(0, 2**64, size=(256, _SPAN), dtype=U64)
_TABLE[0] = 0
_TABLE = _TABLE.ravel()


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 finaliser over a vector."""
    z = h + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def as_strings(column: pa.Array) -> pa.Array:
    """A flat array of strings without nulls; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the whole array and the n+1 offsets of its values in them."""
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and at most ``rows`` rows each; whole documents, however long."""
    _, off = byte_view(column)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + rows, len(column))
        yield start, end
        start = end


class Words:
    """Words of a slice of documents: maximal runs of letters and digits, lower-cased.

    ``doc`` is the row of each word, ``start``/``end`` its byte range in ``data``,
    ``hash`` its 64-bit hash, ``first`` the index of each row's first word (n+1 values).
    With ``symbols``, characters beyond ordinary punctuation count as letters.
    """

    def __init__(self, column: pa.Array, symbols: bool = False):
        lowered = pc.utf8_lower(as_strings(column))
        self.data, self.off = byte_view(lowered)
        cls = (_MARKED if symbols else _CLASS)[self.data]
        is_word = cls != 0
        opens = is_word.copy()
        opens[1:] &= ~is_word[:-1]
        heads = self.off[:-1][self.off[:-1] < self.off[1:]]
        opens[heads] = is_word[heads]
        self.start = np.flatnonzero(opens)
        closes = is_word.copy()
        closes[:-1] &= ~is_word[1:]
        tails = self.off[1:][self.off[:-1] < self.off[1:]] - 1
        closes[tails] = is_word[tails]
        self.end = np.flatnonzero(closes) + 1
        n = len(self.start)
        if n:
            step = np.diff(np.append(self.start, len(cls)))
            begin = self.start[0]
            at = np.arange(begin, len(cls)) - np.repeat(self.start, step)
            cell = cls[begin:].astype(np.int32) * _SPAN + (at & (_SPAN - 1))
            total = np.add.reduceat(_TABLE[cell], self.start - begin)
            self.hash = mix(total + (self.end - self.start).astype(U64))
        else:
            self.hash = np.zeros(0, U64)
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    @staticmethod
    def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes and offsets of the texts as they are, not lower-cased."""
        return byte_view(as_strings(column))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every k-gram that lies in one document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        total = np.zeros(n, U64)
        for j in range(k):
            total = total * U64(0x9E3779B97F4A7C15) + self.hash[j : j + n]
        inside = self.doc[:n] == self.doc[k - 1 :]
        return np.flatnonzero(inside), mix(total[inside])


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 bits as int64, for Spark's LongType."""
    return h.view(np.int64)


def grouped(batches, key: int = 0) -> Iterator[pa.RecordBatch]:
    """One batch for each run of equal values in column ``key``; runs may span input batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column(key)[0] != batch.column(key)[a]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
