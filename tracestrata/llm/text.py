"""Words: as expressions for the native operators, as arrays inside Arrow tasks for the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words, and the letters that are lower-cased.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# An Arrow batch is worked on in slices of about this much text, and letters are hashed
# in pieces, each of which takes some forty times its size.
SLICE_BYTES = 1 << 20
PIECE = 1 << 18


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column, separators: str = BLANKS) -> Column:
    """The maximal runs without separators, in order; none of null."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    return F.filter(parts, lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, stream: int = 0, first: int = 0) -> np.ndarray:
    """`n` fixed odd 64-bit numbers, from the `first` on; they do not depend on `n`."""
    steps = np.arange(first + 1, first + n + 1, dtype=np.uint64) + np.uint64(stream << 40)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `limit` bytes, one row at least."""
    _, offsets = _bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty), and where each begins and the last ends."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """All words of a column of texts, as arrays.

    data    the bytes, A-Z lower-cased on request
    start, stop   byte positions of each word
    doc     row of each word
    hash    64-bit hash of each word
    count   words of each row; `first` where its words begin
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = _bytes(column)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        after = np.ones(len(data), bool)
        after[1:] = ~inside[:-1]
        before = np.ones(len(data), bool)
        before[:-1] = ~inside[1:]
        self.data = data
        self.start = np.flatnonzero(inside & (after | begins[:-1]))
        self.stop = np.flatnonzero(inside & (before | begins[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(column)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.hash = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        size = self.stop - self.start
        ends = np.cumsum(size)
        letters = self.data[inside]
        sums = np.zeros(len(size), np.uint64)
        first, at = 0, 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(ends, at + PIECE, "right")))
            end = int(ends[last - 1])
            if end - at > PIECE:  # one long word
                sums[first] = self._long(letters[at:end])
            else:
                own = size[first:last]
                begin = np.cumsum(own) - own
                place = np.arange(end - at) - np.repeat(begin, own)
                values = letters[at:end].astype(np.uint64) + np.uint64(1)
                sums[first:last] = np.add.reduceat(values * seeds(int(own.max()))[place], begin)
            first, at = last, end
        return mix(sums ^ size.astype(np.uint64))

    @staticmethod
    def _long(letters: np.ndarray) -> np.uint64:
        total = np.uint64(0)
        for at in range(0, len(letters), PIECE):
            values = letters[at : at + PIECE].astype(np.uint64) + np.uint64(1)
            total += (values * seeds(len(values), first=at)).sum(dtype=np.uint64)
        return total

    def grams(self, size: int) -> np.ndarray:
        """Hash of the `size` words from each word on, across row ends as well."""
        n = max(0, len(self.hash) - size + 1)
        total = np.zeros(n, np.uint64)
        for j, seed in enumerate(seeds(size, stream=size)):
            total += self.hash[j : j + n] * seed
        return mix(total)

    def whole(self, size: int) -> np.ndarray:
        """For each word, whether the `size` words from it on are of one row."""
        n = max(0, len(self.doc) - size + 1)
        return self.doc[:n] == self.doc[size - 1 :][:n]
