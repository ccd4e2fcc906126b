"""Words of many texts as arrays, minimal perfect hashes, and count arrays that tasks fill and a tree sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The lowest k bytes of a little-endian 64-bit value.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_set(*but: int) -> np.ndarray:
    """Which byte values lie in a word: all but the given ones."""
    out = np.ones(256, bool)
    out[list(but)] = False
    return out


class Texts:
    """The words of the texts in a column, A-Z lower-cased: byte ranges, rows and a 64-bit hash of each.

    Hashes are made for stretches of about most bytes, cut where no word is, so that
    working memory doesn't follow the length of a text.
    """

    def __init__(self, column: pa.Array, word_bytes: np.ndarray, most: int = 1 << 20):
        data, self.offsets = common.text_buffers(column)
        self.low = np.empty(len(data) + 8, np.uint8)
        self.low[len(data) :] = 0
        np.take(common.LOWER, data, out=self.low[: len(data)])
        found: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        at = 0
        while at < len(data):
            to = self._cut(at + most, len(data), word_bytes)
            own = self.offsets[np.searchsorted(self.offsets, at, side="right") : np.searchsorted(self.offsets, to)] - at
            piece = self.low[at:to]
            start, end, _ = common.words(piece, np.concatenate([[0], own, [to - at]]), word_bytes)
            h = common.span_hash(common.prefix_hash(common.BYTE_VALUES[piece]), start, end)
            found.append((start + at, end + at, h))
            at = to
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1

    def _cut(self, at: int, n: int, word_bytes: np.ndarray) -> int:
        """The first place from at on where a text begins or a byte lies in no word."""
        if at >= n:
            return n
        limit, step = int(self.offsets[np.searchsorted(self.offsets, at)]), 1 << 12
        while at < limit:
            free = np.flatnonzero(~word_bytes[self.low[at : min(at + step, limit)]])
            if len(free):
                return at + int(free[0])
            at, step = at + step, step * 2
        return limit

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def eights(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one value; padded ends in eight spare bytes."""
    return np.ndarray((max(0, len(padded) - 7),), np.dtype("<u8"), np.ascontiguousarray(padded), 0, (1,))


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether each range of a holds the bytes of the range of b beside it; both arrays end in eight spare bytes."""
    size = a_end - a_start
    same = size == b_end - b_start
    av, bv, at, live = eights(a), eights(b), 0, np.flatnonzero(same)
    while len(live):
        rest = np.minimum(size[live] - at, 8)
        equal = ((av[a_start[live] + at] ^ bv[b_start[live] + at]) & LOW_BYTES[np.maximum(rest, 0)]) == 0
        same[live[~equal]] = False
        at += 8
        live = live[equal & (size[live] > at)]
    return same


def distinct_words(texts: Texts, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a token of each distinct word, the number of each token's word). Equal hashes count as one word only if the bytes are equal.

    more: values by token that keep words apart, such as languages; they are mixed into the hash.
    """
    h = texts.hash if more is None else keyed(texts.hash, more)
    inverse, found = pd.factorize(h)
    first = np.empty(len(found), np.int64)
    first[inverse[::-1]] = np.arange(len(h) - 1, -1, -1)
    same = same_bytes(texts.low, texts.start, texts.end, texts.low, texts.start[first[inverse]], texts.end[first[inverse]])
    if more is not None:
        same &= more == more[first[inverse]]
    if not same.all():  # two words with one hash
        known: dict = {}
        for i in np.flatnonzero(~same).tolist():
            key = (texts.word(i), None if more is None else int(more[i]))
            if key not in known:
                known[key] = len(first)
                first = np.append(first, i)
            inverse[i] = known[key]
    return first, inverse


def keyed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    return h ^ common.mix(more.astype(np.int64).view(np.uint64) + np.uint64(0x51ED270B))


def packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words one after another, with eight spare bytes, and their offsets."""
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    return np.frombuffer(b"".join(words) + bytes(8), np.uint8), offsets


class Slots:
    """A minimal perfect hash: a number from 0 to n - 1 for each of n distinct 64-bit keys.

    Level by level, keys take the bits that no other key of the level asks for, and the rest
    go on to the next level; a key's slot is the number of bits set before its own. What isn't
    among the keys gets some slot, or none; callers compare with the key that they keep there.
    """

    def __init__(self, keys: np.ndarray):
        self.bits, self.sizes = [], []
        left, level = keys, 0
        while len(left):
            size = max(64, -(-len(left) * 5 // 4 // 64) * 64)
            at = self._places(left, level, size)
            once = np.bincount(at, minlength=size) == 1
            self.bits.append(np.packbits(once, bitorder="little").view(np.uint64))
            self.sizes.append(size)
            left, level = left[~once[at]], level + 1
            if level > 200:
                raise ValueError("keys must be distinct")
        self.bits = np.concatenate(self.bits) if self.bits else np.zeros(1, np.uint64)
        self._count()

    @classmethod
    def of(cls, bits: np.ndarray, sizes: list[int]) -> Slots:
        """A hash again from its bits and the sizes of its levels."""
        out = object.__new__(cls)
        out.bits, out.sizes = bits, sizes
        out._count()
        return out

    def _count(self) -> None:
        self.before = np.zeros(len(self.bits) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.bits), out=self.before[1:])

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = common.mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of those that aren't known."""
        out = np.full(len(keys), -1, np.int64)
        live, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._places(keys[live], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[live[hit]] = self.before[at[hit] >> 6] + below
            live, base = live[~hit], base + size
            if not len(live):
                break
        return out


#: Cells of a count array that travel as one row, and arrays that one task sums.
CHUNK, FAN = 1 << 16, 64
PART = "chunk int, part int, at binary, n binary"


def array_rows(counts: np.ndarray, most: int | None = None):
    """A task's count array as rows of PART: cells that aren't 0, by chunk; at: their places. most: counts stop there."""
    part = TaskContext.get().partitionId()
    for chunk in range(-(-len(counts) // CHUNK)):
        cells = counts[chunk * CHUNK : (chunk + 1) * CHUNK]
        at = np.flatnonzero(cells)
        if len(at):
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "part": part, **_cells(at, cells[at], most)}], schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("n", pa.binary())])


def _cells(at: np.ndarray, n: np.ndarray, most: int | None) -> dict:
    n = n.astype("<i8") if most is None else np.minimum(n, most).astype("<u2")
    return {"at": at.astype("<u2").tobytes(), "n": n.tobytes()}


def cells_of(row: dict, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["at"], "<u2").astype(np.int64), np.frombuffer(row["n"], "<i8" if most is None else "<u2").astype(np.int64)


def tree_sum(parts: DataFrame, tasks: int, most: int | None = None) -> DataFrame:
    """Rows of PART summed by chunk, FAN arrays at a time, level by level; tasks: how many tasks made them. One row a chunk, part 0."""

    def add(key, table):
        total = np.zeros(CHUNK, np.int64)
        for row in table.select(["at", "n"]).to_pylist():
            at, n = cells_of(row, most)
            total[at] += n
        at = np.flatnonzero(total)
        return pa.Table.from_pylist([{"chunk": key[0].as_py(), "part": key[1].as_py(), **_cells(at, total[at], most)}], schema=_schema())

    while True:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("chunk", "part").applyInArrow(add, PART)
        if tasks <= 1:
            return parts


def summed(df: DataFrame, run, n: int) -> np.ndarray:
    """The sums of the n whole numbers that run(batches) gives in each task."""
    rows = df.mapInArrow(lambda batches: array_rows(run(batches)), PART)
    out = np.zeros(-(-n // CHUNK) * CHUNK, np.int64)
    for row in tree_sum(rows, df.rdd.getNumPartitions()).select("chunk", "at", "n").toLocalIterator():
        at, own = cells_of(row.asDict())
        out[row["chunk"] * CHUNK + at] = own
    return out[:n]
