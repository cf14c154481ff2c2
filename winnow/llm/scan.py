"""Arrays of words, shingles and their hashes for blocks of texts, and the few table helpers the operators share.

Texts reach Python as Arrow batches.  A block of about 1 MB is treated at once:
its bytes are one numpy array, words are spans of it, and a word's hash comes
from prefix sums of a polynomial, so no step loops over words.  Hashes have 64
bits and depend only on the bytes (A-Z count as a-z), never on the process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.session import scratch

BLOCK_BYTES = 1 << 20
#: the C library's way to give free memory back, where it has one
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_LOWER = np.arange(256, dtype=np.uint8)
BYTE_LOWER[65:91] += 32
BYTE_VALUES = mix((BYTE_LOWER.astype(np.uint64) + np.uint64(1)) * _ODD)
#: what separates words: blank, tab, line feed, vertical tab, form feed, carriage return
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: what separates runs of letters: all of ASCII but its letters
NON_LETTERS = np.ones(256, dtype=bool)
NON_LETTERS[128:] = False
NON_LETTERS[65:91] = False
NON_LETTERS[97:123] = False

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Spans:
    """64-bit hashes of any spans of ``values``, the 64-bit codes of the symbols."""

    def __init__(self, values: np.ndarray):
        up, self.down = _power_tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(values).hashes(starts, ends)


class Lookup:
    """Place of a hash among distinct hashes, -1 for others: a table with open addressing, many at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = left[free]
            rest = self.slots[at] != left
            left, at = left[rest], (at[rest] + 1) & self.mask

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        left, at = np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(left):
            found = self.slots[at]
            some = found >= 0
            left, at, found = left[some], at[some], found[some]
            hit = self.keys[found] == hashes[left]
            out[left[hit]] = found[hit]
            left, at = left[~hit], (at[~hit] + 1) & self.mask
        return out


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, fold: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows of a string column; a null row is an empty one.

    ``fold`` lowers the letters of every script, each code point to one.
    """
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        part = column.slice(first, last - first).cast(pa.large_string()).fill_null("")
        part = pc.utf8_lower(part) if fold else part
        rows = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        raw = part.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
        yield first, data[rows[0] : rows[-1]], rows - rows[0]
        first = last


def release() -> None:
    """Gives the memory of past batches back; a worker lives on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of some 4 MB: every task holds a few of them, in the JVM and in its worker.  Safe to call again."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


class Words:
    """Words of a block: starts, ends (byte positions), row of each, ``bounds[r]:bounds[r+1]`` the words of row r."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~separators[data]
        at = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        at[cuts] = inside[1:-1][cuts]
        ends[cuts - 1] = inside[1:-1][cuts - 1]
        self.data, self.rows = data, len(offsets) - 1
        self.starts = np.flatnonzero(at)
        self.ends = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(BYTE_VALUES[self.data], self.starts, self.ends)


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n consecutive words of a row, number per row).

    A row with 1 to n-1 words has, if ``short``, one gram of all its words; a row
    without words has none.
    """
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(counts), dtype=np.int64)
    starts = np.cumsum(counts) - counts
    total = len(hashes)
    grams = np.zeros(total, dtype=np.uint64)
    factor = np.uint64(1)
    for k in range(min(n, total)):
        factor = np.uint64((int(factor) * _BASE) & (2**64 - 1))
        grams[: total - k] += hashes[k:] * factor
    grams = mix(grams + np.uint64((n * int(_ODD)) & (2**64 - 1)))
    left = np.repeat(starts + counts, counts) - np.arange(total)
    keep = left >= n
    sizes = np.maximum(counts - n + 1, 0)
    if short:
        rows = np.flatnonzero((counts > 0) & (counts < n))
        for r in rows:
            value = 0
            for h in hashes[starts[r] : starts[r] + counts[r]]:
                value = (value * _BASE + int(h)) & (2**64 - 1)
            grams[starts[r]] = mix(np.array([(value + int(counts[r])) & (2**64 - 1)], dtype=np.uint64))[0]
            keep[starts[r]] = True
        sizes[rows] = 1
    return grams[keep], sizes


def unique_per_row(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row, and their numbers."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], np.bincount(rows[keep], minlength=len(sizes))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column, parts: int):
    """crc32 of the number as decimal text, modulo ``parts``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def fresh(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_size(spark: SparkSession, size: int, per_task: int) -> int:
    """Tasks for so many bytes or rows: never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_task))
