"""Benchmark decontamination: containment of items' shingles in whole documents, without misses.

An item is the set of its word shingles.  It is found if a document holds
``CONTAINED`` of them anywhere, so text put between its parts does not hide it.
Of an item's n shingles of which k must be held, any n - k + 1 include one that
is held; its n - k + 1 shingles that the fewest other items have propose it.
Every shingle of a document is looked up; a proposed item's distinct shingles
are then counted over all shingles of the row.

Items go to the tasks in blocks of at most ``ITEM_BLOCK`` items, so what is
broadcast is bounded; a larger benchmark takes more passes over the documents,
and nothing is shuffled but the found pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.scan import Lookup, Words, blocks, mix, ngrams, release

SHINGLE = 5
CONTAINED = 0.8
#: items per pass; some 50 shingles each make about 60 MB
ITEM_BLOCK = 20_000
#: shingles of proposed items counted at once
COUNTED = 1 << 20


@dataclass
class Index:
    """One block of items."""

    ids: list
    lookup: Lookup  # distinct shingles of all items of five words and more; a shingle's number is its place
    bounds: np.ndarray  # shingles[bounds[i]:bounds[i + 1]] are the numbers of item i's
    shingles: np.ndarray
    proposed: np.ndarray  # proposes[proposed[s]:proposed[s + 1]] are the items that shingle s proposes
    proposes: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # words of items under five words -> sorted hashes, item of each


def build(ids: list, texts: list[str | None], contained: float = CONTAINED) -> Index:
    column = pa.array([t or "" for t in texts], pa.string())
    sets: list[np.ndarray] = []
    short: dict[int, list[tuple[int, int]]] = {}
    for _, data, offsets in blocks(column, fold=True):
        words = Words(data, offsets)
        grams, sizes = ngrams(words.hashes(), words.counts, SHINGLE)
        for x, n in zip(np.split(grams, np.cumsum(sizes)[:-1]), words.counts.tolist()):
            if 0 < n < SHINGLE:
                short.setdefault(n, []).append((int(x[0]), len(sets)))
            sets.append(np.unique(x) if n >= SHINGLE else x[:0])
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    known, shingles, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    item = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((shingles, times[shingles], item))
    needed = np.array([max(1, math.ceil(contained * n - 1e-9)) for n in sizes.tolist()], dtype=np.int64)
    rare = order[np.arange(len(order)) - bounds[item] <= (sizes - needed)[item]]
    rare = rare[np.argsort(shingles[rare], kind="stable")]
    proposed = np.searchsorted(shingles[rare], np.arange(len(known) + 1))
    keyed = {}
    for n, members in short.items():
        members.sort()
        keyed[n] = np.array([h for h, _ in members], dtype=np.uint64), np.array([i for _, i in members])
    return Index(ids, Lookup(known), bounds, shingles, proposed, item[rare], keyed)


def _spread(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the ranges, place) for every place in ranges of n from starts."""
    at = np.repeat(np.arange(len(n)), n)
    return at, starts[at] + np.arange(len(at)) - (np.cumsum(n) - n)[at]


def _pairs(sorted_values: np.ndarray, items: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in seen, item) for every equal value."""
    lo = np.searchsorted(sorted_values, seen, side="left")
    at, place = _spread(lo, np.searchsorted(sorted_values, seen, side="right") - lo)
    return at, items[place]


def search(index: Index, data: np.ndarray, offsets: np.ndarray, contained: float = CONTAINED) -> list[tuple[int, int, float]]:
    """(row, item, containment) of every item found in a block of texts; ``contained`` as the index was built with."""
    words = Words(data, offsets)
    hashes = words.hashes()
    grams, sizes = ngrams(hashes, words.counts, SHINGLE, short=False)
    found: dict[tuple[int, int], float] = {}
    for n, (values, items) in index.short.items():
        runs, per_row = _runs(hashes, words.counts, n)
        at, item = _pairs(values, items, runs)
        rows = np.repeat(np.arange(words.rows), per_row)[at]
        found.update({(int(r), int(i)): 1.0 for r, i in zip(rows, item)})
    number = index.lookup(grams)
    hit = np.flatnonzero(number >= 0)
    n_known, n_items = len(index.proposed) - 1, len(index.ids)
    if len(hit):
        # every known shingle of a row once
        held = np.unique(np.repeat(np.arange(words.rows), sizes)[hit] * n_known + number[hit])
        row, shingle = np.divmod(held, n_known)
        at, place = _spread(index.proposed[shingle], index.proposed[shingle + 1] - index.proposed[shingle])
        row, item = np.divmod(np.unique(row[at] * n_items + index.proposes[place]), n_items)
        n = index.bounds[item + 1] - index.bounds[item]
        total, first = np.cumsum(n), 0
        while first < len(item):
            last = max(first + 1, int(np.searchsorted(total, total[first] - n[first] + COUNTED, side="right")))
            at, place = _spread(index.bounds[item[first:last]], n[first:last])
            key = row[first:last][at] * n_known + index.shingles[place]
            there = held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key
            share = np.bincount(at, weights=there, minlength=last - first) / n[first:last]
            for k in np.flatnonzero(share >= contained).tolist():
                found[int(row[first + k]), int(item[first + k])] = float(share[k])
            first = last
    return [(r, i, c) for (r, i), c in found.items()]


def _runs(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words, as an item of n words has them."""
    value, sizes = np.zeros(max(len(hashes) - n + 1, 0), dtype=np.uint64), np.maximum(counts - n + 1, 0)
    base = np.uint64(0xD1342543DE82EF95)
    for k in range(n):
        value = value * base + hashes[k : k + len(value)]
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))
    return mix(value + np.uint64(n))[left[: len(value)] >= n], sizes


def item_blocks(benchmark: DataFrame, contained: float) -> Iterator[Index]:
    """Indexes of at most ``ITEM_BLOCK`` items each; only one block is on the driver at a time."""
    n = benchmark.count()
    parts = max(1, -(-2 * n // ITEM_BLOCK))
    for k in range(parts):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).select("item_id", "text").distinct().collect()
        if rows:
            yield build([r["item_id"] for r in rows], [r["text"] for r in rows], contained)


def find(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, containment of every item of which a document holds at least ``contained`` of the shingles near each other.

    Null, empty and wordless texts hold nothing and are held by nothing; an item
    of one to four words is found as that run of words.  Repeated rows of a
    document give one row each, repeated equal items one; ids may be null.
    Containment is over the whole document.
    """
    spark = docs.sparkSession
    id_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    out = spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, containment double")
    for index in item_blocks(benchmark, contained):
        out = out.unionByName(docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(_finder(spark, index, item_type, contained), out.schema))
    return out


def _finder(spark, index: Index, item_type: str, contained: float):
    shared = spark.sparkContext.broadcast(index)
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            hits = [(first + r, known.ids[i], c) for first, data, offsets in blocks(batch.column(1), fold=True) for r, i, c in search(known, data, offsets, contained)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], kind), pa.array([h[2] for h in hits], pa.float64())], ["doc_id", "item_id", "containment"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The documents that hold no item, all columns kept; only the text goes to Python and one bit comes back.

    Null, empty and wordless texts hold nothing and stay; so does all, if the
    benchmark is empty.  Repeated rows stay or go together; a text of any length
    is searched whole.
    """
    for index in item_blocks(benchmark, contained):
        docs = docs.where(_holds_none(docs.sparkSession.sparkContext.broadcast(index), contained)(F.col("text")))
    return docs


def _holds_none(shared, contained: float):
    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        keep = np.ones(len(texts), dtype=bool)
        for first, data, offsets in blocks(texts, fold=True):
            keep[[first + r for r, _, _ in search(shared.value, data, offsets, contained)]] = False
        release()
        return pa.array(keep)

    return kept
