"""Document fingerprints by locally consistent parsing.

A text is parsed level by level.  Runs of one symbol become one symbol; then
deterministic coin tossing gives every symbol a label: twice the lowest bit in
which it differs from its left neighbour, plus that bit.  Tossing the labels
again, four times in all, leaves six of them, and equal neighbours never arise.
A phrase begins at every local maximum, and its name, a hash of its symbols, is
a symbol of the next level, until one symbol names the whole text.  A phrase
depends on its symbols and a few to its left and right, so a substring has the
same phrases inside wherever it lies.

The fingerprint samples the names of all phrases of at least ``LEAST`` code
points: the smallest name of each of ``BINS`` classes, 16 bits of it.  Likeness
is the share of agreeing classes, which estimates the Jaccard likeness of the
two texts' phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.scan import by_size, mix, span_hashes

BINS = 64
LEAST = 8
TOSSES = 4
#: code points parsed at once
BLOCK_CHARS = 1 << 20
#: bytes of text in one range of documents
RANGE_BYTES = 64 << 20
_EMPTY = np.iinfo(np.uint64).max
_RUN = np.uint64(0xA24BAED4963EE407)


def _toss(symbols: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Twice the lowest bit that differs from the left neighbour, plus its value; a row's first symbol differs in the lowest."""
    differ = np.empty_like(symbols)
    differ[1:] = symbols[1:] ^ symbols[:-1]
    differ[head] = 1
    lowest = differ & (~differ + symbols.dtype.type(1))
    place = np.frexp(lowest.astype(np.float64))[1] - 1
    bit = (symbols & lowest) != 0
    return (2 * place + bit).astype(np.uint8)


def _heads(rows: np.ndarray) -> np.ndarray:
    head = np.ones(len(rows), dtype=bool)
    head[1:] = rows[1:] != rows[:-1]
    return head


def parse(symbols: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Per level: names, rows, lengths in code points of the phrases, and whether each row now has one.

    ``symbols`` are 64-bit codes, ``rows`` the text of each (ascending).
    """
    names, lengths = mix(symbols.astype(np.uint64) + np.uint64(1)), np.ones(len(symbols), dtype=np.int64)
    while len(names):
        head = _heads(rows)
        start = head.copy()
        start[1:] |= names[1:] != names[:-1]
        first = np.flatnonzero(start)
        times = np.diff(np.append(first, len(names)))
        lengths = np.add.reduceat(lengths, first)
        names, rows, head = names[first], rows[first], head[first]
        repeated = times > 1
        names = np.where(repeated, mix(names + times.astype(np.uint64) * _RUN), names)
        labels = _toss(names, head)
        for _ in range(TOSSES - 1):
            labels = _toss(labels, head)
        # a local maximum begins a phrase; so does a row
        left = np.empty_like(head)
        left[1:] = labels[1:] > labels[:-1]
        right = np.empty_like(head)
        right[:-1] = labels[:-1] > labels[1:]
        right[-1] = False
        start = left & right
        start[1:][head[:-1]] = False  # the symbol after a row's first one
        start[:-1][head[1:]] = False  # a row's last
        start |= head
        first = np.flatnonzero(start)
        ends = np.append(first[1:], len(names))
        named = span_hashes(names, first, ends)
        lengths = np.add.reduceat(lengths, first)
        rows = rows[first]
        names = named
        done = bool(_heads(rows).all())
        yield names, rows, lengths, done
        if done:
            return
        more = np.bincount(rows) > 1  # texts that have their name leave
        stay = more[rows]
        names, rows, lengths = names[stay], rows[stay], lengths[stay]


def sketch(texts: list[str]) -> np.ndarray:
    """A row of ``BINS`` 16-bit values for each text; 65535 is an empty class."""
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    smallest = np.full(len(texts) * BINS, _EMPTY, dtype=np.uint64)
    for names, rows, lengths, _ in parse(symbols, np.repeat(np.arange(len(texts)), counts)):
        whole = lengths == counts[rows]
        keep = (lengths >= LEAST) | whole
        spread = mix(names[keep])
        np.minimum.at(smallest, rows[keep] * BINS + (spread & np.uint64(BINS - 1)).astype(np.int64), spread)
    values = ((smallest >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)
    values[(smallest != _EMPTY) & (values == 0xFFFF)] = 0xFFFE
    return values.reshape(len(texts), BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the classes filled on either side that agree, row by row; two empty texts are alike."""
    filled = (a != 0xFFFF) | (b != 0xFFFF)
    n = filled.sum(axis=1)
    return np.where(n > 0, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1), 1.0)


def to_text(values: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in values]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text; a null text is an empty one, whose classes are all empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [x for part in _parts(texts) for x in to_text(sketch(part))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many of the next text's first code points."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and the likeness to the next document's.

    Texts move once: to ranges of ascending doc_id, whose bounds are ids of the
    table.  A range also gets the first document of the one after it (the last
    range that of the whole table), so each task sees every document with its
    next one.  Null ids come first, equal ids are ordered by text; a null text
    is empty; a lone document follows itself; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_at"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = by_size(docs.sparkSession, size, RANGE_BYTES)
    found = keyed.agg(F.min("_at"), F.percentile_approx("_at", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()
    bounds = np.unique(np.array([found[0] or 0, *(found[1] or [])][: parts if parts > 1 else 1], dtype=np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            place = np.maximum(np.searchsorted(bounds, at, side="right") - 1, 0).astype(np.int32)
            head = np.flatnonzero(bounds[place] == at)
            rows = np.concatenate([np.arange(len(at)), head])
            before = (place[head] - 1) % len(bounds)
            tail = np.arange(len(rows)) >= len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([place, before]).astype(np.int32)), pa.array(tail), *batch.take(pa.array(rows)).columns], ["part", "tail", "doc_id", "text", "_at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = keyed.mapInArrow(deal, f"part int, tail boolean, doc_id {kind}, text string, _at long")
    placed = dealt.repartitionById(len(bounds), "part").sortWithinPartitions("part", "tail", "_at", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of all texts but the last, which only follows."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, other = sketch(texts), sketch(changed)
        columns = [[len(t) for t in texts[:-1]], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], to_text(own[:-1]), to_text(other), likeness(own[:-1], other), likeness(own[:-1], own[1:])]
        return pa.RecordBatch.from_arrays([pa.array(ids[:-1], id_type), pa.array(columns[0], pa.int64()), *(pa.array(c) for c in columns[1:])], names)

    id_type = pa.int32() if kind == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, ended = [], [], 0, False
        for batch in batches:
            for tail, i, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if ended:
                    continue
                ended = tail
                ids.append(i)
                texts.append(text)
                size += len(text)
                if len(texts) > 1 and (ended or size >= BLOCK_CHARS):
                    yield finish(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    return placed.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
