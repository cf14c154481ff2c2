"""Line dedup with two Bloom filters: only suspected repeats are shuffled.

A line's key is the line without white space at its ends, A-Z lower-cased.  Its
64-bit hash sets ``PROBES`` bits of a filter of keys seen once; a key met again
sets them in a second filter.  Partial filters are merged bit by bit: a bit set
by two parts belongs to the second filter too, so no repeat is ever missed.  A
part is a few thousand texts and travels as the sorted positions of its bits,
four bytes a key.  Keys whose bits are all in the second filter are suspects:
they alone go, as 128-bit hashes with their document, to the exact count of
documents and the choice of the one that keeps its lines.

The filter has ``BITS_PER_KEY`` bits for every key up to ``MAX_BITS``.  Beyond
(some 10^9 keys at 2 bits) more keys are suspects, in the end all of them: the
result stays the same, and what is shuffled stays below 32 bytes a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.scan import BYTE_VALUES, SPACES, Lookup, Spans, blocks, fresh, mix, staged

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
PROBES = 2
BITS_PER_KEY = 4
#: the second filter is broadcast: 64 MB at most
MAX_BITS = 1 << 29
CHUNK = 1 << 16
#: keys of one part of the filters
PART = 1 << 19
#: dropped keys that are broadcast, 24 bytes each; more are joined to their documents
DROPPED_BROADCAST = 1 << 20

_OTHER = mix(BYTE_VALUES ^ np.uint64(0xA0761D6478BD642F))


class Lines:
    """Lines of a block of texts: starts, ends (without the line feed), row of each; the stripped keys' spans and lengths."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        feeds = np.flatnonzero(data == 10)
        rows = len(offsets) - 1
        self.counts = np.diff(np.searchsorted(feeds, offsets)) + 1
        first = np.cumsum(self.counts) - self.counts
        self.row = np.repeat(np.arange(rows), self.counts)
        self.starts = np.empty(len(self.row), dtype=np.int64)
        self.ends = np.empty(len(self.row), dtype=np.int64)
        inner = np.ones(len(self.row), dtype=bool)
        inner[first] = False
        self.starts[first], self.starts[inner] = offsets[:-1], feeds + 1
        inner = np.ones(len(self.row), dtype=bool)
        inner[first + self.counts - 1] = False
        self.ends[first + self.counts - 1], self.ends[inner] = offsets[1:], feeds
        shown = np.flatnonzero(~SPACES[data])
        lo, hi = np.searchsorted(shown, self.starts), np.searchsorted(shown, self.ends)
        filled = hi > lo
        self.key_starts, self.key_ends = self.starts.copy(), self.starts.copy()
        self.key_starts[filled], self.key_ends[filled] = shown[lo[filled]], shown[hi[filled] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.chars = points[self.key_ends] - points[self.key_starts]
        self.data = data

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the keys of the given lines."""
        a, b = self.key_starts[which], self.key_ends[which]
        return tuple(Spans(values[self.data]).hashes(a, b) for values in (BYTE_VALUES, _OTHER))


def _keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id and the two hashes of the distinct long enough keys of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                lines = Lines(data, offsets)
                long = np.flatnonzero(lines.chars >= least_chars)
                h1, h2 = lines.hashes(long)
                row = lines.row[long]
                order = np.lexsort((h2, h1, row))
                row, h1, h2 = row[order], h1[order], h2[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                row, h1, h2 = row[new], h1[new], h2[new]
                ids = batch.column(0).slice(first, len(offsets) - 1).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["doc_id", "h1", "h2"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(docs)}, h1 long, h2 long")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of every hash, one row of ``PROBES`` each."""
    step = mix(hashes) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)], axis=1)


def _parts(keys: DataFrame, bits: int) -> DataFrame:
    """(chunk, once, twice): sorted positions of the bits that parts of the keys set in both filters."""

    def part(hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        distinct, times = np.unique(hashes, return_counts=True)
        once, twice = (np.unique(_positions(h, bits)) for h in (distinct, distinct[times > 1]))
        chunks = np.unique(once >> np.uint64(16))
        edges = np.append(chunks, chunks[-1:] + np.uint64(1)) << np.uint64(16)
        columns = []
        for values in (once, twice):
            at = np.searchsorted(values, edges) * 2
            raw = (values & np.uint64(CHUNK - 1)).astype(np.uint16).tobytes()
            columns.append(pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary()))
        for at in range(0, len(chunks), 256):
            yield pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int64)), *columns], ["chunk", "once", "twice"]).slice(at, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= PART:
                yield from part(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from part(np.concatenate(held))

    return keys.select("h1").mapInArrow(run, "chunk long, once binary, twice binary")


def _merged(parts: DataFrame) -> DataFrame:
    """(chunk, bits): the second filter, one row per chunk that has a bit set, from rows sorted by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(CHUNK, dtype=bool), np.zeros(CHUNK, dtype=bool)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["chunk", "bits"])

        for batch in batches:
            for chunk, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk != now:
                    if now is not None and twice.any():
                        yield out()
                    now = chunk
                    once[:], twice[:] = False, False
                a = np.frombuffer(a, dtype=np.uint16)
                twice[a[once[a]]] = True
                once[a] = True
                twice[np.frombuffer(b, dtype=np.uint16)] = True
        if now is not None and twice.any():
            yield out()

    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long, bits binary")


def _suspects(keys: DataFrame, seen: list[tuple[int, bytes]], bits: int) -> DataFrame:
    """The keys all of whose bits are in the second filter."""
    table = np.zeros(bits // 8, dtype=np.uint8)
    for chunk, raw in seen:
        table[chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8] = np.frombuffer(raw, dtype=np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            at = _positions(batch.column(1).to_numpy().view(np.uint64), bits)
            hit = (twice[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.all(axis=1)))

    return keys.mapInArrow(run, keys.schema)


def repeated_keys(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, bits_per_key: float = BITS_PER_KEY, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """((h1, h2, documents, keeper) of the repeated keys, (doc_id, h1, h2) of the suspects).

    ``documents`` counts distinct doc_ids, all null ids as one; ``keeper`` is the largest, null only where all are.
    """
    keys = staged(_keys(docs, least_chars), "line_keys")
    bits = CHUNK
    while bits < min(max_bits, keys.count() * bits_per_key):
        bits *= 2
    seen = [(r["chunk"], r["bits"]) for r in _merged(_parts(keys, bits)).collect()]
    suspects = staged(_suspects(keys, seen, bits), "suspects")
    # a key of very many documents is spread by document first, then combined before it moves
    each = suspects.distinct()
    counted = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"))
    return staged(counted.where(F.col("documents") >= least_documents), "repeated"), suspects


def _dropper(names: list[str], extra: int, find):
    """Cuts the lines that ``find`` names from the texts of the batches, the second column; adds n_lines and n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(1)):
                rows = len(offsets) - 1
                part = batch.slice(first, rows)
                lines = Lines(data, offsets)
                gone = find(part, lines)
                text = part.column(1)
                dropped = np.bincount(lines.row[gone], minlength=rows)
                changed = np.flatnonzero(dropped)
                if len(changed):
                    # a kept line takes its line feed along, but for the last one kept of its text
                    keep = np.ones(len(lines.row), dtype=bool)
                    keep[gone] = False
                    ends = np.cumsum(lines.counts)
                    raw, new = data.tobytes(), {}
                    for r in changed.tolist():
                        kept = np.flatnonzero(keep[ends[r] - lines.counts[r] : ends[r]]) + ends[r] - lines.counts[r]
                        new[r] = b"\n".join([raw[lines.starts[i] : lines.ends[i]] for i in kept]).decode()
                    text = pa.array([new.get(r, t) for r, t in enumerate(text.to_pylist())], text.type)
                columns = [part.column(0), text, *part.columns[2 : part.num_columns - extra], pa.array(lines.counts), pa.array(dropped)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def without_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, most_broadcast: int = DROPPED_BROADCAST) -> DataFrame:
    """The documents without repeated lines, with n_lines (before) and n_dropped; all columns kept.

    Keys of at least ``least_chars`` code points in at least ``least_documents``
    documents lose all their lines except in the largest doc_id that holds them.
    The other lines stay as they are, joined by line feeds; a text that loses all
    is empty.  ``n_chars`` and other columns are left alone; columns named like
    the new ones are replaced.  A null text stays null and, like an empty one,
    has one empty line.  Rows of one doc_id are one document: they count once
    and keep or lose lines together, and so do all rows without a doc_id, which
    come before every number.  Texts may be of any length; a row is read whole.
    An empty table gives an empty one.
    """
    repeated, suspects = repeated_keys(docs, least_chars, least_documents)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    wide = docs.select("doc_id", "text", *others)
    names = [*wide.columns, "n_lines", "n_dropped"]
    fields = {f.name: f for f in wide.schema}
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in wide.columns), "n_lines long, n_dropped long"])
    if _kind(docs) in ("bigint", "int") and repeated.limit(most_broadcast + 1).count() <= most_broadcast:
        few = repeated.select("h1", "h2", F.col("keeper").cast("long").alias("keeper")).toArrow()
        if len(few["h1"].unique()) == len(few):
            return wide.mapInArrow(_dropper(names, 0, _by_broadcast(docs.sparkSession, few, least_chars)), schema)
    # per document the keys it loses
    lost = suspects.join(repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    mine, list_ = fresh(wide, "_doc"), fresh(wide, "_lost")
    lost = lost.groupBy(F.col("doc_id").alias(mine)).agg(F.collect_set(F.struct("h1", "h2")).alias(list_))
    joined = wide.join(lost, wide["doc_id"].eqNullSafe(lost[mine]), "left").select(*wide.columns, list_)
    return joined.mapInArrow(_dropper(names, 1, _by_list), schema)


def _by_list(part: pa.RecordBatch, lines: Lines) -> np.ndarray:
    """Lines of the keys that each row's last column lists."""
    lists = part.column(part.num_columns - 1)
    known = {(r, x["h1"], x["h2"]) for r, keys in enumerate(lists.to_pylist()) for x in keys or ()}
    if not known:
        return np.zeros(0, dtype=np.int64)
    some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)[lines.row])
    h1, h2 = (h.view(np.int64).tolist() for h in lines.hashes(some))
    return some[[k for k, key in enumerate(zip(lines.row[some].tolist(), h1, h2)) if key in known]]


def _by_broadcast(spark, few: pa.Table, least_chars: int):
    """Lines whose key is in a table of repeated keys and whose document is not the keeper."""
    h1, h2 = (few[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    keeper = few["keeper"]
    shared = spark.sparkContext.broadcast((h1, h2, keeper.fill_null(0).to_numpy(), keeper.is_valid().to_numpy()))
    made: list = []

    def find(part: pa.RecordBatch, lines: Lines) -> np.ndarray:
        if not made:
            made.append(Lookup(shared.value[0]))
        long = np.flatnonzero(lines.chars >= least_chars)
        h1, h2 = lines.hashes(long)
        at = made[0](h1)
        hit = at >= 0
        long, h2, at = long[hit], h2[hit], at[hit]
        _, second, keeper, has = shared.value
        ids = part.column(0)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)[lines.row[long]]
        number = ids.cast(pa.int64()).fill_null(0).to_numpy()[lines.row[long]]
        mine = (valid & has[at] & (number == keeper[at])) | (~valid & ~has[at])
        return long[(second[at] == h2) & ~mine]

    return find


def digests(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of what is left; a null text counts as empty."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: the same in DuckDB's SQL
LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)) AS i FROM documents)),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
