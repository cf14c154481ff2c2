"""Jaccard self-join on word n-grams by chosen paths.

A document is the set of its five-word shingles, embedded as ``HASHES`` MinHash
tokens.  A run grows a tree of buckets: in a bucket, each token place is chosen
with probability 1 / (similarity * HASHES) by a hash of the path so far, and the
documents go down with the value they have there.  Two documents of the wanted
similarity are expected to share one child at every level.  A bucket small
enough is settled by brute force on the tokens' low bytes; a larger one is split
further, in one task while it fits there and by Spark beyond.  Runs are repeated
until a pair at the threshold that needs ``DEPTH`` levels is found with the
target recall.

What the buckets link are groups.  Within a group all pairs are then counted
exactly on the shingles, a group beyond one task as pairs of its blocks, so
pairs are never rows: a document gets its class and its number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.components import components
from winnow.llm.scan import Words, blocks, mix, ngrams, release, staged, unique_per_row

SHINGLE = 5
SIMILAR = 0.8
RECALL = 0.999
HASHES = 128
DEPTH = 3
#: documents of a bucket that one task splits by itself, and those it compares without splitting
BUCKET, LEAF = 4096, 256
#: shingles and documents of one block of a group
BLOCK_SHINGLES, BLOCK_DOCUMENTS = 400_000, 1_500
#: how far the estimate from HASHES tokens may lie below the threshold: four deviations
SLACK = 0.14

_SALTS = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) | np.uint64(1)
_PLACES = mix(np.arange(5001, 5001 + HASHES, dtype=np.uint64))


def runs_for(recall: float = RECALL, depth: int = DEPTH, similar: float = SIMILAR) -> int:
    """Runs after which a pair at the threshold is in one bucket with probability ``recall``, if all its buckets need ``depth`` levels.

    The first level is one draw for all documents, so its places are counted as drawn; roots at one place share their first token.
    """
    survive = 1.0
    for _ in range(depth - 1):
        survive = 1 - math.exp(-survive)
    runs, at = 0, np.zeros(HASHES)
    while np.prod(1 - similar + similar * (1 - survive) ** at) > 1 - recall:
        runs += 1
        at = np.bincount([i for _, i in _roots(runs, similar)], minlength=HASHES)
    return runs


def _chosen(paths: np.ndarray, similar: float) -> np.ndarray:
    """For every path, which token places are chosen (paths x HASHES)."""
    return mix(paths[:, None] ^ _PLACES[None, :]) < np.uint64(int(2**64 / (similar * HASHES)))


def _roots(runs: int, similar: float) -> list[tuple[int, int]]:
    """(run, place) of the first level: the same for all documents."""
    chosen = _chosen(mix(np.arange(1, runs + 1, dtype=np.uint64)), similar)
    return [(int(r), int(i)) for r, i in np.argwhere(chosen)]


def _child(path: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(path ^ mix((place.astype(np.uint64) << np.uint64(32)) | value.astype(np.uint64)))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingles, number per row); a text of one to four words is one shingle."""
    for first, data, offsets in blocks(column, fold=True):
        words = Words(data, offsets)
        yield first, *unique_per_row(*ngrams(words.hashes(), words.counts, SHINGLE))


def _embed(docs: DataFrame, roots: list[tuple[int, int]]) -> DataFrame:
    """doc_id, key, h, k1, k2 (of the set), n, first-level paths, low bytes of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, grams, sizes in shingle_sets(batch.column(3)):
                rows = len(sizes)
                filled = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[filled]
                sums = [np.zeros(rows, dtype=np.uint64) for _ in range(2)]
                tokens = np.zeros((rows, HASHES), dtype=np.uint32)
                if len(filled):
                    for k in range(2):
                        sums[k][filled] = np.add.reduceat(mix(grams ^ _PLACES[k]), starts)
                    for k, salt in enumerate(_SALTS):
                        tokens[filled, k] = np.minimum.reduceat(((grams * salt) >> np.uint64(32)).astype(np.uint32), starts)
                paths = np.stack([_child(np.full(rows, r + 1, dtype=np.uint64), np.full(rows, i), tokens[:, i]) for r, i in roots], axis=1)
                low = mix(tokens.astype(np.uint64)).astype(np.uint8)
                lists = np.where(sizes > 0, paths.shape[1], 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(first, rows) for i in range(3)),
                        *(pa.array(s.view(np.int64)) for s in sums),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32)), pa.array(paths[sizes > 0].reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["doc_id", "key", "h", "k1", "k2", "n", "paths", "low"],
                )
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_key", "_h", "text").mapInArrow(run, f"doc_id {kind}, key long, h long, k1 long, k2 long, n long, paths array<long>, low binary")


def _alike(low: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Pairs of rows whose tokens agree often enough, by brute force in strips."""
    n, least = len(low), math.ceil((similar - SLACK) * HASHES)
    strip = max(1, (4 << 20) // (n * HASHES))
    found = []
    for at in range(0, n - 1, strip):
        agree = (low[at : at + strip, None, :] == low[None, at:, :]).sum(axis=2)
        a, b = np.nonzero(agree >= least)
        keep = b > a
        found += list(zip((a[keep] + at).tolist(), (b[keep] + at).tolist()))
    return found


def _forest(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The smallest member of everyone's component."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)], dtype=np.int64)


def _settle(path: int, low: np.ndarray, similar: float, depth: int) -> list[tuple[int, int]]:
    """Linked pairs of one bucket: split on while it is large and levels are left, else compare."""
    if len(low) <= LEAF or depth >= DEPTH:
        return _alike(low, similar)
    found: list[tuple[int, int]] = []
    paths = np.array([path], dtype=np.uint64)
    for place in np.flatnonzero(_chosen(paths, similar)[0]):
        values = low[:, place]
        for value in np.flatnonzero(np.bincount(values, minlength=256) > 1):
            members = np.flatnonzero(values == value)
            child = int(_child(paths, np.array([place]), np.array([value]))[0])
            found += [(int(members[a]), int(members[b])) for a, b in _settle(child, low[members], similar, depth + 1)]
    return found


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal first ``keys`` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in columns) != last
        begin = 0
        for at in [*np.flatnonzero(change).tolist(), batch.num_rows]:
            if at > begin or (at == 0 and held):
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                if at < batch.num_rows or (at == 0):
                    yield pa.Table.from_batches(held)
                    held = []
            begin = at
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), HASHES)


def _bucket_links(buckets: DataFrame, similar: float, depth: int) -> DataFrame:
    """(a, b) links, at most one per member, from (path, node, low) rows sorted by path."""
    least = math.ceil((similar - SLACK) * HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches):
            paths = table.column(0).to_numpy()
            nodes, low = table.column(1).to_numpy(), _matrix(table.column(2))
            starts = np.flatnonzero(np.append(True, paths[1:] != paths[:-1]))
            sizes = np.diff(np.append(starts, len(paths)))
            two = starts[sizes == 2]
            two = two[(low[two] == low[two + 1]).sum(axis=1) >= least]
            a, b = [nodes[two]], [nodes[two + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                root = _forest(n, _settle(int(paths[s]) & (2**64 - 1), low[s : s + n], similar, depth))
                linked = np.flatnonzero(root != np.arange(n))
                a.append(nodes[s + root[linked]])
                b.append(nodes[s + linked])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets: what is left of a bucket at a batch's end waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column(0).to_numpy()
        if path[-1] == path[0]:
            if held and held[-1].column(0)[-1].as_py() != path[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        cut = int(np.flatnonzero(path != path[-1])[-1]) + 1
        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _deeper(entries: DataFrame, similar: float) -> DataFrame:
    """Members of buckets too large for one task, sent to the next level's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, low = batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(2))
            row, place = np.nonzero(_chosen(paths, similar))
            child = _child(paths[row], place, low[row, place])
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *batch.select([1, 2]).take(pa.array(row)).columns], ["path", "node", "low"])

    return entries.mapInArrow(run, "path long, node long, low binary")


def _in_blocks(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Buckets still too large at the last level: every pair of blocks is a bucket of its own."""
    count = F.ceil(F.col("size") / (BUCKET // 2)).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))
    dealt = entries.join(sizes.withColumn("blocks", count), "path").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "node", "low")


def candidate_links(nodes: DataFrame, similar: float, bucket: int = BUCKET) -> DataFrame:
    """Links between nodes that met in a bucket and look alike, from rows node, paths, low."""
    entries = nodes.select("node", F.explode("paths").alias("path"))
    shared = entries.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = staged(entries.join(shared, "path").join(nodes.select("node", "low"), "node").select("path", "node", "low", "size"), "buckets")
    links = None
    for depth in range(1, DEPTH + 1):
        small = met.where(F.col("size") <= bucket)
        small = small.select("path", "node", "low").repartition("path").sortWithinPartitions("path", "node")
        found = _bucket_links(small, similar, depth)
        links = found if links is None else links.unionByName(found)
        large = met.where(F.col("size") > bucket)
        if large.isEmpty():
            return links
        if depth < DEPTH:
            down = staged(_deeper(large.select("path", "node", "low"), similar), "deeper")
            met = staged(down.join(down.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "path"), "buckets")
    rest = _in_blocks(large.select("path", "node", "low"), large.select("path", "size").distinct())
    return links.unionByName(_bucket_links(rest.repartition("path").sortWithinPartitions("path", "node"), similar, DEPTH))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    keep = often[at]
    owner, token = owner[keep], place[at[keep]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out = np.zeros((n, n), dtype=np.float32)
    step = max(256, (16 << 20) // max(1, 4 * n))
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(token, [lo, lo + step])
        part = np.zeros((n, min(step, int(often.sum()) - lo)), dtype=np.float32)
        part[owner[a:b], token[a:b] - lo] = 1
        out += part @ part.T
    return out


def _verify(groups: DataFrame, similar: float) -> DataFrame:
    """node, root, links (documents) of every member of every block pair, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            ids = table.column(4).to_numpy()
            _, one = np.unique(ids, return_index=True)
            table = table.take(pa.array(one))
            ids, own, copies = (table.column(i).to_numpy() for i in (4, 3, 5))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column(6).to_pylist()]
            sizes = np.array([len(s) for s in sets], dtype=np.float64)
            common = _common(sets).astype(np.float64)
            linked = common >= similar * (sizes[:, None] + sizes[None, :] - common) - 1e-9
            np.fill_diagonal(linked, False)
            if table.column(1)[0] != table.column(2)[0]:
                linked &= own[:, None] != own[None, :]
            order = np.argsort(ids)
            pairs = np.argwhere(np.triu(linked[np.ix_(order, order)]))
            root = np.empty(len(ids), dtype=np.int64)
            root[order] = ids[order][_forest(len(ids), pairs.tolist())]
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(ids), pa.array(root), pa.array(linked @ copies)], ["root0", "node", "root", "links"])
        release()

    return groups.mapInArrow(run, "root0 long, node long, root long, links long")


def _with_shingles(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, grams, sizes in shingle_sets(batch.column(batch.num_columns - 1)):
                ends = np.cumsum(sizes)
                sets = [grams[e - n : e].tobytes() for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(sets)) for i in range(4)), pa.array(sets, pa.binary())], ["root", "blocks", "node", "copies", "shingles"])
        release()

    return docs.select("root", "blocks", "node", "copies", "text").mapInArrow(run, "root long, blocks long, node long, copies long, shingles binary")


def join(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL, bucket: int = BUCKET, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document.

    ``n_links`` is the number of other documents with a likeness of at least
    ``similar`` (those with an equal set included), ``n_copies`` that of
    documents with an equal set of shingles, itself included, ``class_id`` the
    smallest doc_id of the documents connected by links.  Texts without words
    (null, empty) have equal, empty sets.  Texts of one to four words are one
    shingle.  Nodes are sets of shingles, so texts of one doc_id count and link
    each by itself: every row gives one row, with the class and links of its own
    text, and repeated rows count like copies.  A null doc_id is identified by
    its text (and its class, if all are null, by a hash of it).  Texts may be of
    any length; an empty table gives an empty one.
    """
    return _classes(_keyed(docs.select("doc_id", "text")), similar, recall, bucket, block_documents).select("doc_id", "class_id", "n_links", "n_copies")


def _keyed(docs: DataFrame) -> DataFrame:
    """With _key, the document's number, and _h, a hash of its text: both together name a text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return docs.withColumn("_key", key).withColumn("_h", F.xxhash64("text", F.lit(3)))


def _classes(keyed: DataFrame, similar: float = SIMILAR, recall: float = RECALL, bucket: int = BUCKET, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    keyed = keyed.select("doc_id", "_key", "_h", "text")
    known = staged(_embed(keyed, _roots(runs_for(recall, similar=similar), similar)), "embedded")
    first = F.min(F.struct("key", "h", "n", "paths", "low"))
    sets = known.groupBy("k1", "k2").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"))
    # a set's number names it, not its document, which may have other texts too
    sets = staged(sets.select("k1", "k2", "copies", F.monotonically_increasing_id().alias("node"), F.col("f.key").alias("doc"), "f.h", "f.n", "f.paths", "f.low"), "sets")
    groups = staged(components(candidate_links(sets.where("n > 0").select("node", "paths", "low"), similar, bucket)), "groups")
    members = groups.join(sets.select("node", "n", "copies", "doc", "h"), "node")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / block_documents)).cast("long").alias("blocks"))
    members = members.join(sizes, "root").select("root", "blocks", "node", "copies", "doc", "h")
    texts = _with_shingles(keyed.join(members, (keyed["_key"] == members["doc"]) & (keyed["_h"] == members["h"])))
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks"))
    dealt = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "node", "copies", "shingles")
    placed = dealt.repartition("root", "b1", "b2").sortWithinPartitions("root", "b1", "b2")
    counted = staged(_verify(placed, similar), "counted")
    split = counted.join(sizes.where("blocks > 1"), counted["root0"] == sizes["root"], "left_semi")
    parts = components(split.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    classes = counted.join(parts.withColumnRenamed("root", "part"), "node", "left").select("node", "links", F.coalesce("part", "root").alias("class_id"))
    named = sets.select("k1", "k2", "copies", "node", "doc", "h").join(classes, "node", "left").withColumn("part", F.coalesce("class_id", "node")).drop("class_id")
    # a class is called after its smallest document
    heads = named.where("links is not null").groupBy("part").agg(F.min(F.struct("doc", "h")).alias("head"))
    named = named.join(heads, "part", "left").withColumn("head", F.coalesce("head", F.struct("doc", "h")))
    named = named.select("k1", "k2", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    rows = known.select("doc_id", F.col("key").alias("_key"), F.col("h").alias("_h"), "k1", "k2").join(named, ["k1", "k2"])
    return rows.select("doc_id", "_key", "_h", F.col("head.doc").alias("class_id"), "head", "n_links", "n_copies")


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The first document of each class, with all its columns; of repeated rows one stays.

    Different texts of one doc_id are documents of their own: both stay if they
    are no copies of anything.  Null, empty and wordless texts are one class, of which one stays.
    """
    named = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)], "doc_id", "text")
    keyed = _keyed(named)
    first = _classes(keyed, similar).select("head").distinct().select(F.col("head.doc").alias("_key"), F.col("head.h").alias("_h"))
    kept = keyed.join(first, ["_key", "_h"], "left_semi").dropDuplicates(["_key", "_h"])
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
