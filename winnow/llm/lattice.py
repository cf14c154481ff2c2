"""Document likelihood under a subword lattice.

A word is generated piece by piece from an existing vocabulary: a first piece
out of those that begin words, then further pieces until a stop.  All
segmentations of a word count: a forward recursion in log space over its bytes
sums them, for many words of one length at once.  The vocabulary's own scores
(its order) weight the pieces at first; expectation steps over all training
words then refit them, the counts of pieces being all that reaches the driver.

A whole word seen in training is an arc of the lattice too: its discounted
share of the training words, and what the discount frees goes to the pieces.
So P(word) = (1 - P(end)) ((c - d) / N + d V / N * P_pieces(word)), which sums to 1
over all words.  A document is its words and one end.

Texts are a mixture of at most ``CLASSES`` classes, the frequent languages of the
training texts and one for the rest: a class has its own counts of whole words,
discounted towards the P(word) above in the same way, and the probability of a
text is that of all classes together.  Its own language is not looked at.

Corpus-wide counts live in tables.  Words with at least 1 / ``HEAD`` of all
tokens, of which there can be no more than ``HEAD``, are broadcast; the rest of
a document's words meet their counts in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.scan import BYTE_LOWER, BYTE_VALUES, Lookup, Spans, Words, blocks, span_hashes, staged

#: words that can be broadcast at most: 64 MB
HEAD = 1 << 21
EXPECTATION_STEPS = 3
PRIOR = 0.01
CLASSES = 8
#: distinct words a counting task holds before it hands them on
HELD = 1_000_000
_GROUP = 20_000
#: bytes from which a word is taken by itself
LONG = 200
_LN10 = math.log(10)


@dataclass
class Pieces:
    """Pieces that begin a word and pieces that go on with one (every byte is among these); log weights."""

    first: list[bytes]
    then: list[bytes]
    log_first: np.ndarray
    log_then: np.ndarray  # the last one is the stop

    def __post_init__(self):
        self.at_first, self.at_then = Lookup(_hashes(self.first)), Lookup(_hashes(self.then))
        self.first_lengths = sorted({len(p) for p in self.first if p})
        self.then_lengths = sorted({len(p) for p in self.then})
        self.empty = self.first.index(b"")


def _hashes(parts: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(p) for p in parts])
    return span_hashes(BYTE_VALUES[np.frombuffer(b"".join(parts), dtype=np.uint8)], np.concatenate([[0], ends[:-1]]), ends)


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model file; weights fall with their place, as its scores do."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first: dict[bytes, float] = {b"": 0.0}
    then: dict[bytes, float] = {}
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece, weight = model.id_to_piece(i), 1 / (100 - model.get_score(i))
        text = piece.lstrip("▁").encode()
        if text != bytes(BYTE_LOWER[np.frombuffer(text, dtype=np.uint8)]):
            continue  # texts have no A-Z
        known = first if piece.startswith("▁") else then
        known[text] = max(known.get(text, 0.0), weight)
    first[b""] = max(first[b""], 1e-3)
    for b in {int(x) for x in BYTE_LOWER}:
        then.setdefault(bytes([b]), 1e-6)
    stop = sum(then.values()) / 2
    return Pieces(list(first), list(then), _normal(np.array(list(first.values()))), _normal(np.array([*then.values(), stop])))


def _normal(weights: np.ndarray) -> np.ndarray:
    return np.log(weights / weights.sum())


def _add(a: np.ndarray, rows: np.ndarray, column: int, values: np.ndarray) -> None:
    a[rows, column] = np.logaddexp(a[rows, column], values)


def _long(pieces: Pieces, spans: Spans, begin: int, length: int, weight: float | None, used_first: np.ndarray, used_then: np.ndarray) -> float:
    """The recursion for one long word: all its arcs are looked up at once, then taken in order of their ends."""
    heads = np.array([s for s in pieces.first_lengths if s <= length], dtype=np.int64)
    firsts = [(s, p) for s, p in zip(heads.tolist(), pieces.at_first(spans.hashes(begin + 0 * heads, begin + heads)).tolist()) if p >= 0]
    ends, sizes, found = [], [], []
    for size in pieces.then_lengths:
        if size <= length:
            at = np.arange(size, length + 1)
            piece = pieces.at_then(spans.hashes(begin + at - size, begin + at))
            ends.append(at[piece >= 0])
            sizes.append(np.full(len(ends[-1]), size))
            found.append(piece[piece >= 0])
    end, size, piece = (np.concatenate(x) for x in (ends, sizes, found))
    order = np.argsort(end, kind="stable")
    steps = list(zip(end[order].tolist(), size[order].tolist(), pieces.log_then[piece[order]].tolist(), piece[order].tolist()))
    alpha = [-math.inf] * (length + 1)
    alpha[0] = float(pieces.log_first[pieces.empty])
    for j, p in firsts:
        alpha[j] = float(pieces.log_first[p])
    for j, width, log, _ in steps:
        alpha[j] = _sum_logs(alpha[j], alpha[j - width] + log)
    stop = float(pieces.log_then[-1])
    whole = alpha[length] + stop
    if weight is not None:
        beta = [-math.inf] * length + [stop]
        for j, width, log, p in reversed(steps):
            arc = log + beta[j]
            used_then[p] += math.exp(alpha[j - width] + arc - whole) * weight
            beta[j - width] = _sum_logs(beta[j - width], arc)
        for j, p in [*firsts, (0, pieces.empty)]:
            used_first[p] += math.exp(float(pieces.log_first[p]) + beta[j] - whole) * weight
        used_then[-1] += weight
    return whole


def _sum_logs(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def forward(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of every word over all its segmentations; with ``weights``, also the expected uses of the pieces."""
    spans, lengths = Spans(BYTE_VALUES[data]), ends - starts
    out = np.zeros(len(starts))
    not_empty = math.log1p(-math.exp(pieces.log_first[pieces.empty] + pieces.log_then[-1]))  # a word has bytes
    used_first, used_then = np.zeros(len(pieces.first)), np.zeros(len(pieces.then) + 1)
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = _long(pieces, spans, int(starts[i]), int(lengths[i]), None if weights is None else float(weights[i]), used_first, used_then) - not_empty
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] <= LONG]
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts) if len(order) else []:
        for at in range(0, len(same), _GROUP):
            members = same[at : at + _GROUP]
            n, length, begin = len(members), int(lengths[members[0]]), starts[members]
            everyone = np.arange(n)
            alpha = np.full((n, length + 1), -np.inf)
            alpha[:, 0] = pieces.log_first[pieces.empty]
            arcs = []
            for j in range(1, length + 1):
                for size, table, lookup in [(s, 0, pieces.at_first) for s in pieces.first_lengths if s == j] + [(s, 1, pieces.at_then) for s in pieces.then_lengths if s <= j]:
                    piece = lookup(spans.hashes(begin + (j - size), begin + j))
                    rows = everyone[piece >= 0]
                    if not len(rows):
                        continue
                    piece = piece[rows]
                    if table:
                        _add(alpha, rows, j, alpha[rows, j - size] + pieces.log_then[piece])
                    else:
                        _add(alpha, rows, j, pieces.log_first[piece])
                    if weights is not None:
                        arcs.append((table, j, size, rows, piece))
            whole = alpha[:, length] + pieces.log_then[-1]
            out[members] = whole - not_empty
            if weights is None:
                continue
            weight = weights[members]
            beta = np.full((n, length + 1), -np.inf)
            beta[:, length] = pieces.log_then[-1]
            for table, j, size, rows, piece in reversed(arcs):
                if table:
                    arc = pieces.log_then[piece] + beta[rows, j]
                    used_then += np.bincount(piece, weights=np.exp(alpha[rows, j - size] + arc - whole[rows]) * weight[rows], minlength=len(used_then))
                    _add(beta, rows, j - size, arc)
                else:
                    used_first += np.bincount(piece, weights=np.exp(pieces.log_first[piece] + beta[rows, j] - whole[rows]) * weight[rows], minlength=len(used_first))
            used_first[pieces.empty] += (np.exp(pieces.log_first[pieces.empty] + beta[:, 0] - whole) * weight).sum()
            used_then[-1] += weight.sum()
    return out, used_first, used_then


def _bytes(words: Words, which: np.ndarray) -> pa.Array:
    """The chosen words, in lower case, as an Arrow column."""
    lengths = words.ends[which] - words.starts[which]
    ends = np.cumsum(lengths)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.starts[which] - (ends - lengths), lengths)
    return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(BYTE_LOWER[words.data[places]])])


def count_words(docs: DataFrame, training: Column, kind: Column) -> DataFrame:
    """word, n (in training texts), n0, n1, ... (by class), seen (in all texts) over the whole table.

    A task hands on a word once for about a million words it has met, so the
    shuffle carries distinct words, not tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        spelt: list[pa.Array] = []
        firsts: list[np.ndarray] = []
        known, size = np.zeros(0, dtype=np.uint64), 0

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate([h for h, _, _ in held])
            kinds = np.concatenate([k for _, k, _ in held])
            order = np.lexsort((kinds, hashes))
            hashes, kinds = hashes[order], kinds[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (kinds[1:] != kinds[:-1])]))
            times = np.add.reduceat(np.concatenate([n for _, _, n in held])[order], first)
            spelling = np.concatenate(firsts)
            place = np.argsort(spelling)
            words = pa.concat_arrays(spelt).take(pa.array(place[np.searchsorted(spelling[place], hashes[first])]))
            return pa.RecordBatch.from_arrays([words, pa.array(kinds[first]), pa.array(times)], ["word", "kind", "times"])

        for batch in batches:
            kinds = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, data, offsets in blocks(batch.column(0)):
                words = Words(data, offsets)
                if not len(words.starts):
                    continue
                hashes, one, at = np.unique(words.hashes(), return_index=True, return_inverse=True)
                pair, times = np.unique(at * (CLASSES + 1) + kinds[first + words.row_of()] + 1, return_counts=True)
                held.append((hashes[pair // (CLASSES + 1)], pair % (CLASSES + 1) - 1, times))
                new = ~np.isin(hashes, known, assume_unique=True)
                firsts.append(hashes[new])
                spelt.append(_bytes(words, one[new]))
                known = np.concatenate([known, hashes[new]])
                size += len(pair)
                if len(known) >= HELD or size >= 4 * HELD:
                    yield flush()
                    held, spelt, firsts, known, size = [], [], [], np.zeros(0, dtype=np.uint64), 0
        if held:
            yield flush()

    met = docs.select("text", F.when(training, kind).otherwise(-1).cast("int").alias("kind")).mapInArrow(run, "word binary, kind long, times long")
    per = [F.sum(F.when(F.col("kind") == k, F.col("times")).otherwise(0)).alias(f"n{k}") for k in range(CLASSES)]
    out = met.groupBy("word").agg(F.sum(F.when(F.col("kind") >= 0, F.col("times")).otherwise(0)).alias("n"), *per, F.sum("times").alias("seen"))
    return out


def classes(docs: DataFrame, training: Column, column: str = "lang") -> tuple[Column, np.ndarray]:
    """The class of a row by ``column``, and the training documents of each class; without the column there is one class."""
    if column not in docs.columns:
        return F.lit(0), np.array([docs.where(training).count()] + [0] * (CLASSES - 1))
    found = docs.where(training).groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    top = found.orderBy(F.desc("n"), "c").limit(CLASSES - 1).collect()
    total = found.agg(F.sum("n")).first()[0] or 0
    kind = F.lit(CLASSES - 1)
    for k, r in enumerate(top):
        kind = F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) == r["c"], k).otherwise(kind)
    counts = np.zeros(CLASSES, dtype=np.int64)
    counts[: len(top)] = [r["n"] for r in top]
    counts[CLASSES - 1] = total - counts.sum()
    return kind, counts


def _word_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Few large batches: the recursion takes all words of one length at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def refit(pieces: Pieces, words: DataFrame) -> Pieces:
    """One expectation step over all training words, each once: what the pieces have to explain is new words."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        total = np.zeros(len(p.first) + len(p.then) + 1)
        for batch in _larger(batches):
            _, a, b = forward(p, *_word_column(batch.column(0)), weights=np.ones(batch.num_rows))
            total += np.concatenate([a, b])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "uses"])

    uses = np.zeros(len(pieces.first) + len(pieces.then) + 1)
    for r in words.where("n > 0").select("word").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toLocalIterator():
        uses[r["piece"]] = r["uses"]
    uses += PRIOR
    return Pieces(pieces.first, pieces.then, _normal(uses[: len(pieces.first)]), _normal(uses[len(pieces.first) :]))


def score(docs: DataFrame, training: Column, pieces_path: str) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, lattice_score of every whole text.

    ``training`` marks the documents to learn from.  Scores are log10
    probabilities; ``lattice_score`` leaves the whole-word arcs out.  Null and
    empty texts are one end.  Rows with equal id and text are scored together
    and given back as often as they came; ids may be null.  Without training
    documents the vocabulary's own weights stand.
    """
    spark = docs.sparkSession
    pieces = load_pieces(pieces_path)
    kind, documents = classes(docs, training)
    words = staged(count_words(docs, training, kind), "words")
    ends = int(documents.sum())
    counted = ["n", *(f"n{k}" for k in range(CLASSES))]
    parts = [f(c) for c in counted for f in (F.sum, lambda c: F.count_if(F.col(c) > 0), lambda c: F.count_if(F.col(c) == 1), lambda c: F.count_if(F.col(c) == 2))]
    sums = [int(x or 0) for x in words.agg(F.sum("seen"), *parts).first()]
    seen, tallies = sums[0], np.array(sums[1:]).reshape(-1, 4)
    for _ in range(EXPECTATION_STEPS if tallies[0, 0] else 0):
        pieces = refit(pieces, words)
    total = int(tallies[0, 0]) + ends
    base = 0.5 * (int(tallies[0, 1]) + (ends > 0) + 1) + total
    end = (ends + 0.5) / (total + 1)
    shared = spark.sparkContext.broadcast(pieces)

    def backed(n: np.ndarray, tally: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Log probability of words counted n times, discounted towards ``below``."""
        tokens, distinct, once, twice = (float(x) for x in tally)
        if not tokens:
            return below
        discount = once / (once + 2 * twice) if once else 0.5
        return np.logaddexp(below + math.log(discount * distinct / tokens), np.log(np.maximum(n - discount, 1e-300) / tokens))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches):
            data, starts, stops = _word_column(batch.column(0))
            n = [batch.column(1 + k).to_numpy() for k in range(1 + CLASSES)]
            by_pieces = forward(shared.value, data, starts, stops)[0]
            overall = backed(n[0], tallies[0], by_pieces)
            each = [backed(n[1 + k], tallies[1 + k], overall) for k in range(CLASSES)]
            hashes = span_hashes(BYTE_VALUES[data], starts, stops)
            logs = [np.log10((n[0] + 0.5) / base), *((x + math.log1p(-end)) / _LN10 for x in (by_pieces, *each))]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n[0] > 0), batch.column(2 + CLASSES), *map(pa.array, logs)], ["h", "known", "seen", *values])

    values = ["base", "lattice", *(f"f{k}" for k in range(CLASSES))]
    doubles = ", ".join(f"{v} double" for v in values)
    weighed = staged(words.select("word", *counted, "seen").mapInArrow(weigh, f"h long, known boolean, seen long, {doubles}"), "weighed")
    head = weighed.where(F.col("seen") >= max(2, -(-seen // HEAD))).drop("seen").toPandas()
    common = spark.sparkContext.broadcast({c: head[c].to_numpy() for c in head.columns})
    of_end = [math.log10((ends + 0.5) / base)] + [math.log10(end)] * (1 + CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.value
        lookup = Lookup(table["h"].view(np.uint64))
        for batch in batches:
            for first, data, offsets in blocks(batch.column(2)):
                words = Words(data, offsets)
                rows = words.row_of()
                hashes, at = np.unique(words.hashes(), return_inverse=True)
                place = lookup(hashes)
                inside = place >= 0
                sums = [words.counts + 1]
                for name, start in zip(("known", *values), (int(ends > 0), *of_end)):
                    worth = np.zeros(len(hashes))
                    worth[inside] = table[name][place[inside]]
                    sums.append(np.bincount(rows, weights=worth[at], minlength=words.rows) + start)
                outside = np.flatnonzero(~inside[at])
                pair, times = np.unique(rows[outside] * max(1, len(hashes)) + at[outside], return_counts=True)
                rare_rows, rare = np.divmod(pair, max(1, len(hashes)))
                take = pa.array(np.concatenate([np.arange(words.rows), rare_rows]) + first)
                zeros = np.zeros(len(pair))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take)]
                    + [pa.array(np.concatenate([mix_rows(first, words.rows), hashes[rare].view(np.int64)])), pa.array(np.concatenate([np.zeros(words.rows), times]).astype(np.int32))]
                    + [pa.array(np.concatenate([x.astype(float), zeros])) for x in sums],
                    names,
                )

    names = ["doc_id", "k", "h", "times", "n_tokens", "n_known", *values]
    keyed = docs.select("doc_id", F.hash("text").alias("k"), F.col("text").alias("_text"))
    rows = keyed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k int, h long, times int, n_tokens double, n_known double, {doubles}")
    met = rows.join(weighed.select("h", "known", *(F.col(c).alias(f"w_{c}") for c in values)), "h", "left")
    times = F.col("times")
    plus = [F.sum(F.col(c) + F.when(times > 0, times * F.col(f"w_{c}")).otherwise(0.0)).alias(c) for c in values]
    out = met.groupBy("doc_id", "k").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when((times > 0) & F.col("known"), times).otherwise(0)).alias("n_known"), *plus, F.count_if(times == 0).alias("copies"))
    each = out.withColumn("_copy", F.explode(F.expr("array_repeat(0, int(copies))")))
    per = lambda c: F.col(c) / F.col("copies")
    shares = np.log10((documents + 1) / (documents.sum() + CLASSES))
    logs = [per(f"f{k}") + float(shares[k]) for k in range(CLASSES)]
    most = F.greatest(*logs)
    mixed = most + F.log10(sum((F.pow(F.lit(10.0), x - most) for x in logs), F.lit(0.0)))
    return each.select("doc_id", per("n_tokens").cast("long").alias("n_tokens"), F.round(per("n_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), per("base").alias("base_score"), mixed.alias("score"), per("lattice").alias("lattice_score"))


def mix_rows(first: int, n: int) -> np.ndarray:
    """Join keys that spread rows without a rare word; such rows ignore what they meet."""
    return (np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
