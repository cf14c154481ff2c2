"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A text is a vector of hashed terms: its words, the shapes of its words (runs
of lower case, upper case, digits and each sign) and the distances at which a
word comes again, log-weighted by frequency and by document frequency over all
documents.  The leading eigenvectors of a bounded
labelled sample are the latent space.  The sample's latent vectors are
broadcast; every document meets all of them in one exact block product, and the
labels of its nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.labelled import sample
from winnow.llm.scan import BYTE_VALUES, Words, blocks, span_hashes, staged

TERMS = 2048
LATENT = 64
#: distances, in words, at which a word that comes again is a term; each weighs as much as AGAIN_TERMS terms
AGAIN, AGAIN_TERMS = 4, 8
NEIGHBOURS = 50
SHARPNESS = 8
#: labelled rows that may vote: with LATENT dimensions about 2 MB
VOTERS = 8_000

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def term_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the hashed terms, one row per text."""
    words = Words(data, offsets)
    rows = words.row_of()
    if not len(rows):
        return np.zeros((words.rows, TERMS), dtype=np.float32)
    shapes = _SHAPE[data]
    change = np.ones(len(data), dtype=bool)
    change[1:] = shapes[1:] != shapes[:-1]
    change[words.starts] = True
    place = np.cumsum(change) - 1
    shape = span_hashes(BYTE_VALUES[::-1][shapes[change]], place[words.starts], place[words.ends - 1] + 1)
    half, own = np.uint64(TERMS // 2), words.hashes()
    places = [rows * TERMS + (own % half).astype(np.int64), rows * TERMS + (shape % (half - np.uint64(AGAIN * AGAIN_TERMS)) + half).astype(np.int64)]
    for k in range(1, AGAIN + 1):
        again = rows[k:][(own[k:] == own[:-k]) & (rows[k:] == rows[:-k])]
        places += [again * TERMS + TERMS - k * AGAIN_TERMS + j for j in range(AGAIN_TERMS)]
    return np.bincount(np.concatenate(places), minlength=words.rows * TERMS).reshape(words.rows, TERMS).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents holding each hashed term and their number, over the whole table; the result has TERMS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                total += (term_matrix(data, offsets) > 0).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(TERMS), -1)), pa.array(np.append(total, n))], ["term", "n"])

    seen = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS)
    for r in seen:
        if r["term"] >= 0:
            out[r["term"]] = r["n"]
    return out, sum(r["n"] for r in seen if r["term"] < 0)


@dataclass
class Model:
    weights: np.ndarray  # of the terms
    axes: np.ndarray  # TERMS x LATENT
    voters: np.ndarray  # normalised latent vectors
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        out = (np.log1p(counts) * self.weights) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The weighted share of good neighbours; a text without terms gets the share of good labels."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.latent(counts) @ self.voters.T
        k = min(NEIGHBOURS, len(self.labels))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-9), self.labels.mean())


def train(docs: DataFrame, labels: DataFrame, training: Column, bound: int = VOTERS) -> Model:
    """Fit on at most ``bound`` labelled documents for which ``training`` (over labels) holds."""
    frequency, n = document_frequencies(docs)
    weights = np.log((n + 1) / (frequency + 1)) + 1e-3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(0)):
                counts = term_matrix(data, offsets).astype(np.uint32).clip(0, 65_535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in counts], pa.binary()), batch.column(1).slice(first, len(counts))], ["counts", "label"])

    chosen = staged(sample(docs, labels, "quality", training, bound).mapInArrow(run, "counts binary, label int"), "voters").toPandas()
    if not len(chosen):
        return Model(weights.astype(np.float32), np.zeros((TERMS, LATENT), np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0))
    found = [np.frombuffer(x, dtype=np.uint16) for x in chosen["counts"]]
    gram, step = np.zeros((TERMS, TERMS), np.float32), 1_000
    for at in range(0, len(found), step):
        x = _normal(np.log1p(np.stack(found[at : at + step]).astype(np.float32)) * weights.astype(np.float32))
        gram += x.T @ x
    _, vectors = np.linalg.eigh(gram)
    model = Model(weights.astype(np.float32), np.ascontiguousarray(vectors[:, ::-1][:, :LATENT], dtype=np.float32), np.zeros(0), chosen["label"].to_numpy(float))
    model.voters = np.concatenate([model.latent(np.stack(found[at : at + step]).astype(np.float32)) for at in range(0, len(found), step)]).astype(np.float32)
    return model


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every whole text.

    Null and empty texts have no terms and get the share of good labels.  Rows
    are independent: repeated and null ids are kept, other columns ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.score(term_matrix(data, offsets)) for _, data, offsets in blocks(batch.column(1), 1 << 20)]
            p = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
