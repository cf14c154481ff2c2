"""Toxicity as significant maximum-scoring segments.

Every word has a log-odds ratio between toxic and other training documents with
an informative Dirichlet prior (the word's share of all training words).  Its
score is the end of the 99.9 % interval nearer to zero, less a drift that makes a
clean text fall.  A linear scan over a text's scores finds all maximal segments;
a segment of score S among n words has extreme-value significance
1 - exp(-K n exp(-lambda S)), where lambda solves sum q exp(lambda s) = 1 over
the words of clean texts and K is the likeliest value on clean training texts.
A document's statistic is the sum of the normalised scores of its significant
segments; a logistic curve fitted on training documents makes it a probability.

Words are runs of letters, bytes above 127 being letters.  A word's
first ``PREFIX`` bytes, counted over all words that begin so, have a score too;
the surer of the two, that further from zero, counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.labelled import SAMPLE_ROWS, sample_each
from winnow.llm.scan import BYTE_VALUES, NON_LETTERS, Lookup, Words, blocks, release, span_hashes, staged

DRIFT = 0.2
PRIOR_SHARE = 0.1
Z = 1.96
SIGNIFICANT = 0.05
MAX_TERMS = 100_000
PREFIX = 6
#: log odds at most where one class of labels has no words: those of one clean row
UNTAUGHT = -math.log(3)
_PREFIXED = np.uint64(0x5DEECE66D)


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    scores: np.ndarray  # their log odds, shrunk; 0 for all other words
    scale: float = 1.0  # lambda
    k: float = 1.0
    intercept: float = 0.0
    slope: float = 0.0
    lookup: Lookup | None = None

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if self.lookup is None:
            self.lookup = Lookup(self.terms)
        at = self.lookup(hashes)
        return np.where(at >= 0, self.scores[at], 0.0)


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their beginnings."""
    values = BYTE_VALUES[words.data]
    return span_hashes(values, words.starts, words.ends), span_hashes(values, words.starts, np.minimum(words.starts + PREFIX, words.ends)) ^ _PREFIXED


def _counts(rows: DataFrame) -> DataFrame:
    """term (hash), toxic, other: occurrences in the labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in blocks(batch.column(0)):
                words = Words(data, offsets, NON_LETTERS)
                if not len(words.starts):
                    continue
                terms, at = np.unique(np.concatenate(_terms(words)), return_inverse=True)
                toxic = np.bincount(at, weights=np.tile(labels[first + words.row_of()] == 1, 2), minlength=len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(terms)) - toxic)], ["term", "toxic", "other"])

    return rows.mapInArrow(run, "term long, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score) of one text, in linear time."""
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # [sum before, sum after, first, past the last]
    for i in places.tolist():
        left, right, first = sums[i], sums[i + 1], i
        last = i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append([left, right, first, last])
                break
            left, first = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, float(r - x)) for x, r, a, b in found]


def _scan(model: Model, column: pa.Array, spans: bool) -> tuple[np.ndarray, ...]:
    """Per row: words, statistic, highest segment score, number of significant segments; and the segments if asked."""
    n, statistic, top, number = (np.zeros(len(column)) for _ in range(4))
    passages: list[list] = [[] for _ in range(len(column))]
    for first, data, offsets in blocks(column):
        words = Words(data, offsets, NON_LETTERS)
        n[first : first + words.rows] = words.counts
        if not len(words.starts) or not len(model.terms):
            continue
        own, begin = _terms(words)
        scores, of_begin = model.of(own), model.of(begin)
        scores = np.where(np.abs(of_begin) > np.abs(scores), of_begin, scores) - DRIFT
        for r in np.unique(words.row_of()[scores > 0]).tolist():
            lo, hi = words.bounds[r], words.bounds[r + 1]
            for a, b, score in segments(scores[lo:hi]):
                top[first + r] = max(top[first + r], score)
                normal = model.scale * score - math.log(max(model.k * (hi - lo), 1e-300))
                p = -math.expm1(-math.exp(min(-normal, 700)))
                if p <= SIGNIFICANT:
                    statistic[first + r] += normal
                    number[first + r] += 1
                    if spans:
                        text = data[offsets[r] : offsets[r + 1]].tobytes()
                        s, e = words.starts[lo + a] - offsets[r], words.ends[lo + b - 1] - offsets[r]
                        passages[first + r].append({"start": len(text[:s].decode()), "end": len(text[:e].decode()), "score": score, "p_value": p})
    return n, statistic, top, number, passages


def fit(rows: DataFrame, shift: float = 0.0) -> Model:
    """A model from ``_text`` and ``_label`` rows; their number is the caller's bound, so are the words gathered.

    ``shift`` is added to the log odds.  Without words of both classes nothing
    tells texts apart: all have the smoothed base rate, and none is predicted
    toxic, not even if all rows are or if there are none.
    """
    counts = _counts(rows)
    totals = counts.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    nt, no = float(totals["t"] or 0) / 2, float(totals["o"] or 0) / 2  # each word counts itself and its beginning
    if not nt or not no:
        n = rows.agg(F.count_if(F.col("_label") == 1).alias("toxic"), F.count_if(F.col("_label") != 1).alias("other")).first()
        base = math.log((n["toxic"] + 0.5) / (n["other"] + 0.5)) + shift
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), intercept=min(base, UNTAUGHT))
    total, prior = nt + no, PRIOR_SHARE * (nt + no)
    alpha = prior * (F.col("toxic") + F.col("other")) / total
    a, b = F.col("toxic") + alpha, F.col("other") + alpha
    odds = F.log(a / (nt + prior - a)) - F.log(b / (no + prior - b))
    error = F.sqrt(1 / a + 1 / b)
    kept = counts.select("term", odds.alias("odds"), error.alias("error"), (b / (no + prior)).alias("q")).where(F.abs("odds") > Z * F.col("error"))
    table = kept.orderBy(F.desc(F.abs(F.col("odds") / F.col("error"))), "term").limit(MAX_TERMS).toPandas()
    shrunk = np.sign(table["odds"]) * (table["odds"].abs() - Z * table["error"])
    terms = table["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(terms)
    model = Model(terms[order], shrunk.to_numpy()[order])
    model.scale = _scale(model.scores, table["q"].to_numpy()[order])
    seen = rows.mapInArrow(_statistics(model), "label int, n double, statistic double, top double").toPandas()
    clean = seen[(seen["label"] == 0) & (seen["n"] > 0)]
    weight = float((clean["n"] * np.exp(-model.scale * clean["top"])).sum())
    model.k = len(clean) / weight if weight else 1.0
    seen = rows.mapInArrow(_statistics(model), "label int, n double, statistic double, top double").toPandas()
    model.intercept, model.slope = _logistic(seen)
    model.intercept += shift
    return model


def _statistics(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, statistic, top, _, _ = _scan(model, batch.column(0), False)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x) for x in (n, statistic, top))], ["label", "n", "statistic", "top"])

    return run


def _scale(scores: np.ndarray, q: np.ndarray) -> float:
    """The positive root of sum q exp(lambda s) = 1 for the scores of clean words, drift included."""
    rest = max(0.0, 1 - q.sum())

    def over(x: float) -> float:
        return float((q * np.exp(np.minimum(x * (scores - DRIFT), 700))).sum()) + rest * math.exp(-x * DRIFT) - 1

    if not (scores > DRIFT).any():
        return 1.0
    high = 1e-3
    while over(high) < 0 and high < 1e3:
        high *= 2
    low = 0.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) < 0 else (low, middle)
    return high


def _logistic(seen: pd.DataFrame) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge, so that separable data end too."""
    x, y = np.log1p(seen["statistic"].to_numpy()), (seen["label"] == 1).to_numpy(float)
    design, at = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (y - p) - 1e-2 * at
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), slope)
        at = at + step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def score(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, score, predicted, n_segments of every whole text; with ``spans`` also the passages (code points).

    A null or empty text has no segment and so the score of a text without
    toxic words.  Rows are independent: repeated and null ids are kept.  The
    model holds at most ``MAX_TERMS`` words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            _, statistic, _, number, passages = _scan(m, batch.column(1), spans)
            p = 1 / (1 + np.exp(-np.clip(m.intercept + m.slope * np.log1p(statistic), -30, 30)))
            columns = [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(number.astype(np.int32))]
            if spans:
                columns.append(pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "score", "predicted", "n_segments"] + ["passages"] * spans
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_segments int" + ", passages array<struct<start:int,end:int,score:double,p_value:double>>" * spans
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, training: Column, bound: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``bound`` labelled documents for which ``training`` (over labels) holds, rare toxic ones always among them."""
    rows, shift = sample_each(docs, labels, "toxic", training, bound)
    return fit(staged(rows, "toxic-sample"), shift)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents not predicted toxic, all columns kept.

    Only the text goes to Python and one bit comes back, in the scanning tasks.
    Null, empty and wordless texts have no toxic segment and are judged by the
    model's intercept alone; repeated rows are judged alike; texts may be of any
    length; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        m = shared.value
        _, statistic, _, _, _ = _scan(m, texts, False)
        release()
        return pa.array(m.intercept + m.slope * np.log1p(statistic) < 0)

    return docs.where(kept(F.col("text")))
