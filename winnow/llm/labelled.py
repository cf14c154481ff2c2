"""Bounded samples of labelled rows to fit a classifier on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows a classifier is fitted on at most; the only bound in the two classifiers
SAMPLE_ROWS = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, bound: int = SAMPLE_ROWS) -> DataFrame:
    """_text and _label of at most ``bound`` labelled training documents, chosen by a hash of the id.

    Labels of null ids and null labels are left out; a document labelled twice
    counts as 1 if any of its labels is.  The chosen ids (at most ``bound``)
    are broadcast, so no text is shuffled.
    """
    return _texts(docs, _first(_labels(labels, label, training), bound))


def sample_each(docs: DataFrame, labels: DataFrame, label: str, training: Column, bound: int = SAMPLE_ROWS) -> tuple[DataFrame, float]:
    """The same of either class by itself, and what to add to log odds fitted on it.

    The class with fewer documents is whole up to half of ``bound``, the other
    fills the rest; so the odds in the sample are not those among the labels.
    """
    chosen = _labels(labels, label, training)
    ones = F.col("_label") == 1
    n = {r["one"]: r["count"] for r in chosen.groupBy(ones.alias("one")).count().collect()}
    one, other = n.get(True, 0), n.get(False, 0)
    of_one = min(one, max(bound // 2, bound - other))
    of_other = min(other, bound - of_one)
    shift = math.log(one / of_one) - math.log(other / of_other) if of_one and of_other else 0.0
    return _texts(docs, _first(chosen.where(ones), of_one).unionByName(_first(chosen.where(~ones), of_other))), shift


def _labels(labels: DataFrame, label: str, training: Column) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & training).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))


def _first(chosen: DataFrame, bound: int) -> DataFrame:
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(chosen), "doc_id").select("_text", "_label")
