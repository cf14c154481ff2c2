"""The operators of this subpackage as named queries over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from winnow.llm import (
    bpe_tree,
    chosen_path,
    coin_tossing,
    decontaminate,
    frames,
    lattice,
    merkle,
    quality_votes,
    quotes,
    repeated_lines,
    resharding,
    sparse_suffix,
    toxic_segments,
)
from winnow.llm.scan import fold, read, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


@query
def op8_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard_documents(read(spark, sf_dir, "documents"), 40)


@query
def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxic_segments.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxic_segments.score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_segments")


@query
def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_votes.train(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return quality_votes.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op4_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = lattice.score(docs, fold("doc_id", 5) != 1, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumn("held_out", fold("doc_id", 5) == 1)


@query
def op1_coin_tossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coin_tossing.with_edits(read(spark, sf_dir, "documents"))


@query
def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(read(spark, sf_dir, "documents"))


@query
def op9_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeats(read(spark, sf_dir, "documents"))


@query
def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(read(spark, sf_dir, "conversations"))


ORACLES["op3_quotation_linking"] = quotes.CONVERSATIONS_SQL


@query
def op11_compressed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as frames in the shared folder, then cut and rearranged from there."""
    return frames.transformed(staged(frames.stored(read(spark, sf_dir, "documents")), "frames"))


@query
def op12_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the documents without repeated lines."""
    return repeated_lines.digests(repeated_lines.without_repeated_lines(read(spark, sf_dir, "documents")))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and which tampered ones fail."""
    return merkle.manifest(read(spark, sf_dir, "documents"))


ORACLES["op11_compressed_frames"] = frames.FIM_SQL
ORACLES["op12_bloom_lines"] = repeated_lines.LINES_SQL
ORACLES["op13_merkle_manifest"] = merkle.MANIFEST_SQL
