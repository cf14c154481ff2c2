import inspect

import corpus_pipeline
import duckdb
from winnow.llm.queries import QUERIES

from tests.llm.test_joins import brute_classes, words

SMALL = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    classes = brute_classes(texts)
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (c, _) in classes.items() if c == d)
    clean = corpus_pipeline.toxicity(spark, docs, SMALL)
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{SMALL}/labels.parquet'").fetchall())
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns
    assert sum(d not in left for d, t in labels.items() if t == 0) <= 2


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert 100 < len(out) < len(texts)
    assert len({r["doc_id"] for r in out}) == len(out)
    assert all(0 < r["n_tokens"] == len(r["ids"]) <= 4 * len(words(texts[r["doc_id"]])) * 20 for r in out)
