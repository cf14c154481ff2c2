import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import quality_votes, toxic_segments
from winnow.llm.scan import fold


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    plain, nasty = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)], ["vile", "rotten", "filthy"]
    docs, labels = [], []
    for d in range(400):
        words = rng.choices(plain, k=rng.randrange(20, 120))
        toxic, junk = d % 5 == 0, d % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(nasty))
        if junk:
            words = [f"{w}%%%" for w in words] if d % 8 else [words[0]] * 80 + words[-10:]
        docs.append((d, " ".join(words)))
        labels.append((d, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def brute_segments(scores):
    """All maximal segments by their definition: recursively the best one, then left and right of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    sums = np.concatenate([[0], np.cumsum(scores)])
    best = max(((sums[b] - sums[a], -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    a = -best[2]
    b = a - best[1]
    return brute_segments(scores[:a]) + [round(float(best[0]), 9)] + brute_segments(scores[b:])


def test_segments_equal_their_definition():
    rng = np.random.default_rng(2)
    for _ in range(100):
        scores = rng.normal(-0.3, 1, rng.integers(1, 25))
        assert [round(s, 9) for _, _, s in toxic_segments.segments(scores)] == brute_segments(scores)


def test_toxic_documents_are_found(labelled, odd, empty):
    docs, labels = labelled
    model = toxic_segments.train(docs, labels, fold("doc_id", 5) != 0)
    scored = toxic_segments.score(docs, model, spans=True).join(labels, "doc_id").where(fold("doc_id", 5) == 0).collect()
    assert sum(r["predicted"] == r["toxic"] for r in scored) / len(scored) > 0.95
    texts = dict(docs.collect())
    for r in scored:
        for p in r["passages"]:
            assert texts[r["doc_id"]][p["start"] : p["end"]].strip("%")
    assert toxic_segments.score(odd, model).count() == odd.count()
    assert toxic_segments.score(empty, model).count() == 0
    assert toxic_segments.accepted(odd, model).columns == odd.columns
    assert toxic_segments.accepted(odd, model).count() == odd.count()


def test_quality_votes_equal_brute_force(labelled, odd, empty):
    docs, labels = labelled
    model = quality_votes.train(docs, labels, fold("doc_id", 3) != 1)
    held = quality_votes.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 3) == 1).collect()
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    text = docs.first()["text"].encode()
    counts = quality_votes.term_matrix(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    near = model.voters @ model.latent(counts)[0]
    best = np.argsort(-near, kind="stable")[: quality_votes.NEIGHBOURS]
    weight = np.maximum(near[best], 0) ** quality_votes.SHARPNESS
    assert model.score(counts)[0] == pytest.approx((weight * model.labels[best]).sum() / weight.sum(), abs=1e-3)
    assert quality_votes.score(odd, model).where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    assert quality_votes.score(odd, model).count() == odd.count()
    assert quality_votes.score(empty, model).count() == 0


def test_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_votes.score(odd, quality_votes.train(odd, none, F.lit(True))).count() == odd.count()
    assert toxic_segments.score(odd, toxic_segments.train(odd, none, F.lit(True))).where("predicted = 1").count() in (0, odd.count())


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_one_class_of_labels_drops_no_document(spark, odd, toxic):
    labels = spark.createDataFrame([] if toxic is None else [(d, 1, toxic) for d in (1, 2, 6, 10)], "doc_id long, quality int, toxic int")
    model = toxic_segments.train(odd, labels, F.lit(True))
    assert toxic_segments.accepted(odd, model).count() == odd.count()
    assert toxic_segments.score(odd, model).where("predicted = 1 or score >= 0.5").count() == 0


def test_rare_toxic_labels_are_learnt(labelled):
    docs, labels = (df.where("doc_id % 5 <> 0 or doc_id % 80 = 0") for df in labelled)
    assert labels.where("toxic = 1").count() == 5
    model = toxic_segments.train(docs, labels, F.lit(True), bound=60)
    kept = {r["doc_id"] for r in toxic_segments.accepted(docs, model).collect()}
    assert not kept & set(range(0, 400, 80))
    assert len(kept) >= 315  # of 320
