import hashlib
import random

import numpy as np

from winnow.llm import coin_tossing as ct


def test_equal_substrings_share_phrases_wherever_they_lie():
    rng = random.Random(4)
    body = "".join(rng.choice("etaoinshr ") for _ in range(3000))
    for shift in (1, 2, 3, 7, 50):
        front = "".join(rng.choice("etaoinshr ") for _ in range(shift))
        assert ct.likeness(ct.sketch([body]), ct.sketch([front + body]))[0] > 0.8
    other = "".join(rng.choice("etaoinshr ") for _ in range(3000))
    assert ct.likeness(ct.sketch([body]), ct.sketch([other]))[0] < 0.1


def test_phrases_do_not_depend_on_the_block():
    texts = ["a" * 500, "", "abcabcabc" * 40, "x", "été " * 30, "the quick brown fox jumps"]
    together = ct.sketch(texts)
    assert all((together[i] == ct.sketch([t])[0]).all() for i, t in enumerate(texts))
    assert (together[1] == 0xFFFF).all()
    assert all((together[i] != 0xFFFF).any() for i, t in enumerate(texts) if t)


def test_every_phrase_is_named_by_its_symbols():
    rng = np.random.default_rng(1)
    symbols = rng.integers(97, 100, 2000).astype(np.uint32)
    for names, rows, lengths, _ in ct.parse(symbols, np.zeros(2000, dtype=np.int64)):
        assert lengths.sum() == 2000
        where = {}
        ends = np.cumsum(lengths)
        for name, a, b in zip(names.tolist(), (ends - lengths).tolist(), ends.tolist()):
            part = symbols[a:b].tobytes()
            assert where.setdefault(name, part) == part


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        k = len(text) // 4
        out.append((i, len(text), hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()))
    return out


def test_edited_texts(spark, odd, empty, monkeypatch):
    key = lambda r: (r[0] is not None, *map(str, r))
    got = [tuple(r)[:3] for r in ct.with_edits(odd).collect()]
    assert sorted(got, key=key) == sorted(expected([(r["doc_id"], r["text"]) for r in odd.collect()]), key=key)
    monkeypatch.setattr(ct, "RANGE_BYTES", 2000)
    monkeypatch.setattr(ct, "BLOCK_CHARS", 300)
    rng = random.Random(9)
    rows = [(rng.randrange(10_000) * 7, "".join(rng.choice("abc é🙂") for _ in range(rng.randrange(200)))) for _ in range(300)]
    docs = spark.createDataFrame(list(dict(rows).items()), "doc_id long, text string")
    out = ct.with_edits(docs).collect()
    assert sorted((tuple(r)[:3] for r in out), key=key) == sorted(expected(list(dict(rows).items())), key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    alone = ct.with_edits(docs.limit(1)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert ct.with_edits(empty).count() == 0
    prints = {r["doc_id"]: r["fingerprint"] for r in ct.fingerprints(docs).collect()}
    assert all(prints[r["doc_id"]] == r["fingerprint"] for r in out)
