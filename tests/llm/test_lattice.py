import math
import re
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from winnow.llm import lattice
from winnow.llm.scan import Words


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces([b"", b"a", b"ab", b"b"], [b"a", b"b", b"ab", b"ba", b"c"], np.log([0.1, 0.4, 0.3, 0.2]), np.log([0.1, 0.1, 0.1, 0.1, 0.1, 0.5]))


def brute(pieces, word):
    first, then = dict(zip(pieces.first, np.exp(pieces.log_first))), dict(zip(pieces.then, np.exp(pieces.log_then)))
    stop = math.exp(pieces.log_then[-1])

    def rest(w):
        return stop * (w == b"") + sum(p * rest(w[len(t) :]) for t, p in then.items() if w.startswith(t))

    return sum(p * rest(word[len(t) :]) for t, p in first.items() if word.startswith(t)) / (1 - first[b""] * stop)


def forward(pieces, words, weights=None):
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    w = Words(data, np.array([0, len(data)]))
    return lattice.forward(pieces, data, w.starts, w.ends, weights)


def test_all_segmentations_count(pieces):
    words = [b"a", b"abba", b"ababab", b"c", b"bacab", b"aab"]
    assert np.exp(forward(pieces, words)[0]) == pytest.approx([brute(pieces, w) for w in words])


def test_words_have_probability_one_in_all(pieces):
    total, words = 0.0, [b""]
    for _ in range(9):
        words = [w + x for w in words for x in (b"a", b"b", b"c")]
        total += np.exp(forward(pieces, words)[0]).sum()
    assert 0.97 < total < 1


def test_expected_uses_raise_the_likelihood(pieces):
    words, weights = [b"abab", b"ba", b"cab"], np.array([5.0, 2.0, 1.0])
    before, first, then = forward(pieces, words, weights)
    assert first.sum() == pytest.approx(8) and then[-1] == pytest.approx(8)
    again = lattice.Pieces(pieces.first, pieces.then, np.log((first + 1e-9) / (first + 1e-9).sum()), np.log((then + 1e-9) / (then + 1e-9).sum()))
    assert (forward(again, words)[0] * weights).sum() > (before * weights).sum()


def test_long_words_are_words_too(pieces, monkeypatch):
    words, weights = [b"abba" * 20, b"c" * 30, b"ab"], np.array([1.0, 2.0, 3.0])
    want = forward(pieces, words, weights)
    monkeypatch.setattr(lattice, "LONG", 5)
    got = forward(pieces, words, weights)
    assert all(np.allclose(a, b) for a, b in zip(want, got))


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [None]


@pytest.mark.parametrize("head", [1 << 21, 4])
def test_base_scores(odd, empty, monkeypatch, head):
    monkeypatch.setattr(lattice, "HEAD", head)
    training = F.col("doc_id").isNull() | (F.col("doc_id") % 2 == 0)
    path = public.path("piece_bpe_32k.model")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    counts = Counter(t for d, text in rows if d is None or d % 2 == 0 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    got = lattice.score(odd, training, path).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and r["score"] >= r["lattice_score"] - 25 * r["n_tokens"] for r in got)
    assert lattice.score(empty, training, path).count() == 0


def test_nothing_to_learn_from(odd):
    rows = lattice.score(odd, F.lit(False), public.path("piece_bpe_32k.model")).collect()
    assert len(rows) == odd.count()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)
