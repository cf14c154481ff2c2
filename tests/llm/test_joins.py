"""The pair operators against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from winnow.llm import chosen_path, decontaminate, sparse_suffix
from winnow.llm.components import components
from winnow.llm.scan import blocks


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def corpus(rng, n=150, near=60):
    vocabulary = [f"t{i}" for i in range(500)]
    texts = {d: rng.choices(vocabulary, k=rng.choice([3, 7, 40, 160, 300])) for d in range(n)}
    for d in range(n, n + near):
        copy = list(texts[rng.randrange(n)] if d % 2 else texts[0])
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts[d] = copy
    passage = rng.choices(vocabulary, k=70)
    for d in range(0, n, 3):
        at = rng.randrange(len(texts[d]) + 1)
        texts[d] = texts[d][:at] + passage + texts[d][at:]
    return {d: " ".join(t) for d, t in texts.items()}


def brute_classes(texts, similar=0.8):
    sets = {d: shingles(t) for d, t in texts.items()}
    links, root = {d: 0 for d in texts}, {d: d for d in texts}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= similar * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (top(d), links[d]) for d in ids}


@pytest.mark.parametrize("limits", [{}, {"bucket": 4, "block_documents": 3}])
def test_classes_and_links_equal_brute_force(spark, limits):
    texts = corpus(random.Random(11)) | {900: "", 901: " \n", 902: "one two", 903: "One  two", 904: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.join(docs, **limits).collect()}
    assert got == brute_classes(texts)


def test_large_buckets_are_settled(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LEAF", 3)
    texts = corpus(random.Random(12), 30, 40)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.join(docs, bucket=1_000).collect()}
    assert got == brute_classes(texts)


def test_one_of_each_class(odd, empty):
    kept = chosen_path.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None and i not in (3, 4, 5)) == [1, 6, 8, 9, 10, 11]
    assert len([i for i in ids if i in (3, 4, 5, None)]) == 2  # one without words, and the one that lost its number
    assert chosen_path.one_of_each(empty).count() == 0
    assert chosen_path.join(odd).count() == odd.count()


def test_texts_of_one_id_are_nodes_of_their_own(spark):
    """One doc_id on different texts: links, classes, survivors and cuts are those of each text by itself."""
    rng = random.Random(5)
    a, b, c = (rng.choices([f"{x}{i}" for i in range(400)], k=180) for x in "abc")
    a2, b2 = [*a[:-1], "other"], [*b[:-1], "other"]
    rows = [(1, " ".join(x)) for x in (a, b)] + [(2, " ".join(a2)), (3, " ".join(b2)), (4, " ".join(c)), (1, " ".join(a)), (2, " ".join(c[:90] + a[:80]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(enumerate(t for _, t in rows))
    want = brute_classes(texts)
    first = {}
    for i, (cls, _) in want.items():
        first[cls] = min(first.get(cls, 9), rows[i][0])
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.join(docs).collect())
    assert got == sorted((rows[i][0], first[cls], n) for i, (cls, n) in want.items())
    kept = sorted(map(tuple, chosen_path.one_of_each(docs).collect()))
    assert kept == sorted([rows[0], rows[1], rows[4], rows[6]])
    passage = rng.choices([f"p{i}" for i in range(900)], k=100)
    texts = [(0, " ".join(passage + c)), (5, " ".join(passage + a)), (5, " ".join(b)), (5, " ".join(b))]
    left = sorted(map(tuple, sparse_suffix.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()))
    assert [(i, words(t)) for i, t in left] == sorted([(0, passage + c), (5, a), (5, b), (5, b)])


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for p in links for x in p}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for p in links if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, least=50):
    where = defaultdict(list)
    split = {d: words(t) for d, t in texts.items()}
    for d, w in split.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].append((d, i))
    again, later = ({d: [False] * len(w) for d, w in split.items()} for _ in range(2))
    for places in where.values():
        for d, i in places if len(places) > 1 else []:
            again[d][i : i + least] = [True] * least
            if (d, i) != min(places):
                later[d][i : i + least] = [True] * least
    return again, later


def test_repeats_equal_brute_force(spark):
    texts = corpus(random.Random(13)) | {900: "la " * 120, 901: "la " * 70, 902: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    again, later = brute_repeats(texts)
    got_again, got = ({d: [False] * len(words(t)) for d, t in texts.items()}, {d: 0 for d in texts})
    for r in sparse_suffix.repeats(docs).collect():
        got_again[r["doc_id"]][r["start_word"] : r["end_word"]] = [True] * (r["end_word"] - r["start_word"])
        got[r["doc_id"]] += r["removable_words"]
    assert got_again == again
    assert got == {d: sum(x) for d, x in later.items()}
    kept = {r["doc_id"]: words(r["text"]) for r in sparse_suffix.without_repeats(docs).collect()}
    for d, text in texts.items():
        left = [w for w, cut in zip(words(text), later[d]) if not cut]
        assert kept.get(d, []) == left


def test_repeats_of_odd_rows(odd, empty):
    found = {r["doc_id"]: r for r in sparse_suffix.repeats(odd).collect()}
    assert {1, 2, 8, 10} == set(found)
    assert (found[1]["removable_words"], found[2]["removable_words"], found[10]["removable_words"]) == (0, 400, 100)
    kept = sparse_suffix.without_repeats(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert sparse_suffix.repeats(empty).count() == 0
    assert sparse_suffix.without_repeats(empty).count() == 0


def test_items_are_found_as_by_brute_force(spark):
    rng = random.Random(17)
    texts = corpus(rng)
    items = {i: " ".join(rng.choices([f"t{k}" for k in range(500)], k=rng.choice([2, 4, 6, 20, 60, 200]))) for i in range(40)}
    for i, item in items.items():
        d, part = rng.randrange(100), item.split()
        if i % 3 == 0 and len(part) > 50:
            part[rng.randrange(len(part))] = "changed"
        texts[d] += " " + " ".join(part) + " tail"
    items |= {98: None, 99: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = set()
    for i, item in items.items():
        n = min(5, len(words(item)))
        known = shingles(item, n) if n else set()
        expected |= {(d, i) for d, t in texts.items() if known and len(known & shingles(t, n)) >= 0.8 * len(known)}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, benchmark).collect()}
    assert got == expected
    clean = {r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()}
    assert clean == set(texts) - {d for d, _ in expected}


def test_items_in_blocks(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 1)
    benchmark = spark.createDataFrame([(1, "two"), (2, "w5 w6 w7 w8 w9 w10 w11"), (None, "nowhere to be found in any of them")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(odd, benchmark).collect()} == {(1, 2), (2, 2), (6, 1), (7, 1)}
    assert decontaminate.clean(odd, benchmark).columns == odd.columns
    assert decontaminate.find(empty, benchmark).count() == 0
    assert decontaminate.find(odd, benchmark.limit(0)).count() == 0


def found_in(items, texts):
    index = decontaminate.build(list(range(len(items))), items)
    return {(first + r, i): c for first, data, offsets in blocks(pa.array(texts), fold=True) for r, i, c in decontaminate.search(index, data, offsets)}


@pytest.mark.parametrize("inserted", [20, 30, 200, 3000])
def test_items_split_by_inserted_text_are_found_at_every_offset(inserted, monkeypatch):
    monkeypatch.setattr(decontaminate, "COUNTED", 100)
    item = [f"i{k}" for k in range(36)]
    split = item[:18] + [f"x{k}" for k in range(inserted)] + item[18:]
    texts = [" ".join([f"y{k}" for k in range(offset)] + split + ["tail"] * 40) for offset in range(64)]
    assert found_in([" ".join(item), "i0 i1 i2 i3 i4 and then quite another end"], texts) == {(r, 0): 28 / 32 for r in range(64)}


@pytest.mark.parametrize("length", [1, 2, 4, 5, 6, 7, 9])
def test_short_items_are_found_wherever_they_are(length):
    items = [" ".join(f"i{n}x{k}" for k in range(length)) for n in range(400)]
    texts = [" ".join([f"y{n}x{k}" for k in range(before)] + [item] + [f"z{n}x{k}" for k in range(60)]) for before in (0, 3, 37) for n, item in enumerate(items)]
    assert found_in(items, texts) == {(part * 400 + n, n): 1.0 for part in range(3) for n in range(400)}


@pytest.mark.parametrize("records", range(1, 9))
def test_batches_that_end_with_a_bucket(records):
    sizes = [2, 3, 2, 2, 1, 4, 6, 2, 5, 2]
    rows = pa.record_batch({"path": [p for p, n in enumerate(sizes) for _ in range(n)]})
    got = list(chosen_path._pieces(rows.slice(at, records) for at in range(0, rows.num_rows, records)))
    assert [p for table in got for p in table["path"].to_pylist()] == rows["path"].to_pylist()
    assert sum(len(set(table["path"].to_pylist())) for table in got) == len(sizes)


@pytest.mark.parametrize("recall", [0.9, 0.999, 0.99999])
def test_roots_drawn_reach_the_recall(recall):
    roots = chosen_path._roots(chosen_path.runs_for(recall), 0.8)
    below = 1 - math.exp(-(1 - math.exp(-1)))  # two more levels
    missed = math.prod(0.2 + 0.8 * (1 - below) ** n for n in Counter(place for _, place in roots).values())
    assert missed <= 1 - recall
