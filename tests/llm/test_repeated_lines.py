import hashlib
import random

import numpy as np
import pytest
from winnow.llm import repeated_lines

SPACE = " \t\n\v\f\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOW)


def brute(rows, chars=40, least=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders.setdefault(key(line), set()).add(i)
    keeper = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(seed=1):
    rng = random.Random(seed)
    hot = ["All rights reserved; é" + "x" * n + " and some more words here" for n in range(12)]
    out = []
    for i in range(60):
        lines = [rng.choice([" {}", "{}\r", "{}", "\t{}\v"]).format(rng.choice([h, h.upper().replace("É", "é")])) for h in rng.sample(hot, 3)]
        out.append((i, "\n".join(rng.sample([*lines, lines[0], "", "own line " + "y" * rng.randrange(60), f"n {i} " * 12], 6))))
    return [*out, (3, "again\n" + hot[0]), (7, None), (None, "\n".join(hot)), (None, hot[1]), (200, "\n".join(hot[:2]) + "\n\n"), (201, ""), (202, "\n")]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_equals_brute_force(spark, broadcast):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    got = repeated_lines.digests(repeated_lines.without_repeated_lines(docs, most_broadcast=broadcast))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows())


def test_holders_without_an_id_count_once(spark):
    line = "a line that is long enough to be a key of its own"
    data = [(None, line)] * 6 + [(i, line) for i in range(3)]
    got = repeated_lines.without_repeated_lines(spark.createDataFrame(data, "doc_id long, text string"))
    assert got.agg({"n_dropped": "sum"}).first()[0] == 0
    data += [(3, line), (3, line)]
    got = repeated_lines.without_repeated_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got if r["doc_id"] is not None) == [(0, 1), (1, 1), (2, 1), (3, 0), (3, 0)]
    assert [r["n_dropped"] for r in got if r["doc_id"] is None] == [1] * 6


def test_odd_rows_keep_their_columns(spark, odd, empty):
    got = repeated_lines.without_repeated_lines(odd)
    assert set(got.columns) == {*odd.columns, "n_lines", "n_dropped"}
    assert sorted(map(tuple, got.select(odd.columns).collect()), key=repr) == sorted(map(tuple, odd.collect()), key=repr)
    assert repeated_lines.without_repeated_lines(empty).count() == 0


@pytest.mark.parametrize("bits", [1 << 16, 1 << 22])
def test_the_filters_miss_no_repeat(spark, bits, monkeypatch):
    """Suspects hold every key met twice, whatever the filter's size and however the keys fall into parts."""
    monkeypatch.setattr(repeated_lines, "PART", 700)
    rng = np.random.default_rng(3)
    h1 = rng.integers(-(2**63), 2**63 - 1, 20_006)
    h1[::7] = h1[1::7]
    keys = spark.createDataFrame([(i, int(h), int(h) ^ 5) for i, h in enumerate(h1)], "doc_id long, h1 long, h2 long").repartition(6)
    seen = [(r["chunk"], r["bits"]) for r in repeated_lines._merged(repeated_lines._parts(keys, bits)).collect()]
    got = {r["doc_id"] for r in repeated_lines._suspects(keys, seen, bits).collect()}
    values, times = np.unique(h1, return_counts=True)
    again = set(np.flatnonzero(np.isin(h1, values[times > 1])).tolist())
    assert again <= got
    if bits == 1 << 22:
        assert len(got) < 1.02 * len(again)
