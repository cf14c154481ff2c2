import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from winnow.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def path(levels, i, arity):
    out = []
    for x in levels[:-1]:
        a = i // arity * arity
        out.append((x[a:i], x[i + 1 : a + arity]))
        i //= arity
    return out


def brute(rows, arity=3):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r) for r in by[s]], arity) for s in names}
    top = tree([trees[s][-1][0] for s in names], arity)
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i, arity) + path(top, k, arity)
            text = r[4]
            if text is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = leaf((*r[:4], text))
            for before, after in steps:
                fold = sha(*before, fold, *after)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(*[x for b, a in steps for x in b + a]), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_equals_brute_force(spark, arity):
    rng = random.Random(arity)
    sizes = {None: 2, "": 1, "a": 28, "é": 9, "hot": 100, "Z": 3, "z": 10}
    rows = [(rng.choice([None, *range(300)]), s, rng.choice([None, "", "en"]), rng.choice([None, 5]), rng.choice([None, "", "x\ny", "é\n", "plain"])) for s, n in sizes.items() for _ in range(n)]
    rows += [rows[60]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert sorted(map(tuple, merkle.manifest(docs, arity).collect()), key=repr) == brute(rows, arity)


def test_one_leaf_is_the_root(spark):
    rows = [(7, "s", None, 1, "a\nb")]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()
    assert list(map(tuple, got)) == brute(rows) and got[0]["root"] == got[0]["leaf"] and got[0]["proof_sha256"] == sha()


def test_odd_and_empty_tables(spark, odd, empty):
    rows = [tuple(r[c] for c in COLUMNS) for r in odd.collect()]
    assert sorted(map(tuple, merkle.manifest(odd).collect()), key=repr) == brute(rows)
    assert merkle.manifest(empty).count() == 0


def test_sources_are_numbered_across_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("v")).repartition(7)
    got = merkle.numbered(rows, ["g"], ["v"], "n").collect()
    for g in range(3):
        mine = sorted((r["place"], r["v"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
        assert {r["n"] for r in got if r["g"] == g} == {len(mine)}
