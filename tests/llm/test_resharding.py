import itertools
import os
import random

from pyspark.sql import functions as F

from winnow.llm import resharding


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(50):
        old = [rng.randrange(0, 50) for _ in range(rng.randrange(1, 6))]
        room = resharding.equal_capacities(sum(old), rng.randrange(1, 7))
        flow = resharding.min_cost_flow(old, room)
        assert [sum(r) for r in flow] == old
        assert all(sum(r[j] for r in flow) <= room[j] for j in range(len(room)))
        moved = sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j)
        assert moved == sum(old) - sum(min(a, b) for a, b in itertools.zip_longest(old, room, fillvalue=0))


def test_flow_follows_a_cost_table():
    price = [[1, 9], [1, 2]]
    flow = resharding.min_cost_flow([5, 5], [5, 5], lambda i, j: price[i][j])
    assert flow == [[5, 0], [0, 5]]


def test_documents(odd, empty):
    rows = resharding.reshard_documents(odd, 4).collect()
    assert len(rows) == odd.count()
    sizes = {s: [r for r in rows if r["shard"] == s] for s in range(4)}
    for members in sizes.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    assert all(r["size"] >= 16 and r["grown_shard"] is None and r["law"] == "bytes" for r in rows)
    assert resharding.reshard_documents(empty, 4).count() == 0


def test_equal_bytes_from_a_hot_shard(spark, monkeypatch):
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 50)
    rows = spark.range(2000).select("id", (F.lit(20) + F.pmod(F.xxhash64("id"), F.lit(30))).alias("size"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).cast("int").alias("old"))
    out = resharding.reshard(rows, 7, "size", "old", ["id"])
    got = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(got) == 7 and max(got) - min(got) < 7 * 50
    per = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("u")).collect()
    assert all(r["n"] == r["m"] + 1 == r["u"] for r in per)


def test_only_affected_shards_are_written(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit(10).cast("long").alias("size"), (F.when(F.col("id") < 50, 0).when(F.col("id") < 90, 1).otherwise(2)).cast("int").alias("old"))
    out = resharding.reshard(rows, 3, "size", "old", ["id"], capacities=[500, 250, 250])
    to = str(tmp_path / "new")
    assert resharding.rewrite_affected(out, "old", to) == [1, 2]
    assert sorted(x for x in os.listdir(to) if x.startswith("shard")) == ["shard=1", "shard=2"]
    assert spark.read.parquet(to).count() == 50
