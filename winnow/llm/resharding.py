"""Resharding by minimum-cost flow.

Old shard sizes and new capacities form a transport problem: a byte that stays
costs nothing, a byte that moves costs one (or what a cost table says).  The
driver solves it over shards alone (a few dozen numbers); the rows then follow
the flow in Spark.  An old shard is a line of its rows, cut into blocks of
about ``BLOCK_ROWS`` rows by hash, so a shard holding a third of all rows is
many tasks.  Its few large rows come first, in the part that stays if they fit,
so that cuts fall between small ones.  A row goes where the middle of its bytes
falls on that line: a new shard misses its capacity by less than one row per
transfer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnow.llm.scan import staged

BLOCK_ROWS = 8_192
#: a row above this share of a new shard is large; so a table has at most shards times so many of them
LARGE_ROWS = 1_000


def min_cost_flow(supply: list[int], capacity: list[int], cost=None) -> list[list[int]]:
    """Units sent from every source to every sink at least cost; by default only staying (same index) is free.

    Successive cheapest augmenting paths over the residual network of shards.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than what has to be placed")
    m, n = len(supply), len(capacity)
    price = [[(cost(i, j) if cost else int(i != j)) for j in range(n)] for i in range(m)]
    flow = [[0] * n for _ in range(m)]
    left, room = list(supply), list(capacity)
    while any(left):
        reach: list[float] = [0 if x else float("inf") for x in left] + [float("inf")] * n
        came = [-1] * (m + n)
        changed = True
        while changed:
            changed = False
            for i in range(m):
                for j in range(n):
                    if reach[i] + price[i][j] < reach[m + j]:
                        reach[m + j], came[m + j], changed = reach[i] + price[i][j], i, True
                    if flow[i][j] and reach[m + j] - price[i][j] < reach[i]:
                        reach[i], came[i], changed = reach[m + j] - price[i][j], m + j, True
        sink = min((j for j in range(n) if room[j]), key=lambda j: reach[m + j])
        path, at = [], m + sink
        while came[at] >= 0:
            path.append((came[at], at))
            at = came[at]
        units = min([left[at], room[sink]] + [flow[b][a - m] for a, b in path if a >= m])
        for a, b in path:
            if a < m:
                flow[a][b - m] += units
            else:
                flow[b][a - m] -= units
        left[at] -= units
        room[sink] -= units
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _target(flow: list[list[int]], old: Column, middle: Column) -> Column:
    """The new shard of a position on its old shard's line: what stays first, then every transfer."""
    rows = []
    for i, sent in enumerate(flow):
        end, cuts = 0, []
        for j in sorted(range(len(sent)), key=lambda j: (j != i, j)):
            if sent[j]:
                end += sent[j]
                cuts.append(F.struct(F.lit(end).cast("long").alias("end"), F.lit(j).alias("to")))
        if cuts:
            rows += [F.lit(i), F.array(*cuts)]
    lines = F.create_map(*rows)
    return F.filter(F.element_at(lines, old), lambda c: c["end"] > middle)[0]["to"]


def reshard(rows: DataFrame, shards: int, size: str, old: str, order: list[str], capacities: list[int] | None = None, cost=None) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    ``old`` holds the present shard (0 and up, int), ``size`` the bytes of a row
    (positive, long), ``order`` the columns that order rows within a block; rows
    equal in all of them are interchangeable.  Without ``capacities`` all new
    shards get the same number of bytes.  Null values in ``order`` come first;
    an empty table stays empty.  The frame is read several times: stage it if it
    is dear.
    """
    spark = rows.sparkSession
    totals = {r["o"]: (r["n"], r["b"]) for r in rows.groupBy(F.col(old).alias("o")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect()}
    if not totals:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    supply = [totals.get(i, (0, 0))[1] for i in range(max(totals) + 1)]
    flow = min_cost_flow(supply, capacities or equal_capacities(sum(supply), shards), cost)
    counts = F.create_map(*[x for i, (n, _) in totals.items() for x in (F.lit(i), F.lit(-(-n // BLOCK_ROWS)).cast("long"))])
    large = sum(supply) // (shards * LARGE_ROWS) + 1
    cut = rows.withColumn("_block", F.when(F.col(size) > large, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*order), F.element_at(counts, F.col(old)))))
    pieces = cut.groupBy(old, "_block").agg(F.sum(size).alias("_bytes"))
    line = W.partitionBy(old).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(old, "_block", F.coalesce(F.sum("_bytes").over(line), F.lit(0)).alias("_from"))
    within = W.partitionBy(old, "_block").orderBy(*order, size)
    placed = cut.join(pieces, [old, "_block"]).withColumn("_before", F.coalesce(F.sum(size).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    middle = F.col("_from") + F.col("_before") + F.expr(f"{size} div 2")
    placed = staged(placed.withColumn("shard", _target(flow, F.col(old), middle)).withColumn("_nth", F.row_number().over(W.partitionBy(old, "_block", "shard").orderBy("_before", *order))), "placed")
    runs = placed.groupBy("shard", old, "_block").agg(F.count(F.lit(1)).alias("_n"))
    runs = runs.select("shard", old, "_block", F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy(old, "_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    out = placed.join(runs, ["shard", old, "_block"])
    return out.withColumn("slot", F.col("_first") + F.col("_nth") - 1).select(*rows.columns, "shard", "slot")


def rewrite_affected(assigned: DataFrame, old: str, to: str) -> list[int]:
    """Write the new files of every shard that gains or loses rows, below ``to``; returns those shards.

    Shards that keep exactly their rows are left alone.  A shard is written by
    as many tasks as it has blocks, so a large one does not wait for one task.
    """
    moved = assigned.where(F.col(old) != F.col("shard"))
    touched = moved.select(F.explode(F.array(old, "shard")).alias("s")).distinct()
    affected = sorted(r["s"] for r in touched.collect())
    kept = assigned.where(F.col("shard").isin(affected))
    kept.repartition("shard", F.expr(f"slot div {BLOCK_ROWS}")).write.mode("overwrite").partitionBy("shard").parquet(to)
    return affected


def document_sizes(docs: DataFrame, old_shards: int) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16; a null text has none), text_crc32, and the shard a source's documents lie in now."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(old_shards)).cast("int").alias("old_shard"),
    )


def reshard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All documents, moved from shards by source to ``shards`` shards of equal bytes.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under
    this law) and old_shard.  Null texts have size 16, null sources are one
    source, repeated rows are placed one by one.
    """
    known = staged(document_sizes(docs, shards), "sizes")
    out = reshard(known, shards, "size", "old_shard", ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


