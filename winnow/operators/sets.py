"""Unions, differences and capped unions of row sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.operators import joins
from winnow.settings import DEFAULTS, Settings
from winnow.sinks import files


def _suspects(hashes: DataFrame, name: str) -> DataFrame | None:
    """Hashes written once, so that they are joined by their real size; None if there are none."""
    some = files.stage(hashes.select("_key"), name)
    return None if some.isEmpty() else some


def once_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, like ``dropDuplicates``, for wide rows that seldom repeat.

    Only hashes of the keys move, and the rows whose hash comes more than once.
    """
    marked = rows.withColumn("_key", F.xxhash64(*keys))
    again = _suspects(marked.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "again")
    if again is None:
        return rows
    alone = marked.join(again, "_key", "left_anti")
    return alone.unionByName(marked.join(again, "_key", "left_semi").dropDuplicates(keys)).drop("_key")


def without(rows: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other set does not have; only hashes move, and the rows whose hash the other set has."""
    marked = rows.withColumn("_key", F.xxhash64(*keys))
    both = _suspects(marked.select("_key").distinct().join(taken.select(F.xxhash64(*keys).alias("_key")), "_key", "left_semi"), "taken")
    if both is None:
        return rows
    theirs = taken.withColumn("_key", F.xxhash64(*keys)).join(both, "_key", "left_semi").select(*keys)
    kept = marked.join(both, "_key", "left_semi").join(theirs, keys, "left_anti")
    return marked.join(both, "_key", "left_anti").unionByName(kept.select(*marked.columns)).drop("_key")


def minus_fingerprints(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows whose fingerprint the other set does not have."""
    return rows.join(taken.select("fingerprint").distinct(), "fingerprint", "left_anti")


def pseudo_limits(trusted_counts: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(label, limit): a share of each trusted class, from a one-row count frame."""
    ratio = min(0.5, max(0.0, s.max_pseudo_ratio))
    pairs = F.array(*[
        F.struct(F.lit(v).alias("label"), F.floor(F.col(v) * ratio).cast("bigint").alias("limit")) for v in fv.LABELS
    ])
    return trusted_counts.select(F.explode(pairs).alias("p")).select("p.*")


def cap_per_label(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """The first ``limit`` rows per label by fingerprint, without sorting a class in one task.

    Fingerprints are uniform hex, so counts per (label, first four digits) give
    the cut: whole buckets below it are kept, and only the one bucket the cut
    falls into is ranked.
    """
    tagged = rows.withColumn("_b", F.substring("fingerprint", 1, 4))
    counts = tagged.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("_n"))
    # at most 2 * 65,536 small rows
    w = Window.partitionBy("label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).join(limits, "label")
    state = before.select(
        "label", "_b", (F.col("limit") - F.col("_before")).alias("_room"), "_n"
    ).filter(F.col("_room") > 0)
    joined = tagged.join(F.broadcast(state), ["label", "_b"])  # bounded by the bucket count
    whole = joined.filter(F.col("_room") >= F.col("_n"))
    cut = joined.filter(F.col("_room") < F.col("_n"))
    r = Window.partitionBy("label", "_b").orderBy("fingerprint", "id")
    part = cut.withColumn("_r", F.row_number().over(r)).filter(F.col("_r") <= F.col("_room")).drop("_r")
    return whole.unionByName(part).drop("_b", "_room", "_n")


def union_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def retry_candidates(runs: DataFrame, f: DataFrame, ctx: DataFrame, a: DataFrame) -> DataFrame:
    """(run, position, finding): candidates still without a current adjudication, in list order."""
    listed = runs.select(
        F.col("id").alias("run_id"), "scan_id",
        F.posexplode(F.array_distinct(F.filter("candidate_finding_ids", lambda i: i > 0))).alias("position", "finding_id"),
    )
    open_ones = joins.unreviewed(f, ctx, a).select(F.col("id").alias("finding_id"), "scan_id")
    return listed.join(open_ones, ["finding_id", "scan_id"], "left_semi")
