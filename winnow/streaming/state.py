"""Current state from append-only logs.  Every function works on batch frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.operators import metrics
from winnow.settings import DEFAULTS, Settings


def newest(order: list[str], payload: list[str]) -> Column:
    """Payload of the newest event; a struct maximum, so it combines early and keeps constant state."""
    return F.max(F.struct(*order, *[p for p in payload if p not in order]))


def latest_by_key(log: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Newest event per key; runs on batch and on streaming frames alike."""
    best = log.groupBy(*keys).agg(newest(order, payload).alias("_n"))
    return best.select(*keys, *[F.col(f"_n.{c}").alias(c) for c in dict.fromkeys([*order, *payload])])


def decision_state(log: DataFrame) -> DataFrame:
    """Last label or undo per finding; heartbeats say nothing about the label."""
    acts = log.filter(F.col("action").isin("label", "undo"))
    return latest_by_key(acts, ["finding_id"], ["decided_at", "event_id"], ["action", "label", "rule_id"])


def current_decisions(state: DataFrame) -> DataFrame:
    """Findings that carry a label now; an undo removes label and feedback."""
    return state.filter(F.col("action") == "label").select("finding_id", "label", "rule_id", "decided_at", "event_id")


def touched_rules(batch: DataFrame) -> DataFrame:
    """Rules whose statistics a batch may change, undo included."""
    return batch.filter(F.col("action").isin("label", "undo")).select("rule_id").distinct()


def refresh_rules(current: DataFrame, touched: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Statistics of the touched rules only; a rule that lost all labels goes to zero."""
    kept = current.join(touched, "rule_id", "left_semi").withColumn("final_label", F.col("label"))
    stats = metrics.stats_of_labels(kept, s)
    return touched.join(stats, "rule_id", "left").fillna(
        0, subset=["total_seen", "total_false_positive", "historical_fp_rate"])


def retrain_due(f: DataFrame, states: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row: labels changed since the last training attempt, and whether that is enough."""
    last = states.agg(F.max("trained_at")).scalar()
    fresh = last.isNull() | (F.col("updated_at") > last)
    return f.filter(F.col("final_label").isNotNull()).agg(F.count_if(fresh).alias("new_labels")).withColumn(
        "due", F.col("new_labels") >= max(1, s.retrain_batch_size))


def stalled_runs(runs: DataFrame, now, s: Settings = DEFAULTS) -> DataFrame:
    """Active runs whose heartbeat is older than the limit, as failed."""
    limit = F.expr(f"INTERVAL {max(120, s.stale_after_seconds)} SECONDS")
    at = now if isinstance(now, Column) else F.lit(now)
    active = runs.filter(F.col("status").isin(fv.ACTIVE_RUN_STATUSES) & F.col("heartbeat_at").isNotNull())
    return active.filter(F.col("heartbeat_at") <= at - limit).withColumn("status", F.lit("failed")).withColumn(
        "phase", F.lit("stalled"))


def feedback_state(log: DataFrame) -> DataFrame:
    """Current verdict per (assessment, user) from a log with action ``put`` or ``retract``."""
    state = latest_by_key(log, ["assessment_id", "user_id"], ["reviewed_at", "id"],
                          ["action", "verdict", "corrected_classification"])
    return state.filter(F.col("action") == "put").drop("action")
