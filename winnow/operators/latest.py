"""Latest and representative rows.

``row_number() = 1`` is pruned before the shuffle (WindowGroupLimit), so a hot
key sends one row per task.  Where a group count is needed as well, the work is
a ``groupBy`` with partial aggregation instead of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.settings import DEFAULTS, Settings


def first_per_group(df: DataFrame, keys: list, order: list[Column], k: int = 1, rank_as: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", rank_as) if rank_as else ranked.drop("_rank")


def _newest(time: str) -> list[Column]:
    return [F.col(time).desc_nulls_last(), F.col("id").desc()]


def latest_assessment(a: DataFrame) -> DataFrame:
    return first_per_group(a, ["finding_id", "reviewer"], _newest("completed_at"))


def latest_feedback(af: DataFrame) -> DataFrame:
    return first_per_group(af, ["assessment_id"], _newest("reviewed_at"))


def latest_trusted_triage(fb: DataFrame) -> DataFrame:
    """Newest decision per finding that no machine wrote."""
    notes = F.coalesce(F.col("notes"), F.lit(""))
    by_machine = F.col("source") == "ai_pseudo"
    for prefix in fv.PSEUDO_NOTE_PREFIXES:
        by_machine = by_machine | notes.startswith(prefix)
    time = "created_at" if "created_at" in fb.columns else "updated_at"
    return first_per_group(fb.filter(~by_machine), ["finding_id"], _newest(time))


def dedupe_context(a: DataFrame) -> DataFrame:
    """One review per reviewer and evidence text, newest wins."""
    return first_per_group(a, ["reviewer", "context_hash"], _newest("completed_at"))


def representatives(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Smallest row per key with ``duplicate_count``; ``order`` must end in a unique column.

    A struct minimum combines on the map side, so a key holding a third of all
    rows still reaches its reducer as one row per task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest))
    return (
        rows.groupBy(*keys)
        .agg(best.alias("_best"), F.count(F.lit(1)).alias("duplicate_count"))
        .select(*keys, "_best.*", "duplicate_count")
    )


def dedupe_findings(rows: DataFrame) -> DataFrame:
    """Representative per fingerprint; ``label_conflict`` marks contradictory copies."""
    order = ["group_key", "sample", "id"]
    rest = [c for c in rows.columns if c not in ["fingerprint", *order]]
    return (
        rows.groupBy("fingerprint")
        .agg(
            F.min(F.struct(*order, *rest)).alias("_best"),
            F.count(F.lit(1)).alias("duplicate_count"),
            (F.min("label") != F.max("label")).alias("label_conflict"),
        )
        .select("fingerprint", "_best.*", "duplicate_count", "label_conflict")
    )


def dedupe_quarantine(rows: DataFrame) -> DataFrame:
    return representatives(rows, ["fingerprint", "label", "label_source"], ["group_key", "id"])


def dedupe_review(rows: DataFrame) -> DataFrame:
    return representatives(rows, ["fingerprint"], ["group_key", "sample", "id"])


def latest_run(runs: DataFrame) -> DataFrame:
    return first_per_group(runs, ["scan_id"], [F.col("id").desc()])


def latest_deployed(states: DataFrame) -> DataFrame:
    return states.filter(F.col("deployment_status") == "deployed").orderBy(
        F.col("trained_at").desc(), F.col("id").desc()
    ).limit(1)


def model_history(states: DataFrame, newest: int = 20) -> DataFrame:
    """The newest states, oldest first."""
    return states.orderBy(F.col("trained_at").desc(), F.col("id").desc()).limit(newest).orderBy("trained_at", "id")


def model_trend(states: DataFrame, newest: int = 20) -> DataFrame:
    w = Window.orderBy("trained_at", "id")  # at most ``newest`` rows
    return model_history(states, newest).select(
        F.row_number().over(w).alias("attempt"), "id", "f1_score", "deployment_status"
    )


def last_decision(batch: DataFrame, keys=("finding_id",), position: str = "position") -> DataFrame:
    """The last entry of a bulk batch wins per finding."""
    return first_per_group(batch, list(keys), [F.col(position).desc()])


def reviewer_pair(a: DataFrame, ctx: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Both reviewers' latest answers for the configured model, prompt and current evidence.

    One shuffle on the finding: the two reviewers are picked by conditional maxima.
    """
    usable = a.filter(
        F.col("reviewer").isin(fv.REVIEWERS) & (F.col("model") == model) & (F.col("prompt_version") == prompt_version)
    )
    fresh = usable.join(ctx.select("finding_id", "context_hash"), ["finding_id", "context_hash"])
    keep = ["id", "classification", "confidence", "missing_evidence"]
    row = F.struct("completed_at", *keep)
    picks = [F.max(F.when(F.col("reviewer") == r, row)).alias(r) for r in fv.REVIEWERS]
    pairs = fresh.groupBy("finding_id", "context_hash").agg(*picks)
    return pairs.filter(F.col("offensive").isNotNull() & F.col("defensive").isNotNull())


def superseded(runs: DataFrame) -> DataFrame:
    """Active runs whose scan an older active run already owns."""
    active = runs.filter(F.col("status").isin(fv.ACTIVE_RUN_STATUSES))
    owner = active.groupBy("scan_id").agg(F.min("id").alias("owner_id"))
    return active.join(owner, "scan_id").filter(F.col("id") > F.col("owner_id"))


def candidates_per_scan(f: DataFrame, k: int) -> DataFrame:
    from winnow.functions.scoring import queue_rank

    return first_per_group(
        f, ["scan_id"], [queue_rank("severity"), F.col("tp_probability").desc_nulls_last(), F.col("id")], k, "position"
    )


def run_size(s: Settings = DEFAULTS) -> int:
    return max(1, s.review_run_size)
