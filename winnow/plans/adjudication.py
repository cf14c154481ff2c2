"""Two reviews and the model's score combined into one recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions import scoring
from winnow.operators import filters, latest
from winnow.settings import DEFAULTS, Settings

MODEL = "deterministic-rules-v1"
PROMPT = "rules-v1"


def adjudications(f: DataFrame, a: DataFrame, ctx: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """One recommendation per finding both reviewers answered on its current evidence."""
    pairs = latest.reviewer_pair(a, ctx, model, prompt_version)
    rows = pairs.join(f.select(F.col("id").alias("finding_id"), "predicted_label", "tp_probability"), "finding_id")
    o, d = F.col("offensive"), F.col("defensive")
    rows = rows.withColumn(
        "classification", scoring.adjudicate("predicted_label", "tp_probability", o["classification"], d["classification"]))
    return rows.select(
        "finding_id", F.lit(fv.ADJUDICATOR).alias("reviewer"), F.lit(MODEL).alias("model"),
        F.lit(PROMPT).alias("prompt_version"), "context_hash", "classification",
        scoring.outcome_vs_model("predicted_label", "classification").alias("evaluation_outcome"),
        scoring.adjudication_confidence("predicted_label", "tp_probability", o["confidence"], d["confidence"],
                                        "classification").alias("confidence"),
        F.array(
            F.format_string("Model TP probability: %.3f", F.coalesce("tp_probability", F.lit(0.0))),
            F.format_string("Offensive: %s (%.3f)", o["classification"], F.coalesce(o["confidence"], F.lit(0.0))),
            F.format_string("Defensive: %s (%.3f)", d["classification"], F.coalesce(d["confidence"], F.lit(0.0))),
        ).alias("supporting_evidence"),
        scoring.missing_evidence(o["missing_evidence"], d["missing_evidence"]).alias("missing_evidence"),
    )


def promotions(a: DataFrame, f: DataFrame, fb: DataFrame, user_id: int, s: Settings = DEFAULTS) -> DataFrame:
    """Decision-log rows that turn sure adjudications into machine labels."""
    return filters.promotable(a, f, fb, s).select(
        "finding_id", F.lit(user_id).cast("bigint").alias("user_id"),
        F.col("predicted_label").alias("original_prediction"), F.col("tp_probability").alias("original_probability"),
        F.col("label").alias("corrected_label"), F.lit("ai_pseudo").alias("source"),
        F.col("assessment_id").alias("source_assessment_id"), F.lit(True).alias("training_eligible"),
        F.format_string("AI training label from adjudicator (%s, %.0f%% confidence).", F.col("classification"),
                        F.col("confidence") * 100).alias("notes"),
        "rule_id", F.lit("triaged").alias("status"),
    )


def assessment_upserts(log: DataFrame, f: DataFrame) -> DataFrame:
    """Newest answer per (finding, reviewer, model, prompt, evidence) with its outcome; older evidence stays as history."""
    keys = ["finding_id", "reviewer", "model", "prompt_version", "context_hash"]
    best = latest.first_per_group(log, keys, [F.col("completed_at").desc_nulls_last(), F.col("id").desc()])
    side = f.select(F.col("id").alias("finding_id"), "predicted_label")
    return best.join(side, "finding_id").withColumn(
        "evaluation_outcome", scoring.outcome_vs_model("predicted_label", "classification"))


def still_to_do(requests: DataFrame, a: DataFrame) -> DataFrame:
    """Requested reviews without a completed answer under the same key."""
    keys = ["finding_id", "reviewer", "model", "prompt_version", "context_hash"]
    done = a.filter(F.col("completed_at").isNotNull()).select(*keys)
    return requests.join(done, keys, "left_anti")
