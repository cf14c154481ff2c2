"""Row selection over findings, feedback and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions import scoring, texts
from winnow.functions.common import reasons
from winnow.settings import DEFAULTS, Settings


def filter_findings(f: DataFrame, scan_id=None, predicted_label=None, min_probability=None, status=None, tab=None):
    """Listing filter; every argument is optional and pushed to the scan."""
    out = f
    if scan_id is not None:
        out = out.filter(F.col("scan_id") == scan_id)
    if predicted_label:
        out = out.filter(F.col("predicted_label") == predicted_label)
    if min_probability is not None:
        out = out.filter(F.col("tp_probability") >= float(min_probability))
    if status:
        out = out.filter(F.col("status") == status)
    if tab == "pending":
        out = out.filter(F.col("final_label").isNull())
    elif tab in fv.LABELS:
        out = out.filter(F.col("final_label") == tab)
    return out


def queue_filter(f: DataFrame, s: DataFrame | None = None, rule=None, project=None, severity=None) -> DataFrame:
    """Unlabelled findings, optionally of one rule, project or severity."""
    out = f.filter(F.col("final_label").isNull())
    if rule:
        out = out.filter(F.col("rule_id") == rule)
    if severity:
        out = out.filter(F.col("severity") == severity)
    if project is not None:
        mine = s.filter(F.col("project_id") == project).select(F.col("id").alias("scan_id"))
        out = out.join(mine, "scan_id", "left_semi")
    return out


def _trusted_on(f: DataFrame, fb: DataFrame) -> Column:
    return (f["id"] == fb["finding_id"]) & (f["final_label"] == fb["corrected_label"])


def _trusted_feedback(fb: DataFrame) -> DataFrame:
    return fb.filter(F.col("source").isin(fv.TRUSTED_SOURCES) & F.col("training_eligible")).select(
        "finding_id", "corrected_label"
    )


def labelled(f: DataFrame) -> DataFrame:
    vector = "feature_vector" if "feature_vector" in f.columns else "sample"
    return f.filter(F.col("final_label").isNotNull() & F.col(vector).isNotNull())


def trusted(f: DataFrame, fb: DataFrame) -> DataFrame:
    """Labelled by a person, a benchmark or an import that agrees with the finding."""
    base, ok = labelled(f), _trusted_feedback(fb)
    return base.join(ok, _trusted_on(base, ok), "left_semi")


def untrusted(f: DataFrame, fb: DataFrame) -> DataFrame:
    """Labelled, but nothing trusted stands behind the label."""
    base = labelled(f)
    # by the id alone, so that what comes next on the id need not move the rows again; a finding has few labels
    agreed = _trusted_feedback(fb).groupBy(F.col("finding_id").alias("id")).agg(F.collect_set("corrected_label").alias("_agreed"))
    behind = F.coalesce(F.array_contains("_agreed", F.col("final_label")), F.lit(False))
    return base.join(agreed, "id", "left").filter(~behind).select(*base.columns)


def pseudo(f: DataFrame, fb: DataFrame) -> DataFrame:
    """Labelled by the machine and not excluded."""
    ok = fb.filter((F.col("source") == "ai_pseudo") & F.col("training_eligible")).select(
        F.col("finding_id").alias("id")
    )
    return labelled(f).join(ok, "id", "left_semi")


def comment_candidates(f: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Pending likely hits strictly above the threshold, with the comment text."""
    return f.filter(
        (F.col("predicted_label") == "true_positive")
        & (F.col("tp_probability") > s.comment_threshold)
        & (F.col("status") == "pending")
    ).withColumn("body", texts.comment_body("message", "rule_id", "cwe_id", "severity", "tp_probability"))


def suppressed(f: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return f.filter((F.col("predicted_label") == "false_positive") & (F.col("tp_probability") <= s.fp_threshold))


def severity_gate(f: DataFrame, threshold: str) -> DataFrame:
    """One row: does any finding reach the threshold?  An unknown threshold never fails."""
    t = threshold.upper()
    if t not in fv.SEVERITIES:
        return f.sparkSession.range(1).select(F.lit(False).alias("failed"))
    reached = scoring.gate_rank("severity") >= fv.SEVERITIES.index(t) + 1
    return f.agg(F.coalesce(F.bool_or(reached), F.lit(False)).alias("failed"))


def promotable(a: DataFrame, f: DataFrame, fb: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Decisive, confident adjudications of findings nobody has labelled."""
    sure = a.filter(
        (F.col("reviewer") == fv.ADJUDICATOR)
        & F.col("classification").isin(fv.TP_CLASSES + fv.FP_CLASSES)
        & (F.col("confidence") >= s.promote_confidence)
    ).select(
        F.col("id").alias("assessment_id"), "finding_id", "classification", "confidence",
        scoring.class_label("classification").alias("label"),
    )
    free = f.filter(F.col("final_label").isNull() & F.col("feature_vector").isNotNull())
    free = free.join(fb.select(F.col("finding_id").alias("id")), "id", "left_anti")
    return sure.join(free, sure["finding_id"] == free["id"]).drop("id")


def validate_feedback(rows: DataFrame) -> DataFrame:
    """Adds ``reject_reasons`` to verdicts on reviews; empty means accepted."""
    codes = F.coalesce(F.col("reason_codes"), F.array().cast("array<string>"))
    allowed = F.array(*[F.lit(c) for c in fv.REASON_CODES])
    corrected = F.col("corrected_classification")
    return rows.withColumn(
        "reject_reasons",
        reasons(
            (~F.coalesce(F.col("reviewer").isin(fv.REVIEWERS), F.lit(False)), "not_reviewable"),
            (~F.coalesce(F.col("verdict").isin(fv.VERDICTS), F.lit(False)), "verdict_unknown"),
            (F.col("verdict").isin("incorrect", "partially_correct") & corrected.isNull(), "correction_required"),
            (corrected.isNotNull() & ~corrected.isin(fv.CLASSIFICATIONS), "correction_unknown"),
            (F.size(codes) > 10, "too_many_reason_codes"),
            (F.size(F.array_distinct(codes)) < F.size(codes), "reason_codes_repeat"),
            (F.size(F.array_except(codes, allowed)) > 0, "reason_code_unknown"),
            (F.length(F.coalesce(F.col("notes"), F.lit(""))) > 5000, "notes_too_long"),
        ),
    )
