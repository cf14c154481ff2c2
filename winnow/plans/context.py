"""Evidence text of a finding: redacted payload with its source window, and its hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions import texts
from winnow.operators import joins
from winnow.settings import DEFAULTS, Settings


def source_windows(f: DataFrame, lines: DataFrame, s: Settings = DEFAULTS, keys=None) -> DataFrame:
    """(id, start_line, end_line, code) for the findings whose source is there."""
    w = joins.line_window(f, lines, max(5, s.context_radius), keys, shown=joins.shown_line)
    return w.select(
        "id", F.element_at("window", 1)["line_no"].alias("start_line"),
        F.element_at("window", -1)["line_no"].alias("end_line"), joins.window_code("window", shown=True).alias("code"),
    )


def build_contexts(f: DataFrame, lines: DataFrame | None = None, s: Settings = DEFAULTS, keys=None) -> DataFrame:
    """finding_id, context (bounded JSON), context_hash, format_version."""
    if lines is not None:
        w = source_windows(f, lines, s, keys)
        rows = f.join(w, "id", "left")
    else:
        rows = f.select("*", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"),
                        F.lit(None).cast("string").alias("code"))
    there = F.col("code").isNotNull()
    payload = F.to_json(F.struct(
        F.struct(
            "id", "rule_id", "cwe_id", "severity", "file_path", "line_number",
            texts.redact(F.coalesce("message", F.lit(""))).alias("message"),
            texts.redact(F.coalesce("raw_snippet", F.lit(""))).alias("raw_snippet"),
        ).alias("finding"),
        F.struct("feature_vector", "tp_probability", "predicted_label").alias("static_analysis"),
        F.struct(
            there.alias("available"),
            F.when(~there, F.lit("finding source file not found" if lines is not None else "source workspace unavailable")).alias("reason"),
            "start_line", "end_line", "code",
        ).alias("source_context"),
    ))
    # the hash covers the whole redacted payload; only the shown text is cut
    whole = rows.select(F.col("id").alias("finding_id"), "file_path", "line_number", payload.alias("_whole"))
    return whole.select(
        "finding_id", "file_path", "line_number",
        texts.limited("_whole", s.max_context_chars, "\n...[context truncated]...").alias("context"),
        F.sha2("_whole", 256).alias("context_hash"), F.lit(fv.CONTEXT_FORMAT_VERSION).alias("format_version"),
    )


def stale_contexts(f: DataFrame, ctx: DataFrame) -> DataFrame:
    """Findings without a context, or with one of an older format."""
    good = ctx.filter(F.col("format_version") == fv.CONTEXT_FORMAT_VERSION).select(F.col("finding_id").alias("id"))
    return f.join(good, "id", "left_anti")
