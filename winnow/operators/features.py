"""Assembly of the feature vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions import scoring
from winnow.functions.common import source_keys


def build_vectors(f: DataFrame, rules: DataFrame, code: DataFrame | None = None, authors: DataFrame | None = None,
                  flow: DataFrame | None = None, keys=None) -> DataFrame:
    """Adds ``feature_vector`` from scanner metadata, rule history, code, authorship and dataflow.

    ``code``/``flow`` are keyed by ``keys`` and line_no, ``authors`` by finding id;
    without ``keys``, by path and by project and commit where both sides have them.
    A finding without source gets the extractor's defaults (complexity 1).
    """
    hist = rules.select(F.col("external_id").alias("rule_id"), F.col("historical_fp_rate").alias("_rate"))
    out = f.drop("feature_vector").join(hist, "rule_id", "left")
    code_cols = ["cyclomatic_complexity", "has_sanitizer_in_ast", "line_depth_in_function"]
    if code is not None:
        by = list(keys or source_keys(f, code))
        out = out.join(code.select(*by, F.col("line_no").alias("line_number"), *code_cols), [*by, "line_number"], "left")
    else:
        out = out.select("*", *[F.lit(None).cast("int").alias(c) for c in code_cols])
    flow_cols = fv.DATAFLOW_FEATURES
    if flow is not None:
        by = list(keys or source_keys(f, flow))
        out = out.join(flow.select(*by, F.col("line_no").alias("line_number"), *flow_cols), [*by, "line_number"], "left")
    else:
        out = out.select("*", *[
            F.lit(None).cast("string" if c in fv.TEXT_FEATURES else "int").alias(c) for c in flow_cols])
    if authors is not None:
        out = out.join(authors.select("id", "developer_experience_lvl"), "id", "left")
    else:
        out = out.withColumn("developer_experience_lvl", F.lit(None).cast("string"))
    path = F.concat(F.lit("/"), F.replace("file_path", F.lit("\\"), F.lit("/")))
    vector = F.struct(
        F.coalesce("cwe_id", F.lit(0)).alias("cwe_id"),
        F.upper("severity").alias("scanner_severity"),
        scoring.file_extension("file_path").alias("file_extension"),
        scoring.is_test_file(path).alias("is_test_file"),
        F.coalesce("cyclomatic_complexity", F.lit(1)).alias("cyclomatic_complexity"),
        F.coalesce("has_sanitizer_in_ast", F.lit(0)).alias("has_sanitizer_in_ast"),
        F.coalesce("line_depth_in_function", F.lit(0)).alias("line_depth_in_function"),
        F.coalesce("_rate", F.lit(0.0)).alias("historical_fp_rate_rule"),
        F.coalesce("developer_experience_lvl", F.lit("unknown")).alias("developer_experience_lvl"),
        *[F.coalesce(c, F.lit(fv.FEATURE_DEFAULTS[c])).alias(c) for c in flow_cols],
    )
    return out.select(*[c for c in f.columns if c != "feature_vector"], vector.alias("feature_vector"))


def missing_vectors(f: DataFrame, s: DataFrame | None = None, project=None) -> DataFrame:
    """Findings still without a vector, optionally of one project."""
    out = f.filter(F.col("feature_vector").isNull())
    if project is not None:
        mine = s.filter(F.col("project_id") == project).select(F.col("id").alias("scan_id"))
        out = out.join(mine, "scan_id", "left_semi")
    return out
