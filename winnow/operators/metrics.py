"""Grouped counts, rates and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions import scoring
from winnow.functions.common import NUL, reasons, trim_all
from winnow.operators import filters, latest
from winnow.operators.onerow import beside
from winnow.settings import DEFAULTS, Settings
from winnow.sinks import files


def _is(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ---- rules ------------------------------------------------------------------
def rule_stats(f: DataFrame, fb: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """False-positive rate per rule over trusted labels, with the recommendation.

    The vector is not required here, unlike for training.
    """
    ok = fb.filter(F.col("source").isin(fv.TRUSTED_SOURCES) & F.col("training_eligible")).select(
        F.col("finding_id").alias("id"), F.col("corrected_label").alias("final_label")
    )
    kept = f.filter(F.col("final_label").isNotNull()).join(ok, ["id", "final_label"], "left_semi")
    return stats_of_labels(kept, s)


def stats_of_labels(kept: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    fp = F.count_if(_is("final_label", "false_positive"))
    return stats_of_counts(kept.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total_seen"), fp.alias("total_false_positive")), s)


def stats_of_counts(counts: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Rate and recommendation from total_seen and total_false_positive; a rule without labels has rate 0."""
    rate = F.round(safe_ratio(F.col("total_false_positive"), F.col("total_seen")), 4)
    out = counts.withColumn("historical_fp_rate", F.coalesce(rate, F.lit(0.0)))
    return out.withColumn("recommended_action", scoring.rule_action("total_seen", "historical_fp_rate", s))


def noisy_rules(stats: DataFrame, minimum: int = 20) -> DataFrame:
    return stats.filter((F.col("total_seen") >= minimum) & F.col("recommended_action").isNotNull()).orderBy(
        F.col("historical_fp_rate").desc(), "rule_id"
    )


def rule_breakdown(f: DataFrame, s: DataFrame | None = None, project=None) -> DataFrame:
    return (
        filters.queue_filter(f, s, project=project)
        .groupBy("rule_id", "cwe_id")
        .agg(F.count(F.lit(1)).alias("pending"))
        .orderBy(F.col("pending").desc(), "rule_id", "cwe_id")
    )


def tp_per_rule(snapshot: DataFrame) -> DataFrame:
    """Deduplicated trusted hits per rule."""
    hits = snapshot.filter(_is("label", "true_positive") & F.col("label_source").isin(fv.TRUSTED_SOURCES))
    return hits.filter(F.col("rule_id") != "").groupBy("rule_id").agg(F.count(F.lit(1)).alias("tp_count"))


# ---- scans and projects -----------------------------------------------------
def _finding_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("findings_count"),
        F.count_if(_is("predicted_label", "true_positive")).alias("true_positive_count"),
        F.count_if(_is("predicted_label", "false_positive")).alias("false_positive_count"),
        F.count_if(_is("status", "pending")).alias("pending_triage_count"),
    ]


def _zero(df: DataFrame, names) -> DataFrame:
    return df.fillna(0, subset=list(names))


def scan_summary(s: DataFrame, f: DataFrame) -> DataFrame:
    """Counts per scan; scans without findings stay with zeros."""
    counts = f.groupBy(F.col("scan_id").alias("id")).agg(*_finding_counts())
    names = [c for c in counts.columns if c != "id"]
    return _zero(s.join(counts, "id", "left"), names)


def scan_review_coverage(f: DataFrame, ctx: DataFrame, a: DataFrame) -> DataFrame:
    """Per scan: findings with a context and findings adjudicated at least once."""
    has_ctx = ctx.select(F.col("finding_id").alias("id"), F.lit(1).alias("_ctx"))
    adjudicated = (
        a.filter(F.col("reviewer") == fv.ADJUDICATOR)
        .groupBy(F.col("finding_id").alias("id")).agg(F.lit(1).alias("_adj"))
    )
    rows = f.select("id", "scan_id").join(has_ctx, "id", "left").join(adjudicated, "id", "left")
    return rows.groupBy("scan_id").agg(
        F.count("_ctx").alias("ai_context_count"), F.count("_adj").alias("ai_reviewed_count")
    )


def project_rollup(p: DataFrame, s: DataFrame, f: DataFrame) -> DataFrame:
    """Findings are counted per scan first, so nothing fans out and the hot scan is combined early."""
    per_scan = f.groupBy(F.col("scan_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count("final_label").alias("labelled"),
        F.count_if(_is("final_label", "true_positive")).alias("true_positive"),
    )
    per_project = (
        s.join(per_scan, "id", "left").groupBy(F.col("project_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("scans_count"),
            F.max("created_at").alias("last_scanned_at"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "labelled", "true_positive")],
        )
        .withColumn("pending", F.col("total") - F.col("labelled"))
    )
    names = ["scans_count", "total", "labelled", "true_positive", "pending"]
    return _zero(p.join(per_project, "id", "left"), names)


def scan_breakdown(f: DataFrame, by: str = "severity") -> DataFrame:
    """Counts by severity (most severe first) or by rule (largest first)."""
    counts = f.groupBy(by).agg(F.count(F.lit(1)).alias("findings"))
    order = scoring.gate_rank("severity").desc() if by == "severity" else F.col("findings").desc()
    return counts.orderBy(order, by)


def coverage_tree(files: DataFrame, excludes=None) -> DataFrame:
    """Per top folder: scanned or not, and how many source files it contributes."""
    from winnow.sources.files import excluded_path

    parts = F.split(F.col("path"), "/")
    top = F.when(F.size(parts) > 1, parts[0]).otherwise("(root)")
    names = [e.lower() for e in (excludes or fv.EXCLUDED_DIRECTORIES)]
    counted = ~excluded_path("path", excludes) & F.lower("path").endswith(".php")
    return (
        files.select(top.alias("name"), counted.alias("_c"))
        .groupBy("name").agg(F.count_if("_c").alias("php_files"))
        .withColumn("included", ~F.lower("name").isin(names))
        .orderBy(F.col("included").desc(), F.col("php_files").desc(), "name")
    )


# ---- training data ----------------------------------------------------------
def training_readiness(f: DataFrame, fb: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    rows = filters.trusted(f, fb)
    tp, fp = (F.count_if(_is("final_label", label)) for label in fv.LABELS)
    out = rows.agg(tp.alias("true_positive"), fp.alias("false_positive"))
    total = F.col("true_positive") + F.col("false_positive")
    ready = (total >= s.min_training_samples) & (F.col("true_positive") > 0) & (F.col("false_positive") > 0)
    return out.select(
        total.alias("total"), "true_positive", "false_positive",
        F.lit(s.min_training_samples).cast("bigint").alias("required"), ready.alias("ready"),
    )


def partition_counts(rows: DataFrame, by: str | None = "split") -> DataFrame:
    """Rows, classes and distinct groups; groups are reduced before they are counted."""
    keys = [by] if by else []
    per_group = rows.groupBy(*keys, "group_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_is("label", "true_positive")).alias("tp"),
        F.count_if(_is("label", "false_positive")).alias("fp"),
    )
    total = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("samples"),
        F.coalesce(F.sum("tp"), F.lit(0)).alias("true_positive"),
        F.coalesce(F.sum("fp"), F.lit(0)).alias("false_positive"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("tp") > 0).alias("true_positive_groups"),
    ]
    return per_group.groupBy(*keys).agg(*total) if by else per_group.agg(*total)


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(_is("label", v)).alias(v) for v in fv.LABELS])


def source_counts(rows: DataFrame) -> DataFrame:
    src = F.coalesce(F.nullif(F.col("label_source"), F.lit("")), F.lit("unattributed"))
    return rows.groupBy(src.alias("label_source")).agg(F.count(F.lit(1)).alias("records"))


def exclusion_stats(deduped: DataFrame, inconsistent: DataFrame | None = None) -> DataFrame:
    """One row: copies dropped, contradictory copies dropped, inconsistent labels."""
    conflict = F.col("label_conflict")
    out = deduped.agg(
        F.coalesce(F.sum(F.when(~conflict, F.col("duplicate_count") - 1)), F.lit(0)).alias("excluded_duplicates"),
        F.coalesce(F.sum(F.when(conflict, F.col("duplicate_count"))), F.lit(0)).alias("excluded_conflicts"),
    )
    if inconsistent is None:
        return out.withColumn("excluded_inconsistent_labels", F.lit(0).cast("bigint"))
    return beside(out, inconsistent.agg(F.count(F.lit(1)).alias("excluded_inconsistent_labels")))


def ambiguous_vectors(rows: DataFrame) -> DataFrame:
    """Feature hashes that carry both labels, with their row count."""
    return (
        rows.groupBy("feature_sha256")
        .agg(F.count(F.lit(1)).alias("rows"), (F.min("label") != F.max("label")).alias("_mixed"))
        .filter("_mixed").drop("_mixed")
    )


def known_ambiguous(rows: DataFrame) -> DataFrame:
    """The feature hashes of ``ambiguous_vectors``, written once: how they are joined is decided by their real size."""
    return files.stage(ambiguous_vectors(rows).select("feature_sha256"), "ambiguous")


def flag_ambiguous(rows: DataFrame) -> DataFrame:
    """Adds ``ambiguous_feature``.

    Aggregate and join back instead of a window: a hash held by a third of the
    rows is combined early, and the join side has one row per hash.
    """
    mixed = known_ambiguous(rows).withColumn("_m", F.lit(True))
    return rows.join(mixed, "feature_sha256", "left").withColumn(
        "ambiguous_feature", F.coalesce(F.col("_m"), F.lit(False))
    ).drop("_m")


def dataset_fingerprint(rows: DataFrame) -> DataFrame:
    """Digest of a multiset of rows that no order or partitioning changes.

    Sums of four digest parts have constant size, so this is one map-side
    combined aggregate whatever the row count.
    """
    digest = F.sha2(F.concat_ws(NUL, "fingerprint", "group_key", "label", "sample"), 256)
    parts = [F.conv(F.substring(F.col("_d"), 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").cast("string") for p in parts]
    n = F.count(F.lit(1)).cast("string")
    return rows.select(digest.alias("_d")).agg(F.sha2(F.concat_ws(":", n, *sums), 256).alias("dataset_fingerprint"))


# ---- reviewers --------------------------------------------------------------
def reviewer_coverage(a: DataFrame) -> DataFrame:
    return a.groupBy("reviewer", "finding_id").agg(F.lit(1).alias("_x")).groupBy("reviewer").agg(
        F.count(F.lit(1)).alias("findings")
    )


def _cells(names) -> list[Column]:
    return [F.count_if(F.col("outcome") == n).alias(n) for n in names]


def _both_reviewers(matrix: DataFrame, names) -> DataFrame:
    base = matrix.sparkSession.createDataFrame([(r,) for r in fv.REVIEWERS], "reviewer string")
    return base.join(matrix, "reviewer", "left").fillna(0, subset=list(names))


def outcome_matrix(a: DataFrame, f: DataFrame) -> DataFrame:
    """Per reviewer: the model's predictions against the reviewer's latest verdicts."""
    best = latest.latest_assessment(a.filter(F.col("reviewer").isin(fv.REVIEWERS)))
    rows = best.join(f.select(F.col("id").alias("finding_id"), "predicted_label"), "finding_id")
    scored = rows.select("reviewer", scoring.outcome_vs_model("predicted_label", "classification").alias("outcome"))
    return _both_reviewers(scored.groupBy("reviewer").agg(*_cells(fv.OUTCOMES)), fv.OUTCOMES)


def human_outcome_matrix(a: DataFrame, f: DataFrame, fb: DataFrame) -> DataFrame:
    """Per reviewer: latest verdicts against trusted labels; unlabelled ones are awaiting review."""
    names = [*fv.OUTCOMES, "awaiting_review"]
    best = latest.latest_assessment(a.filter(F.col("reviewer").isin(fv.REVIEWERS)))
    truth = f.select("id", "final_label").join(
        fb.select(F.col("finding_id").alias("id"), F.col("source").alias("_src")), "id", "left"
    ).select(F.col("id").alias("finding_id"), scoring.trusted_label("final_label", "_src").alias("truth"))
    scored = best.join(truth, "finding_id").select(
        "reviewer",
        F.when(F.col("truth").isNull(), "awaiting_review")
        .otherwise(scoring.outcome_vs_human("truth", "classification")).alias("outcome"),
    )
    return _both_reviewers(scored.groupBy("reviewer").agg(*_cells(names)), names)


def avg_inference_seconds(a: DataFrame, prompt_version: str = "p1", newest: int = 20) -> DataFrame:
    """Mean of the positive durations among the newest reviews; null when there are none."""
    timed = a.filter(
        F.col("reviewer").isin(fv.REVIEWERS) & (F.col("prompt_version") == prompt_version)
        & F.col("total_duration").isNotNull()
    )
    top = timed.orderBy(F.col("completed_at").desc_nulls_last(), F.col("id").desc()).limit(newest)
    seconds = F.col("total_duration").cast("double") / 1e9
    return top.agg(F.avg(F.when(seconds > 0, seconds)).alias("average_seconds"))


def reviewer_counters(records: DataFrame) -> DataFrame:
    """All manifest counters of a reviewer dataset in one pass."""
    groups = {
        "reviewer": (F.col("reviewer"), fv.REVIEWERS),
        "split": (F.col("split"), ["train", "validation"]),
        "class": (F.coalesce("reference_classification", F.lit("unresolved")), [*fv.CLASSIFICATIONS, "unresolved"]),
        "label": (F.coalesce("reference_label", F.lit("unresolved")), [*fv.LABELS, "unresolved"]),
        "outcome": (F.col("outcome"), fv.OUTCOMES),
        "verdict": (F.coalesce("verdict", F.lit("not_explicit")), [*fv.VERDICTS, "not_explicit"]),
    }
    cells = [F.count(F.lit(1)).alias("total")]
    for name, (value, allowed) in groups.items():
        cells += [F.count_if(F.coalesce(value == v, F.lit(False))).alias(f"{name}_{v}") for v in allowed]
    return records.agg(*cells)


# ---- model ------------------------------------------------------------------
def confusion(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion cells, precision, recall, F1 and flag coverage of ``predicted`` against ``label``."""
    pos = "true_positive"
    p, t = _is("predicted", pos), _is("label", pos)
    cells = pred.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"),
    )
    precision = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    flagged = F.col("tp") + F.col("fp")
    return cells.select(
        "*",
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"),
        F.round(safe_ratio(2 * precision * recall, precision + recall), 4).alias("f1_score"),
        flagged.alias("flagged_count"), (flagged > 0).alias("precision_defined"),
        F.round(flagged / F.greatest(F.lit(1), F.col("sample_size")), 4).alias("coverage"),
    )


def promotion_counts(a: DataFrame, f: DataFrame, fb: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """How many adjudications could be promoted and how many were."""
    eligible = filters.promotable(a, f, fb, s).agg(F.count(F.lit(1)).alias("eligible"))
    done = fb.filter(F.col("source") == "ai_pseudo").agg(F.count(F.lit(1)).alias("promoted"))
    return beside(eligible, done)


# ---- review runs ------------------------------------------------------------
def run_progress(runs: DataFrame, a: DataFrame, model: str, avg_seconds=None) -> DataFrame:
    """Progress of review runs from their candidate lists and the stored reviews."""
    total = F.size("candidate_finding_ids")
    base = runs.withColumn("total_findings", total).withColumn(
        "processed", F.greatest(F.lit(0), F.least(total, F.col("next_step") - total))
    ).withColumn("_off_steps", F.least(total, F.col("next_step"))).withColumn(
        "_def_steps", F.col("processed")
    )
    slots = base.select("id", "processed", "_off_steps", "_def_steps",
                        F.posexplode("candidate_finding_ids").alias("pos", "finding_id"))
    done = F.col("completed_at").isNotNull()
    seen = slots.join(
        a.select("finding_id", "reviewer", "model", "completed_at"), "finding_id", "left"
    ).groupBy("id", "pos", "processed", "_off_steps", "_def_steps").agg(
        F.coalesce(F.bool_or((F.col("reviewer") == fv.ADJUDICATOR) & done), F.lit(False)).alias("adj"),
        *[
            F.coalesce(F.bool_or((F.col("reviewer") == r) & (F.col("model") == model) & cond), F.lit(False)).alias(name)
            for r, cond, name in [
                ("offensive", done, "off_done"), ("defensive", done, "def_done"),
                ("offensive", F.lit(True), "off_any"), ("defensive", F.lit(True), "def_any"),
            ]
        ],
    )
    counts = seen.groupBy("id").agg(
        F.count_if(F.col("adj") & (F.col("pos") < F.col("processed"))).alias("reviewed"),
        F.count_if(F.col("off_done") & (F.col("pos") < F.col("_off_steps"))).alias("_off"),
        F.count_if(F.col("def_done") & (F.col("pos") < F.col("_def_steps"))).alias("_def"),
        (F.count_if("off_any") + F.count_if("def_any")).alias("_any"),
    )
    out = base.join(counts, "id", "left").fillna(0, subset=["reviewed", "_off", "_def", "_any"])
    steps = F.col("total_findings") * 2
    complete = F.least(steps, F.greatest(F.least(steps, F.col("_any")), F.col("next_step")))
    terminal = F.col("status").isin(fv.TERMINAL_RUN_STATUSES)
    avg = F.lit(None).cast("double") if avg_seconds is None else avg_seconds
    return out.select(
        "id", "scan_id", "status", "total_findings", "processed", "reviewed",
        F.greatest(F.lit(0), F.col("processed") - F.col("reviewed")).alias("failed"),
        ((F.col("_off") < F.col("_off_steps")) | (F.col("_def") < F.col("_def_steps"))).alias("has_errors"),
        complete.alias("completed_steps"), steps.alias("total_steps"),
        F.when(steps > 0, F.floor(complete * 100 / steps)).otherwise(F.lit(0)).cast("int").alias("progress_percent"),
        F.when(terminal, F.lit(0)).otherwise(F.round((steps - complete) * avg)).cast("bigint")
        .alias("estimated_remaining_seconds"),
    )


# ---- dataset warnings -------------------------------------------------------
def dataset_warnings(stats: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds ``warnings`` to a one-row frame of dataset statistics."""
    t = fv.WARNING_TEXTS

    def num(key: str, c: str) -> Column:
        return F.format_string(t[key], F.col(c))

    tp, fp = F.col("train_true_positive"), F.col("train_false_positive")
    vtp, vfp = F.col("validation_true_positive"), F.col("validation_false_positive")
    ratio = F.try_divide(fp.cast("double"), tp.cast("double"))
    return stats.withColumn(
        "warnings",
        reasons(
            ((tp == 0) | (fp == 0), t["train_labels"]),
            ((vtp == 0) | (vfp == 0), t["validation_labels"]),
            (vtp < s.min_validation_tp, t["validation_support"]),
            (F.col("validation_tp_groups") < s.min_validation_tp_groups, t["validation_groups"]),
            ((tp > 0) & (ratio >= 5), F.format_string(t["imbalance"], ratio)),
            (F.col("quarantine") > 0, num("quarantine", "quarantine")),
            (F.col("truncated") > 0, num("truncated", "truncated")),
            (F.col("ambiguous_feature_rows") > 0, num("ambiguous", "ambiguous_feature_rows")),
            (F.col("excluded_conflicts") > 0, num("conflicts", "excluded_conflicts")),
            (F.col("excluded_inconsistent_labels") > 0, num("inconsistent", "excluded_inconsistent_labels")),
        ),
    )


def normalized_source(source) -> Column:
    return F.nullif(F.lower(trim_all(source)), F.lit(""))
