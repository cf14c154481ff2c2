"""Labels, outcomes, ranks, confidences and priorities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.functions.common import col, lookup, reasons, text, trim_all
from winnow.settings import DEFAULTS, Settings


# ---- severity ---------------------------------------------------------------
def gate_rank(severity) -> Column:
    """1..4 ascending; 0 for anything unknown."""
    return lookup(severity, {s: i + 1 for i, s in enumerate(fv.SEVERITIES)}, 0)


def queue_rank(severity) -> Column:
    """0 is the most urgent; 4 for anything unknown."""
    return lookup(severity, {s: i for i, s in enumerate(reversed(fv.SEVERITIES))}, 4)


def sarif_severity(declared, level) -> Column:
    upper = F.upper(text(declared))
    return F.when(upper.isin(fv.SEVERITIES), upper).otherwise(
        lookup(F.coalesce(col(level), F.lit("warning")), fv.SARIF_LEVEL_SEVERITY, "MEDIUM")
    )


def sarif_level(severity) -> Column:
    return lookup(F.upper(col(severity)), fv.SEVERITY_SARIF_LEVEL, "warning")


def tag_cwe(tags) -> Column:
    """First tag of the exact form CWE-<digits>."""
    hits = F.filter(col(tags), lambda t: t.rlike(r"(?i)^CWE-\d+$"))
    return F.regexp_extract(F.try_element_at(hits, F.lit(1)), r"(\d+)", 1).try_cast("int")


def text_cwe(value) -> Column:
    """CWE-<digits> anywhere in the text."""
    return F.nullif(F.regexp_extract(col(value), r"(?i)CWE-(\d+)", 1), F.lit("")).try_cast("int")


# ---- path features ----------------------------------------------------------
def is_test_file(path) -> Column:
    p = col(path)
    return (p.rlike(r"(?i)/(tests?|spec)/") | p.rlike(r"(Test|Spec)\.php$")).cast("int")


def file_extension(path) -> Column:
    p = col(path)
    suffix = F.regexp_extract(p, r"\.([^./\\]+)$", 1)
    return F.when(p.endswith(".blade.php"), "blade.php").otherwise(
        F.coalesce(F.nullif(suffix, F.lit("")), F.lit("unknown"))
    )


def path_parts(path) -> Column:
    """directory, file and directory segments; blank segments dropped."""
    relative = F.replace(text(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(relative, "/"), lambda s: s != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.struct(
        F.array_join(folders, "/").alias("directory"),
        F.coalesce(F.try_element_at(parts, F.lit(-1)), relative).alias("file"),
        folders.alias("segments"),
    )


# ---- prediction and labels --------------------------------------------------
def decision(probability, certified, s: Settings = DEFAULTS) -> Column:
    p = col(probability)
    return (
        F.when(~col(certified), F.lit(None).cast("string"))
        .when(p >= s.tp_threshold, "true_positive")
        .when(p <= s.fp_threshold, "false_positive")
    )


def high_confidence(predicted, probability, s: Settings = DEFAULTS) -> Column:
    return F.coalesce(
        (col(predicted) == "true_positive") & (col(probability) >= s.tp_threshold), F.lit(False)
    )


def class_label(classification) -> Column:
    c = col(classification)
    return F.when(c.isin(fv.TP_CLASSES), "true_positive").when(c.isin(fv.FP_CLASSES), "false_positive")


def _confusion_cell(predicted, actual) -> Column:
    p, a = col(predicted), col(actual)
    pos, neg = F.lit("true_positive"), F.lit("false_positive")
    return (
        F.when((p == pos) & (a == pos), "true_positive")
        .when((p == pos) & (a == neg), "false_positive")
        .when((p == neg) & (a == pos), "false_negative")
        .when((p == neg) & (a == neg), "true_negative")
        .otherwise("unresolved")
    )


def outcome_vs_model(predicted, classification) -> Column:
    """The model predicts, the reviewer is the truth."""
    return _confusion_cell(predicted, class_label(classification))


def outcome_vs_human(final_label, classification) -> Column:
    """The reviewer predicts, the person is the truth."""
    return _confusion_cell(class_label(classification), final_label)


def trusted_label(final_label, feedback_source) -> Column:
    """Hidden when only the machine labelled it; absent feedback counts as trusted."""
    return F.when(~F.coalesce(col(feedback_source) == "ai_pseudo", F.lit(False)), col(final_label))


def rule_action(total, rate, s: Settings = DEFAULTS) -> Column:
    return (
        F.when(col(total) < s.rule_min_samples, F.lit(None).cast("string"))
        .when(col(rate) > s.rule_suppress_rate, "suppress")
        .when(col(rate) > s.rule_review_rate, "review_config")
    )


def quarantine_reason(has_feedback, eligible, source) -> Column:
    """Why a labelled row may not certify; first match wins."""
    src = F.nullif(F.lower(trim_all(source)), F.lit(""))
    return (
        F.when(~col(has_feedback), "unattributed_label")
        .when(~F.coalesce(col(eligible), F.lit(True)), "label_quality_review")
        .when(src == "ai_pseudo", "ai_pseudo_label")
        .when(src.isNull() | ~src.isin(fv.TRUSTED_SOURCES), "untrusted_label_source")
        .otherwise("inconsistent_label")
    )


def snapshot_quarantine_reason(source) -> Column:
    src = F.nullif(F.lower(trim_all(source)), F.lit(""))
    return (
        F.when(src.isNull() | (src == "unattributed"), "unattributed_label")
        .when(src == "ai_pseudo", "ai_pseudo_label")
        .when(~src.isin(fv.TRUSTED_SOURCES), "untrusted_label_source")
    )


# ---- adjudication -----------------------------------------------------------
def adjudicate(predicted, probability, class_a, class_d) -> Column:
    """Needs both reviewers and the model to agree; never a confirmed class."""
    tp = col(class_a).isin(fv.TP_CLASSES) & col(class_d).isin(fv.TP_CLASSES)
    fp = col(class_a).isin(fv.FP_CLASSES) & col(class_d).isin(fv.FP_CLASSES)
    p = col(probability)
    return (
        F.when(tp & (col(predicted) == "true_positive") & (F.coalesce(p, F.lit(0.0)) >= 0.75), "likely_tp")
        .when(fp & (col(predicted) == "false_positive") & (F.coalesce(p, F.lit(1.0)) <= 0.25), "likely_fp")
        .otherwise("needs_validation")
    )


def adjudication_confidence(predicted, probability, conf_a, conf_d, classification) -> Column:
    p = F.coalesce(col(probability), F.lit(0.5))
    ml = (
        F.when(col(classification).isin(fv.TP_CLASSES) & (col(predicted) == "true_positive"), p)
        .when(col(classification).isin(fv.FP_CLASSES) & (col(predicted) == "false_positive"), 1 - p)
        .otherwise(F.lit(0.5))
    )
    a = F.coalesce(col(conf_a), F.lit(0.5))
    d = F.coalesce(col(conf_d), F.lit(0.5))
    mix = ml * 0.40 + a * 0.30 + d * 0.30
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mix)), 4)


def normalize_confidence(value) -> Column:
    """Percent or fraction to a fraction; not a number becomes null."""
    v = col(value).try_cast("double")
    v = F.when(v > 1, v / 100).otherwise(v)
    return F.when(v.isNotNull(), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 4))


def missing_evidence(a, d) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(col(a), empty), F.coalesce(col(d), empty)))


# ---- human signal -----------------------------------------------------------
def human_signal(explicit, classification, final_label, triage) -> Column:
    """Explicit reviewer feedback beats the triage label; null means drop."""
    e, t = col(explicit), col(triage)
    reference = F.coalesce(
        e["corrected_classification"], F.when(e["verdict"] == "correct", col(classification))
    )
    none = F.lit(None).cast("string")
    from_feedback = F.struct(
        reference.alias("reference_classification"),
        class_label(reference).alias("reference_label"),
        e["verdict"].alias("verdict"),
        F.coalesce(e["reason_codes"], F.array().cast("array<string>")).alias("reason_codes"),
        e["notes"].alias("notes"),
        F.lit("ai_assessment_feedback").alias("source"),
        e["reviewed_at"].alias("reviewed_at"),
    )
    from_triage = F.struct(
        F.when(col(final_label) == "true_positive", "confirmed_tp").otherwise("confirmed_fp")
        .alias("reference_classification"),
        col(final_label).alias("reference_label"),
        none.alias("verdict"),
        F.array().cast("array<string>").alias("reason_codes"),
        t["notes"].alias("notes"),
        F.lit("triage_feedback").alias("source"),
        t["updated_at"].alias("reviewed_at"),
    )
    return F.when(e.isNotNull(), from_feedback).when(
        t.isNotNull() & col(final_label).isNotNull(), from_triage
    )


def reference_outcome(classification, reference_label) -> Column:
    return outcome_vs_human(reference_label, classification)


# ---- review priority --------------------------------------------------------
def _priority_terms(severity, rule_id, snippet, probability, advisory, copies, rule_tp):
    """(condition, points, reason) in the order the reasons are reported."""
    rule = F.lower(text(rule_id))
    code = F.lower(text(snippet))
    tp_count = F.coalesce(col(rule_tp), F.lit(0))
    adv = F.coalesce(col(advisory), F.array().cast("array<string>"))
    points = F.aggregate(
        adv,
        F.lit(0),
        lambda best, c: F.greatest(best, lookup(c, fv.REVIEW_CLASS_POINTS, 0)),
    )
    says_tp = F.exists(adv, lambda c: c.isin(fv.TP_CLASSES))
    says_fp = F.exists(adv, lambda c: c.isin(fv.FP_CLASSES))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(probability)))
    path = rule.contains("path-traversal")
    command = rule.contains("command-injection")
    return [
        (F.lit(True), lookup(F.upper(text(severity)), fv.REVIEW_SEVERITY_POINTS, 10),
         F.concat(F.lit("severity_"), F.lower(text(severity)))),
        (tp_count == 0, 30, "no_trusted_tp_for_rule"),
        (tp_count.between(1, 2), 20, "scarce_trusted_tp_for_rule"),
        (tp_count.between(3, 5), 10, "limited_trusted_tp_for_rule"),
        (command, 25, "command_injection_priority"),
        (path & ~command, 15, "path_traversal_priority"),
        (path & code.rlike(r"\b(?:include|require|file_get_contents|readfile|fopen)\b"), 10,
         "dynamic_file_sink_candidate"),
        (trim_all(code) != "", 5, "source_excerpt_present"),
        (col(probability).isNotNull(), F.round(p * 5).cast("int"), "model_advisory_tiebreaker"),
        (F.array_contains(adv, "needs_validation"), 0, "ai_needs_validation"),
        (points > 0, points, "ai_advisory_signal"),
        (says_tp & says_fp, 20, "ai_disagreement"),
        (col(copies) > 1, F.least(F.lit(10), col(copies) - 1).cast("int"), "repeated_finding"),
    ]


def review_priority(severity, rule_id, snippet, probability, advisory, copies, rule_tp) -> Column:
    total = F.lit(0)
    for cond, pts, _ in _priority_terms(severity, rule_id, snippet, probability, advisory, copies, rule_tp):
        pts = F.lit(pts) if isinstance(pts, int) else pts
        total = total + F.when(cond, pts).otherwise(0)
    return total.cast("int")


def priority_reasons(severity, rule_id, snippet, probability, advisory, copies, rule_tp) -> Column:
    terms = _priority_terms(severity, rule_id, snippet, probability, advisory, copies, rule_tp)
    return F.array_distinct(reasons(*[(cond, reason) for cond, _, reason in terms]))


# ---- sinks and conformance --------------------------------------------------
def sink_hint(cwe, rule_id) -> Column:
    rule = F.lower(text(rule_id))
    expr = lookup(cwe, fv.CWE_SINK_KINDS)
    by_rule = None
    for words, kind in fv.RULE_SINK_KEYWORDS:
        hit = rule.contains(words[0])
        for w in words[1:]:
            hit = hit | rule.contains(w)
        by_rule = F.when(hit, kind) if by_rule is None else by_rule.when(hit, kind)
    return F.coalesce(expr, by_rule)


def enum_violations(severity=None, status=None, final_label=None, source=None) -> Column:
    """Names of the fields whose value is outside its allowed set."""
    checks = [
        (severity, fv.SEVERITIES, "severity"),
        (status, fv.FINDING_STATUSES, "status"),
        (final_label, fv.LABELS, "final_label"),
        (source, fv.SCAN_SOURCES, "source"),
    ]
    return reasons(
        *[(col(c).isNotNull() & ~col(c).isin(allowed), name) for c, allowed, name in checks if c is not None]
    )


def age_seconds(earlier, now) -> Column:
    return F.timestamp_diff("SECOND", col(earlier), col(now))


def author_level(commit_count, known, s: Settings = DEFAULTS) -> Column:
    n = F.coalesce(col(commit_count), F.lit(0))
    return (
        F.when(~col(known), "unknown")
        .when(n >= s.senior_commits, "senior")
        .when(n >= s.mid_commits, "mid")
        .otherwise("junior")
    )
