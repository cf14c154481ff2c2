"""Reports in, scored findings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow import fixed_values as fv
from winnow.operators import features, joins, latest, metrics, sets
from winnow.operators.onerow import beside
from winnow.plans import context
from winnow.settings import DEFAULTS, Settings
from winnow.sinks import files
from winnow.sources import reports


@dataclass
class Ingested:
    findings: DataFrame
    scans: DataFrame
    rules: DataFrame
    contexts: DataFrame
    candidates: DataFrame
    rejected: DataFrame
    documents: DataFrame


def with_ids(rows: DataFrame) -> DataFrame:
    """Stable ids: of (scan, document, place in the document), which moves nothing.

    Rows of added readers have no place; equal ones of a document are counted (combined on the map
    side, so a report of identical rows moves one row per task), then numbered.
    """
    keys = [c for c in rows.columns if c != "ordinal"]
    placed = rows.filter("ordinal is not null").select(F.xxhash64("scan_id", "document", "ordinal").alias("id"), *keys)
    if all(reader is reports.BUILT_IN.get(n) for n, reader in reports.READERS.items()):
        return placed
    counted = rows.filter("ordinal is null").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    copies = counted.select(*keys, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"))
    return placed.unionByName(copies.select(F.xxhash64(*keys, "_k").alias("id"), *keys))


def _in_scan(once: DataFrame, documents: DataFrame, scans: DataFrame) -> DataFrame:
    """Reports with project and commit of their scan: their own, unless the scan has several documents."""
    named = once.filter(F.col("scan_id").isNotNull())
    several = files.stage(documents.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("scan_id"), "several")
    if several.isEmpty():
        return named
    whole = scans.join(several, "scan_id", "left_semi").select("scan_id", "project_id", "commit_sha")
    return named.join(several, "scan_id", "left_anti").unionByName(named.drop("project_id", "commit_sha").join(whole, "scan_id"))


def ingest(arrivals: DataFrame, rules: DataFrame, code: DataFrame | None = None, authors: DataFrame | None = None,
           flow: DataFrame | None = None, lines: DataFrame | None = None, scorer=None, cfg: Settings = DEFAULTS, store=files.stage) -> Ingested:
    """Validate, normalize, register rules, build vectors, score, snapshot evidence.

    ``arrivals``: scan_id, project_id, source, commit_sha, branch, size_bytes, report.
    ``scorer`` maps findings to findings with probability and label (none = cold start).
    A scan may come as several reports; equal ones count once.  A bad report
    fails its own scan only.  Findings carry project and commit, and sides that
    know theirs (code, flow, lines) are joined on them too.  ``store`` writes a result (``documents``, ``findings``
    and small ones) under its name and reads it back.
    """
    checked = reports.with_documents(reports.validate_arrivals(arrivals, cfg))
    accepted = checked.filter(F.size("reject_reasons") == 0)
    rejected = checked.filter(F.size("reject_reasons") > 0).select("scan_id", "reject_reasons")
    about = ["scan_id", "project_id", "source", "commit_sha", "branch"]
    # reports stay where they are but those that may come twice
    once = sets.once_each(accepted.select(*about, "report", "document"), ["scan_id", "document"])
    documents = store(once.select(*about, "document", F.try_parse_json("report").isNull().alias("failed")), "documents")
    # a scan of several documents is one scan, and failed if any of them is
    scans = documents.groupBy("scan_id").agg(
        F.min(F.struct(*about[1:])).alias("about"), F.max("failed").alias("failed")
    ).select("scan_id", "about.*", F.when(F.col("failed"), "failed").otherwise("complete").alias("status"))

    # parsed once: rules, vectors, counts and candidates all read the stored rows
    normalized = reports.normalize_reports(_in_scan(once, documents, scans))
    found = with_ids(normalized.withColumnRenamed("snippet", "raw_snippet"))
    # one row per rule, written once: joined by its real size, so findings stay where they are; rules seen for the
    # first time have the rate of unknown ones
    registered = store(joins.known_rules(rules), "registered")
    vectors = features.build_vectors(found, registered, code, authors, flow)
    scored = scorer(vectors) if scorer else vectors.select(
        "*", F.lit(None).cast("double").alias("tp_probability"), F.lit(None).cast("string").alias("predicted_label"))
    # parsed and scored once: rules, counts, contexts and candidates all read the stored rows
    findings = store(scored.withColumn("final_label", F.lit(None).cast("string")).withColumn("status", F.lit("pending")), "findings")
    known = joins.register_rules(findings, registered)
    ctx = context.build_contexts(findings, lines, cfg)
    candidates = latest.candidates_per_scan(findings, latest.run_size(cfg)).select("scan_id", "position", "id")

    low = (F.col("predicted_label") == "false_positive") & (F.col("tp_probability") <= cfg.fp_threshold)
    totals = findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_findings"), F.count_if(low).alias("suppressed_count"))
    scans = scans.join(totals, "scan_id", "left").fillna(0, subset=["total_findings", "suppressed_count"])
    return Ingested(findings, scans, known, ctx, candidates, rejected, documents)


def review_status(scan_findings: DataFrame, a: DataFrame, fb: DataFrame, ctx: DataFrame, model: str, runs: DataFrame,
                  prompt_version: str = "p1", cfg: Settings = DEFAULTS) -> DataFrame:
    """Status report of the review stage as one row of counters."""
    f = scan_findings
    mine = a.join(f.select(F.col("id").alias("finding_id")), "finding_id", "left_semi")
    total = f.agg(F.count(F.lit(1)).alias("total_findings"))
    with_ctx = f.join(ctx.select(F.col("finding_id").alias("id")), "id", "left_semi").agg(F.count(F.lit(1)).alias("contexts"))
    cover = metrics.reviewer_coverage(mine).agg(*[
        F.coalesce(F.max(F.when(F.col("reviewer") == r, F.col("findings"))), F.lit(0)).alias(r)
        for r in [*fv.REVIEWERS, fv.ADJUDICATOR]])
    promo = metrics.promotion_counts(mine, f, fb.join(f.select(F.col("id").alias("finding_id")), "finding_id", "left_semi"), cfg)
    seconds = metrics.avg_inference_seconds(mine, prompt_version)
    progress = metrics.run_progress(runs, mine, model).agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("reviewed"), F.lit(0)).alias("reviewed"))
    out = beside(total, with_ctx, cover, promo, seconds, progress)
    return out.withColumnsRenamed({"eligible": "training_candidates", "promoted": "training_promoted"}).withColumn(
        "complete", (F.col("total_findings") > 0) & (F.col(fv.ADJUDICATOR) >= F.col("total_findings")))
