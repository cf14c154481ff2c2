"""Queries for report sources, ingestion, model jobs and streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import derived
from catalog.registry import query
from catalog.tables import CTE
from winnow.functions import scoring
from winnow.operators import metrics, sets
from winnow.operators.onerow import beside
from winnow.plans import export, ingest, snapshot, training
from winnow.session import scratch
from winnow.settings import DEFAULTS
from winnow.sinks import files as sink
from winnow.sources import files, reports
from winnow.streaming import jobs, state

PER_DOCUMENT = 5000


def _documents(t, source: str) -> DataFrame:
    """Findings of the scans of one scanner, with the document they go to; big scans span several."""
    scans = t.scans.filter(F.col("source") == source).select(F.col("id").alias("scan_id"))
    rows = t.findings.join(scans, "scan_id")
    sizes = rows.groupBy("scan_id").agg(F.ceil(F.count(F.lit(1)) / PER_DOCUMENT).alias("_p"))
    return rows.join(sizes, "scan_id").withColumn("part", F.pmod(F.col("id"), F.col("_p")))


def _pack(rows: DataFrame, result: str, field: str) -> DataFrame:
    return rows.groupBy("scan_id", "part").agg(F.collect_list(F.expr(result)).alias("x")).select(
        "scan_id", F.to_json(F.struct(F.col("x").alias(field))).alias("report"))


def semgrep_reports(t):
    rows = _documents(t, "semgrep")
    scalar = """named_struct('check_id', rule_id, 'path', file_path, 'start', named_struct('line', line_number), 'extra', named_struct('severity', lower(severity), 'message', message, 'lines', raw_snippet, 'metadata', named_struct('cwe', concat('cwe-', cwe_id))))"""
    listed = scalar.replace("concat('cwe-', cwe_id)", "array(concat('CWE-', cwe_id, ': x'))")
    body = f"if(a_line % 2 = 0, to_json({listed}), to_json({scalar}))"
    return rows.groupBy("scan_id", "part").agg(F.concat_ws(",", F.collect_list(F.expr(body))).alias("x")).select(
        "scan_id", F.concat(F.lit('{"results":['), "x", F.lit("]}")).alias("report"))


def sonarqube_reports(t):
    return _pack(_documents(t, "sonarqube"), "named_struct('rule', rule_id, 'component', concat('proj:', file_path), 'line', line_number, 'severity', lower(severity), 'message', message)", "issues")


def bandit_reports(t):
    return _pack(_documents(t, "bandit"), "named_struct('test_id', rule_id, 'issue_cwe', named_struct('id', cwe_id), 'filename', file_path, 'line_number', line_number, 'issue_severity', severity, 'issue_text', message, 'code', raw_snippet)", "results")


def phpcs_reports(t):
    rows = _documents(t, "phpcs")
    message = F.expr("named_struct('source', rule_id, 'line', line_number, 'type', if(severity IN ('CRITICAL', 'HIGH'), 'ERROR', 'WARNING'), 'message', message)")
    per_file = rows.groupBy("scan_id", "part", "file_path").agg(F.collect_list(message).alias("messages"))
    return per_file.groupBy("scan_id", "part").agg(
        F.map_from_entries(F.collect_list(F.struct("file_path", F.struct("messages")))).alias("files")
    ).select("scan_id", F.to_json(F.struct("files")).alias("report"))


def sarif_reports(t):
    scans = t.scans.filter(F.col("source") == "sarif").select(F.col("id").alias("scan_id"))
    # one row per rule, written once: joined by its real size
    return sink.to_sarif(t.findings.join(scans, "scan_id"), sink.stage(t.rules, "rules"), PER_DOCUMENT).select("scan_id", "report")


MAKERS = {"sarif": sarif_reports, "semgrep": semgrep_reports, "sonarqube": sonarqube_reports, "bandit": bandit_reports, "phpcs": phpcs_reports}


def all_reports(t) -> DataFrame:
    return sets.union_rows(*[make(t).select("scan_id", F.lit(name).alias("source"), "report") for name, make in MAKERS.items()])


CTE["fsrc"] = (["findings", "scans", "rules"], """
SELECT f.*, s.source, s.project_id, s.created_at,
 CASE s.source WHEN 'sonarqube' THEN NULL WHEN 'phpcs' THEN NULL WHEN 'sarif' THEN coalesce(r.cwe_id, f.cwe_id) ELSE f.cwe_id END AS ncwe,
 CASE s.source WHEN 'bandit' THEN (CASE WHEN severity='CRITICAL' THEN 'MEDIUM' ELSE severity END) WHEN 'phpcs' THEN (CASE WHEN severity IN ('CRITICAL','HIGH') THEN 'HIGH' ELSE 'MEDIUM' END) ELSE severity END AS nsev,
 CASE WHEN s.source IN ('sonarqube','phpcs') THEN NULL ELSE raw_snippet END AS nsnip
FROM findings f JOIN scans s ON s.id=f.scan_id LEFT JOIN rules r ON r.external_id=f.rule_id""")
NORMAL = "SELECT scan_id, rule_id, coalesce(ncwe,-1) AS cwe_id, file_path, line_number, nsev AS severity, message, coalesce(nsnip,'') AS snippet FROM fsrc WHERE source='{}'"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("scan_id", "rule_id", F.coalesce("cwe_id", F.lit(-1)).alias("cwe_id"), "file_path", "line_number", "severity",
                     "message", F.coalesce("snippet", F.lit("")).alias("snippet"))


for _n, _name in enumerate(["sarif", "semgrep", "sonarqube", "bandit", "phpcs"]):
    _number = {0: "01", 1: "04", 2: "05", 3: "06", 4: "07"}[_n]
    query(f"src_{_number}_{_name}", "fsrc", sql=NORMAL.format(_name))(
        lambda t, name=_name: _shown(reports.READERS[name](MAKERS[name](t))))


@query("snk_01_sarif_round_trip", "findings", sql="SELECT scan_id, severity, count(*) AS n, count(cwe_id) AS with_cwe FROM findings GROUP BY 1,2")
def _(t):
    docs = sink.to_sarif(t.findings)
    return reports.read_sarif(docs).groupBy("scan_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.count("cwe_id").alias("with_cwe"))


@query("src_02_sarif_severity", sql="""
SELECT event_id, CASE WHEN event_type='purchase' THEN 'CRITICAL' ELSE CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'click' THEN 'LOW' ELSE 'MEDIUM' END END AS severity FROM events""")
def _(t):
    kind = F.col("event_type")
    declared = F.when(kind == "purchase", "critical").when(kind == "error", "urgent")
    level = F.when(kind == "error", "error").when(kind == "click", "note").when(kind == "signup", "none")
    return t.raw_events.select("event_id", scoring.sarif_severity(declared, level).alias("severity"))


@query("src_03_sarif_cwe", sql="SELECT event_id, CAST(CASE event_type WHEN 'purchase' THEN event_id%900 WHEN 'error' THEN 7 ELSE -1 END AS INT) AS cwe FROM events")
def _(t):
    kind = F.col("event_type")
    tags = F.when(kind == "purchase", F.array(F.lit("security"), F.concat(F.lit("cwe-"), (F.col("event_id") % 900).cast("string")), F.lit("CWE-1"))).when(
        kind == "error", F.array(F.lit("x"), F.lit("CWE-7"))).when(kind == "click", F.array(F.lit("notCWE-5")))
    return t.raw_events.select("event_id", F.coalesce(scoring.tag_cwe(tags), F.lit(-1)).alias("cwe"))


@query("src_08_normalize_all", "fsrc", sql="SELECT source, nsev AS severity, count(*) AS n, count(ncwe) AS with_cwe, count(nsnip) AS with_snippet FROM fsrc GROUP BY 1,2")
def _(t):
    return reports.normalize_reports(all_reports(t)).groupBy("source", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count("cwe_id").alias("with_cwe"), F.count("snippet").alias("with_snippet"))


@query("src_09_malformed_reports", "fsrc", sql="SELECT CAST(scan_id % 7 AS BIGINT) AS k, CASE WHEN scan_id % 7 = 3 THEN 'failed' ELSE 'ok' END AS status, count(DISTINCT scan_id) AS scans FROM fsrc GROUP BY 1,2")
def _(t):
    broken = F.when(F.col("scan_id") % 7 == 3, F.expr("substr(report, 1, length(report) - 3)")).otherwise(F.col("report"))
    ok, bad = reports.split_malformed(all_reports(t).withColumn("report", broken))
    both = ok.select("scan_id", F.lit("ok").alias("status")).unionByName(bad.select("scan_id", F.lit("failed").alias("status")))
    return both.groupBy((F.col("scan_id") % 7).alias("k"), "status").agg(F.count_distinct("scan_id").alias("scans"))


@query("src_10_arrival_validation", "scans", sql="""
SELECT id AS scan_id, lower(commit_sha) AS commit_sha, concat_ws(',', CASE WHEN length(trim(commit_sha))=0 THEN 'commit_malformed' END, CASE WHEN CAST(a_price*150 AS BIGINT)>52428800 THEN 'report_too_large' END) AS reject_reasons FROM scans""")
def _(t):
    arrivals = t.scans.select(F.col("id").alias("scan_id"), "project_id", "source", "commit_sha", "branch",
                              F.round(F.col("a_price") * 150).cast("bigint").alias("size_bytes"))
    return reports.validate_arrivals(arrivals).select("scan_id", "commit_sha", F.array_join("reject_reasons", ",").alias("reject_reasons"))


@query("src_11_expected_results", sql="SELECT 'Case' || doc_id AS test_name, CASE WHEN toxic=1 THEN 'true_positive' ELSE 'false_positive' END AS corrected_label, CAST(78+quality AS INT) AS cwe_id, 'benchmark' AS source FROM labels")
def _(t):
    """The labels table written as a ground-truth CSV and read back as trusted labels."""
    path = scratch(t.spark, "expected")
    t.raw_labels.selectExpr("concat('Case', doc_id) AS test_name", "if(quality = 1, 'sqli', 'cmdi') AS category", "toxic = 1 AS vulnerable", "78 + quality AS cwe").write.csv(path, header=True)
    return files.read_expected_results(t.spark, path).select("test_name", "corrected_label", "cwe_id", "source")


def rules_reader(df: DataFrame) -> DataFrame:
    rows = df.select("scan_id", F.get_json_object("report", "$.line").alias("line"))
    p = F.split("line", r"\|")
    none = F.lit(None)
    return reports.normalized(rows, p[0], none, p[1], p[2].try_cast("int"), F.upper(p[3]), F.lit("custom"), none)


@query("ud_02_custom_source", "findings", sql="SELECT scan_id, 'lines' AS source, rule_id, file_path, line_number, severity FROM findings")
def _(t):
    """A registered reader is accepted on arrival and gets its reports from the dispatch."""
    reports.register_reader("lines", rules_reader)
    try:
        text = F.concat_ws("|", "rule_id", "file_path", "line_number", F.lower("severity"))
        arrivals = t.findings.select("scan_id", F.lit(1).cast("bigint").alias("project_id"), F.lit("lines").alias("source"), F.lit("a" * 40).alias("commit_sha"),
                                     F.lit("main").alias("branch"), F.lit(10).cast("bigint").alias("size_bytes"), F.to_json(F.struct(text.alias("line"))).alias("report"))
        accepted = reports.validate_arrivals(arrivals).filter(F.size("reject_reasons") == 0)
        return reports.normalize_reports(accepted).select("scan_id", "source", "rule_id", "file_path", "line_number", "severity")
    finally:
        reports.READERS.pop("lines")


# ---- ingestion ---------------------------------------------------------------
def _arrivals(t) -> DataFrame:
    meta = t.scans.select(F.col("id").alias("scan_id"), "project_id", "commit_sha", "branch")
    broken = F.when(F.col("scan_id") % 7 == 3, F.lit("{nope")).otherwise(F.col("report"))
    return all_reports(t).join(meta, "scan_id").select(
        "scan_id", "project_id", "source", "commit_sha", "branch", F.length("report").cast("bigint").alias("size_bytes"), broken.alias("report"))


SCANS_SQL = """SELECT scan_id, CASE WHEN scan_id%7=3 THEN 'failed' ELSE 'complete' END AS status, CASE WHEN scan_id%7=3 THEN 0 ELSE count(*) END AS total_findings FROM fsrc
 WHERE scan_id IN (SELECT id FROM scans WHERE length(trim(commit_sha))>0) GROUP BY 1"""


@query("jb_01_ingest", "fsrc", "scans", sql=SCANS_SQL)
def _(t):
    out = ingest.ingest(sink.stage(_arrivals(t), "arrivals"), t.rules)
    return out.scans.select("scan_id", "status", "total_findings")


@query("jb_01_ingest_candidates", "fsrc", "scans", sql="""
SELECT scan_id, CAST(least(10, count(*)) AS BIGINT) AS candidates FROM fsrc WHERE scan_id%7<>3 AND scan_id IN (SELECT id FROM scans WHERE length(trim(commit_sha))>0) GROUP BY 1""")
def _(t):
    return ingest.ingest(sink.stage(_arrivals(t), "arrivals"), t.rules).candidates.groupBy("scan_id").agg(F.count(F.lit(1)).alias("candidates"))


@query("ss_01_report_stream", "fsrc", "scans", sql=SCANS_SQL)
def _(t):
    """The same reports as a file stream: written below the shared folder, ingested epoch by epoch."""
    spark = t.spark
    drop, root, cp = (scratch(spark, n) for n in ("arrivals", "ingested", "ingest-checkpoint"))
    arrivals = _arrivals(t)
    arrivals.write.option("compression", "zstd").parquet(drop)
    # two epochs, whatever the number of files
    written = len(spark.read.schema(arrivals.schema).parquet(drop).inputFiles())
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", str(max(1, -(-written // 2)))).parquet(drop)
    jobs.run_ingest(stream, root, t.rules, cp).awaitTermination()
    return jobs.current_scans(spark, root).select("scan_id", "status", "total_findings")


@query("jb_06_review_status", "findings", "contexts", "assessments", "feedback", "runs", sql="""
SELECT (SELECT count(*) FROM findings) AS total_findings, (SELECT count(*) FROM contexts) AS contexts, (SELECT count(DISTINCT finding_id) FROM assessments WHERE reviewer='offensive') AS offensive,
 (SELECT count(DISTINCT finding_id) FROM assessments WHERE reviewer='adjudicator') AS adjudicator, (SELECT count(*) FROM feedback WHERE source='ai_pseudo') AS training_promoted, (SELECT count(*) FROM runs) AS runs, false AS complete""")
def _(t):
    out = ingest.review_status(t.findings, t.assessments, t.feedback, t.contexts, "review-model", t.runs)
    return out.select("total_findings", "contexts", "offensive", "adjudicator", "training_promoted", "runs", "complete")


# ---- model -------------------------------------------------------------------
@query("ml_02_class_weights", "snapshot", sql="""
, n AS (SELECT count(*) FILTER (label='true_positive') AS tp, count(*) FILTER (label='false_positive') AS fp FROM snapshot)
SELECT label, count(*) AS n, CAST(round(count(*)*CASE WHEN label='true_positive' THEN CAST(tp+fp AS DOUBLE)/(2*tp) ELSE CAST(tp+fp AS DOUBLE)/(2*fp) END, 3) AS DOUBLE) AS weight FROM snapshot, n GROUP BY label, tp, fp""")
def _(t):
    rows = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).kept
    counts = metrics.label_counts(rows).first().asDict()
    return training.weighted(rows, counts).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight") * F.count(F.lit(1)), 3).alias("weight"))


@query("ml_04_train_guards", "trusted", "snapshot", sql="""
SELECT (SELECT count(*) FROM trusted) AS labelled, (SELECT count(*) FROM snapshot) AS unique_rows, (SELECT count(*) FROM trusted)>=50 AS enough""")
def _(t):
    built = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=())
    ready = metrics.training_readiness(t.findings, t.feedback)
    unique = built.kept.agg(F.count(F.lit(1)).alias("unique_rows"))
    return beside(ready, unique).select(F.col("total").alias("labelled"), "unique_rows", (F.col("total") >= F.col("required")).alias("enough"))


@query("st_01_training_set", "snapshot", "pseudo", "trusted", sql="""
, r AS (SELECT * FROM (SELECT *, min(label) OVER w AS lo, max(label) OVER w AS hi, row_number() OVER (PARTITION BY fingerprint ORDER BY group_key, sample, id) AS rn FROM pseudo WHERE corrected_label=label WINDOW w AS (PARTITION BY fingerprint)) WHERE lo=hi AND rn=1)
, k AS (SELECT r.* FROM r WHERE fingerprint NOT IN (SELECT fingerprint FROM snapshot) AND (CAST('0x'||substr(sha256(group_key),1,8) AS BIGINT) % 100)>=20)
, lim AS (SELECT label, CAST(floor(count(*)*0.25) AS BIGINT) AS n FROM snapshot WHERE split='train' GROUP BY 1)
, p AS (SELECT x.label_source FROM (SELECT k.*, row_number() OVER (PARTITION BY label ORDER BY fingerprint) AS q FROM k) x JOIN lim USING (label) WHERE q<=lim.n)
SELECT label_source, count(*) AS n FROM (SELECT label_source FROM snapshot WHERE split='train' UNION ALL SELECT label_source FROM p) GROUP BY 1""")
def _(t):
    snap = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=())
    weak = snapshot.pseudo_rows(t.findings, t.scans, t.feedback, snap, keep=())
    rows = sets.union_rows(snap.kept.filter("split = 'train'"), weak.included)
    return rows.groupBy("label_source").agg(F.count(F.lit(1)).alias("n"))


@query("ml_06_quality_gate", "snapshot", sql="""
, m AS (SELECT count(*) FILTER (p) AS flags, count(*) FILTER (p AND label='true_positive') AS tp, count(*) FILTER (label='true_positive') AS pos, count(DISTINCT CASE WHEN label='true_positive' THEN group_key END) AS groups
 FROM (SELECT *, coalesce(tp_probability>=0.8, false) AS p FROM snapshot WHERE split='validation'))
SELECT concat_ws(' ', CASE WHEN pos<5 THEN 'Validation contains only ' || pos || ' true positives; at least 5 are required.' END,
 CASE WHEN groups<2 THEN 'Validation true positives cover only ' || groups || ' project group' || CASE WHEN groups=1 THEN '' ELSE 's' END || '; at least 2 are required.' END,
 CASE WHEN flags<5 THEN 'Candidate flagged only ' || flags || ' validation findings; at least 5 are required.' END,
 CASE WHEN flags>0 AND round(CAST(tp AS DOUBLE)/flags,4)<0.8 THEN 'Candidate precision ' || printf('%.1f', round(CAST(tp AS DOUBLE)/flags,4)*100) || '% is below the 80.0% deployment gate.' END) AS rejection_reason FROM m""")
def _(t):
    """The gate on the scores the findings already have."""
    rows = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).kept.filter("split = 'validation'")
    scored = rows.join(t.findings.select("id", "tp_probability"), "id").withColumn(
        "predicted", F.expr("if(coalesce(tp_probability >= 0.8D, false), 'true_positive', 'false_positive')"))
    counts = metrics.partition_counts(rows, None).first().asDict()
    reason = training.quality_gate(metrics.confusion(scored).first().asDict(), counts)
    return t.spark.createDataFrame([(reason or "",)], "rejection_reason string")


@query("ml_07_active_model", "model_states", sql="SELECT 'models/m' || id AS path, true AS certified FROM model_states WHERE deployment_status='deployed' AND id%4=3 ORDER BY trained_at DESC, id DESC LIMIT 1")
def _(t):
    """All attempts written to a registry; the champion read back, of those months whose artefact is said to be there."""
    registry = scratch(t.spark, "registry")
    rows = derived.model_states(t).withColumn("id", F.col("id").cast("string")).withColumn("trained_at", F.col("trained_at").cast("timestamp"))
    rows.write.parquet(f"{registry}/states")
    active = training.active_model(t.spark, registry, exists=lambda path: int(path.removeprefix("models/m")) % 4 == 3)
    return t.spark.createDataFrame([(active["path"], active["certified"])], "path string, certified boolean")


@query("ml_09_seed", "snapshot", sql="""
, d AS (SELECT sha256(concat(fingerprint, chr(0), group_key, chr(0), label, chr(0), sample)) AS d FROM snapshot)
SELECT CAST('0x' || substr(sha256(concat_ws(':', count(*), CAST(sum(CAST('0x'||substr(d,1,15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x'||substr(d,17,15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x'||substr(d,33,15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x'||substr(d,49,15) AS HUGEINT)) AS VARCHAR))),1,8) AS BIGINT) AS seed FROM d""")
def _(t):
    rows = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).kept
    return metrics.dataset_fingerprint(rows).select(training.random_seed("dataset_fingerprint").alias("seed"))


@query("ml_05_train_and_gate")
def _(t):
    registry = scratch(t.spark, "registry")
    training.train_and_gate(t.findings, t.scans, t.feedback, registry)
    return training.states(t.spark, registry).select("sample_size", "precision", "recall", "f1_score", "flagged_count", "deployment_status", "rejection_reason")


@query("ml_08_batch_scoring")
def _(t):
    attempt = training.train_and_gate(t.findings, t.scans, t.feedback)
    scored = training.score(t.findings, attempt.model)
    return scored.groupBy("predicted_label").agg(F.count(F.lit(1)).alias("findings"), F.round(F.avg("tp_probability"), 4).alias("mean_probability"))


@query("jb_04_train_and_score", "findings", "snapshot", sql="""
SELECT 'held out' AS name, count(*) AS records FROM snapshot WHERE split='validation'
UNION ALL SELECT 'held out positive', count(*) FROM snapshot WHERE split='validation' AND label='true_positive'
UNION ALL SELECT 'held out negative', count(*) FROM snapshot WHERE split='validation' AND label='false_positive'
UNION ALL SELECT 'trained positive', count(*) FROM snapshot WHERE split='train' AND label='true_positive'
UNION ALL SELECT 'trained negative', count(*) FROM snapshot WHERE split='train' AND label='false_positive'
UNION ALL SELECT 'attempts', 1 UNION ALL SELECT 'attempts against the gate', 0
UNION ALL SELECT 'findings', count(*) FROM findings UNION ALL SELECT 'scored', count(*) FROM findings
UNION ALL SELECT 'outside 0 to 1', 0 UNION ALL SELECT 'decided against the thresholds', 0""")
def _(t):
    """One training with the default forest, its record read back, all findings scored: what holds whatever the forest learns."""
    registry = scratch(t.spark, "registry")
    attempt = training.train_and_gate(t.findings, t.scans, t.feedback, registry)
    kept, p, cfg = F.col("rejection_reason").isNull(), F.col("tp_probability"), DEFAULTS
    gate = (kept == (F.col("deployment_status") == "deployed")) & (kept == F.col("model_path").isNotNull()) & (
        ~kept | ((F.col("precision") >= cfg.min_deploy_precision) & (F.col("flagged_count") >= cfg.min_deploy_flags)))
    states = training.states(t.spark, registry).agg(
        F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("held out"), F.sum(F.col("tp") + F.col("fn")).alias("held out positive"),
        F.sum(F.col("fp") + F.col("tn")).alias("held out negative"), F.count(F.lit(1)).alias("attempts"), F.count_if(~gate).alias("attempts against the gate"))
    # probabilities are shown with 4 digits, decisions fall before
    label, off = F.coalesce("predicted_label", F.lit("")), 0.00005
    wrong = (label == "true_positive") & (p < cfg.tp_threshold - off) | (label == "false_positive") & (p > cfg.fp_threshold + off) | (label == "") & (
        (p > cfg.tp_threshold + off) | (p < cfg.fp_threshold - off))
    scored = training.score(t.findings, attempt.model).agg(
        F.count(F.lit(1)).alias("findings"), F.count("tp_probability").alias("scored"),
        F.count_if(~p.between(0, 1)).alias("outside 0 to 1"), F.count_if(wrong).alias("decided against the thresholds"))
    train = attempt.counts["train"]
    learnt = t.spark.createDataFrame([(train["true_positive"], train["false_positive"])], "`trained positive` bigint, `trained negative` bigint")
    return states.unpivot([], states.columns, "name", "records").unionByName(scored.unpivot([], scored.columns, "name", "records")).unionByName(
        learnt.unpivot([], learnt.columns, "name", "records"))


@query("ml_08_cold_start", "findings", sql="SELECT count(*) AS findings, CAST(0 AS BIGINT) AS scored FROM findings")
def _(t):
    return training.score(t.findings, None).agg(F.count(F.lit(1)).alias("findings"), F.count("tp_probability").alias("scored"))


@query("snk_04_manifest", "snapshot", "review", sql="""
SELECT 'train.' || label AS name, count(*) AS records FROM snapshot WHERE split='train' GROUP BY 1 UNION ALL SELECT 'validation.' || label, count(*) FROM snapshot WHERE split='validation' GROUP BY 1
UNION ALL SELECT 'review.available', count(*) FROM review""")
def _(t):
    spark = t.spark
    root = scratch(spark, "export")
    export.export_dataset(t.findings, t.scans, t.feedback, t.assessments, root, "dataset", compression="gzip")
    text = "\n".join(r["value"] for r in spark.read.text(f"{root}/dataset/manifest.json").collect())  # the small manifest
    m = json.loads(text)
    rows = [(f"{p}.{k}", v) for p in ("train", "validation") for k, v in m["labels"][p].items()]
    rows.append(("review.available", m["review_queue"]["available_after_deduplication"]))
    return spark.createDataFrame(rows, "name string, records bigint")


# ---- streams -----------------------------------------------------------------
STATE_SQL = """, s AS (SELECT finding_id, arg_max(action, (decided_at, event_id)) AS action, arg_max(coalesce(label,''), (decided_at, event_id)) AS label, arg_max(rule_id, (decided_at, event_id)) AS rule_id FROM decisions WHERE action IN ('label','undo') GROUP BY 1)
"""


@query("ss_02_decision_state", "decisions", sql=STATE_SQL + "SELECT finding_id, label, rule_id FROM s WHERE action='label'")
def _(t):
    return state.current_decisions(state.decision_state(t.decisions)).select("finding_id", "label", "rule_id")


def _event_stream(t) -> DataFrame:
    """The events table as a stream of several files in time order."""
    from winnow.sources import testdata

    drop = scratch(t.spark, "events")
    events = t.raw_events
    events.repartitionByRange(4, "ts").write.parquet(drop)
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(drop)
    return testdata.decisions_from(stream)


@query("ss_02_decision_stream", "decisions", sql=STATE_SQL + "SELECT finding_id, label, rule_id FROM s WHERE action='label'")
def _(t):
    root, cp = scratch(t.spark, "decisions"), scratch(t.spark, "decisions-checkpoint")
    jobs.run_state(jobs.decision_stream(_event_stream(t)), root, "state", cp).awaitTermination()
    log = t.spark.read.parquet(f"{root}/state")
    return state.current_decisions(state.decision_state(log)).select("finding_id", "label", "rule_id")


RULE_REFRESH = STATE_SQL + """, t AS (SELECT DISTINCT rule_id FROM decisions WHERE action IN ('label','undo'))
SELECT t.rule_id, count(s.finding_id) AS total_seen, count(*) FILTER (s.label='false_positive') AS total_false_positive, CAST(coalesce(round(CAST(count(*) FILTER (s.label='false_positive') AS DOUBLE)/nullif(count(s.finding_id),0),4),0) AS DOUBLE) AS historical_fp_rate
FROM t LEFT JOIN s ON s.rule_id=t.rule_id AND s.action='label' GROUP BY 1"""


@query("ss_03_rule_refresh", "decisions", sql=RULE_REFRESH)
def _(t):
    current = state.current_decisions(state.decision_state(t.decisions))
    return state.refresh_rules(current, state.touched_rules(t.decisions)).select("rule_id", "total_seen", "total_false_positive", "historical_fp_rate")


@query("ss_03_rule_refresh_stream", "decisions", sql=RULE_REFRESH)
def _(t):
    root, cp = scratch(t.spark, "rules"), scratch(t.spark, "rules-checkpoint")
    jobs.run_decisions(_event_stream(t), root, cp).awaitTermination()
    return jobs.current_rule_stats(t.spark, root).select("rule_id", "total_seen", "total_false_positive", "historical_fp_rate")


@query("ss_04_retrain_due", "findings", "model_states", sql="""
SELECT count(*) AS new_labels, count(*)>=100 AS due FROM findings WHERE final_label IS NOT NULL AND updated_at>(SELECT max(trained_at) FROM model_states)""")
def _(t):
    return state.retrain_due(t.findings, derived.model_states(t))


@query("ss_04_retrain_stream", "decisions", sql=STATE_SQL + """, d AS (SELECT finding_id, max(decided_at) AS at FROM decisions WHERE action IN ('label','undo') GROUP BY 1)
, trained AS (SELECT TIMESTAMP '2024-01-15 00:00:00' AS at)
SELECT count(*) AS pending, count(*)>=100 AS waiting FROM s JOIN d USING (finding_id), trained t WHERE s.action='label' AND d.at > t.at""")
def _(t):
    from winnow.sources import testdata

    root, cp, drop = scratch(t.spark, "retrain"), scratch(t.spark, "retrain-checkpoint"), scratch(t.spark, "events")
    events = testdata.decisions_from(t.raw_events)
    # a training ends in the middle of the month
    trained = {"event_id": "0L", "decided_at": "timestamp_ntz'2024-01-15 00:00:00'", "action": "'train'"}
    training = t.raw_events.limit(1).select(*[F.expr(trained.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in events.schema])
    events.unionByName(training).repartitionByRange(4, "decided_at").write.parquet(drop)
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(drop)
    jobs.run_decisions(stream, root, cp).awaitTermination()
    return t.spark.read.parquet(f"{root}/retrain").orderBy(F.col("epoch").desc()).limit(1).select("pending", "waiting")


@query("ss_05_stalled_runs", "runs", sql="""
SELECT id, 'stalled' AS phase FROM runs WHERE status IN ('queued','running','running_with_errors') AND heartbeat_at<=TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 480 SECONDS""")
def _(t):
    return state.stalled_runs(t.runs, F.expr("timestamp_ntz'2000-01-01 00:00:00'")).select("id", "phase")


@query("ss_05_stalled_stream", sql="""
SELECT user_id AS run_id, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_heartbeat, count(*) AS beats FROM events GROUP BY 1 HAVING arg_max(event_type, ts)<>'purchase'""")
def _(t):
    spark = t.spark
    drop, out, cp = (scratch(spark, n) for n in ("beats", "stalls", "stalls-checkpoint"))
    status = F.when(F.col("event_type") == "purchase", "complete").otherwise("running")
    events = t.raw_events.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("heartbeat_at"), status.alias("status"))
    events.repartitionByRange(4, "heartbeat_at").write.parquet(drop)
    jobs.run_stalls(spark.readStream.schema(events.schema).parquet(drop), out, cp).awaitTermination()
    return spark.read.schema("run_id bigint, last_heartbeat timestamp, beats bigint").parquet(out).select(
        "run_id", F.date_format("last_heartbeat", "yyyy-MM-dd HH:mm:ss").alias("last_heartbeat"), "beats")


@query("ss_08_backfill_vectors", "findings", sql="SELECT id, greatest(1, 1) AS cyclomatic_complexity, severity AS scanner_severity FROM findings WHERE NOT has_vector")
def _(t):
    from winnow.operators import features

    todo = features.missing_vectors(t.findings)
    built = features.build_vectors(todo, t.rules.withColumn("historical_fp_rate", F.lit(0.0)))
    return built.select("id", "feature_vector.cyclomatic_complexity", "feature_vector.scanner_severity")


@query("ss_08_stale_contexts", "findings", "contexts", sql="SELECT id FROM findings WHERE id NOT IN (SELECT finding_id FROM contexts WHERE format_version='compact-v2')")
def _(t):
    from winnow.plans import context

    return context.stale_contexts(t.findings, t.contexts).select("id")


@query("ss_09_feedback_upsert", "assessment_feedback", sql="""
, l AS (SELECT assessment_id, user_id, verdict, CASE WHEN verdict='insufficient_context' THEN 'retract' ELSE 'put' END AS action, row_number() OVER (PARTITION BY assessment_id, user_id ORDER BY reviewed_at DESC NULLS LAST, id DESC) AS rn FROM assessment_feedback)
SELECT assessment_id, user_id, verdict FROM l WHERE rn=1 AND action='put'""")
def _(t):
    log = t.assessment_feedback.withColumn("action", F.when(F.col("verdict") == "insufficient_context", "retract").otherwise("put"))
    return state.feedback_state(log).select("assessment_id", "user_id", "verdict")
