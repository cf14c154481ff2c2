"""Queries for filters, joins, aggregations, latest rows, rankings and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derived
from catalog.derived import QUEUE_RANK
from catalog.registry import query
from winnow.functions import scoring
from winnow.operators import filters, joins, latest, metrics, sets, topk

TRUSTED_EXISTS = """EXISTS (SELECT 1 FROM feedback b WHERE b.finding_id=f.id AND b.source IN ('human','benchmark','import')
  AND b.training_eligible AND b.corrected_label=f.final_label)"""
OUT_MODEL = """CASE WHEN predicted_label IS NULL OR cl IS NULL THEN 'unresolved' WHEN predicted_label='true_positive' THEN (CASE WHEN cl='true_positive' THEN 'true_positive' ELSE 'false_positive' END)
  ELSE (CASE WHEN cl='true_positive' THEN 'false_negative' ELSE 'true_negative' END) END"""
OUT_HUMAN = """CASE WHEN truth IS NULL OR cl IS NULL THEN 'unresolved' WHEN cl='true_positive' THEN (CASE WHEN truth='true_positive' THEN 'true_positive' ELSE 'false_positive' END)
  ELSE (CASE WHEN truth='true_positive' THEN 'false_negative' ELSE 'true_negative' END) END"""
CL = "CASE WHEN classification IN ('confirmed_tp','likely_tp') THEN 'true_positive' WHEN classification IN ('confirmed_fp','likely_fp') THEN 'false_positive' END"
UNREVIEWED = """SELECT f.*, c.context_hash FROM findings f JOIN contexts c ON c.finding_id=f.id
  WHERE NOT EXISTS (SELECT 1 FROM assessments a WHERE a.finding_id=f.id AND a.context_hash=c.context_hash AND a.reviewer='adjudicator' AND a.completed_at IS NOT NULL)"""


def ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- filters ----------------------------------------------------------------
@query("flt_01_findings_filter", "findings", sql="""
SELECT id, scan_id, tp_probability FROM findings WHERE predicted_label='true_positive' AND tp_probability>=0.9 AND status='triaged' AND final_label='true_positive'""")
def _(t):
    return filters.filter_findings(t.findings, predicted_label="true_positive", min_probability=0.9, status="triaged",
                                   tab="true_positive").select("id", "scan_id", "tp_probability")


@query("flt_02_unlabelled_queue", "findings", "scans", sql="""
SELECT f.id, f.rule_id FROM findings f JOIN scans s ON s.id=f.scan_id WHERE f.final_label IS NULL AND s.project_id=7 AND severity='HIGH'""")
def _(t):
    return filters.queue_filter(t.findings, t.scans, project=7, severity="HIGH").select("id", "rule_id")


@query("flt_03_trusted_labels", "findings", "feedback", sql=f"SELECT id, final_label FROM findings f WHERE has_vector AND final_label IS NOT NULL AND {TRUSTED_EXISTS}")
def _(t):
    return filters.trusted(t.findings, t.feedback).select("id", "final_label")


@query("flt_04_pseudo_labels", "findings", "feedback", sql="""
SELECT id, final_label FROM findings f WHERE has_vector AND final_label IS NOT NULL AND EXISTS (SELECT 1 FROM feedback b WHERE b.finding_id=f.id AND b.source='ai_pseudo' AND b.training_eligible)""")
def _(t):
    return filters.pseudo(t.findings, t.feedback).select("id", "final_label")


@query("flt_05_untrusted_labels", "findings", "feedback", sql=f"SELECT id, final_label FROM findings f WHERE has_vector AND final_label IS NOT NULL AND NOT {TRUSTED_EXISTS}")
def _(t):
    return filters.untrusted(t.findings, t.feedback).select("id", "final_label")


@query("flt_06_comment_candidates", "findings", sql="""
SELECT id, '**Likely true positive (' || CAST(round(tp_probability*100) AS INT) || '% confidence)**' || chr(10) || chr(10) || message || chr(10) || chr(10) || 'Rule: `' || rule_id || '` | CWE-' || coalesce(CAST(cwe_id AS VARCHAR),'') || ' | Severity: ' || severity AS body
FROM findings WHERE predicted_label='true_positive' AND tp_probability>0.8 AND status='pending'""")
def _(t):
    return filters.comment_candidates(t.findings).select("id", "body")


@query("flt_07_auto_suppression", "findings", sql="""
SELECT scan_id, count(*) AS suppressed_count FROM findings WHERE predicted_label='false_positive' AND tp_probability<=0.15 GROUP BY 1""")
def _(t):
    return filters.suppressed(t.findings).groupBy("scan_id").agg(F.count(F.lit(1)).alias("suppressed_count"))


@query("flt_08_high_confidence", "findings", sql="SELECT id, coalesce(predicted_label='true_positive' AND tp_probability>=0.8, false) AS high_confidence FROM findings")
def _(t):
    return t.findings.select("id", scoring.high_confidence("predicted_label", "tp_probability").alias("high_confidence"))


@query("flt_09_severity_gate", "findings", sql="""
SELECT 'CRITICAL' AS threshold, coalesce(bool_or(severity='CRITICAL'), false) AS failed FROM findings WHERE status='pending'
UNION ALL SELECT 'NONE', false""")
def _(t):
    pending = t.findings.filter(F.col("status") == "pending")
    return filters.severity_gate(pending, "critical").select(F.lit("CRITICAL").alias("threshold"), "failed").unionByName(
        filters.severity_gate(pending, "none").select(F.lit("NONE").alias("threshold"), "failed"))


@query("flt_10_promotable", "findings", "feedback", "assessments", sql=f"""
SELECT a.id AS assessment_id, a.finding_id, a.classification, {CL.replace('classification', 'a.classification')} AS label FROM assessments a JOIN findings f ON f.id=a.finding_id
WHERE a.reviewer='adjudicator' AND a.classification<>'needs_validation' AND a.confidence>=0.85 AND f.final_label IS NULL AND f.has_vector
AND NOT EXISTS (SELECT 1 FROM feedback b WHERE b.finding_id=f.id)""")
def _(t):
    return filters.promotable(t.assessments, t.findings, t.feedback).select("assessment_id", "finding_id", "classification", "label")


@query("flt_11_verdict_validation", "assessment_feedback", sql="""
SELECT id, concat_ws(',', CASE WHEN verdict IN ('incorrect','partially_correct') AND corrected_classification IS NULL THEN 'correction_required' END,
  CASE WHEN len(list_distinct(reason_codes))<len(reason_codes) THEN 'reason_codes_repeat' END,
  CASE WHEN list_contains(reason_codes,'bogus') THEN 'reason_code_unknown' END) AS reject_reasons FROM assessment_feedback""")
def _(t):
    return filters.validate_feedback(t.assessment_feedback).select("id", F.array_join("reject_reasons", ",").alias("reject_reasons"))


# ---- joins ------------------------------------------------------------------
@query("jn_01_finding_rule", "findings", "rules", sql="""
SELECT f.id, f.rule_id, coalesce(r.description,'') AS description FROM findings f LEFT JOIN rules r ON r.external_id=f.rule_id""")
def _(t):
    return joins.with_rule(t.findings, t.rules).select("id", "rule_id", F.coalesce("rule_description", F.lit("")).alias("description"))


@query("jn_02_finding_scan_project", "findings", "scans", "projects", sql="""
SELECT f.id, p.name, s.source, s.branch FROM findings f JOIN scans s ON s.id=f.scan_id JOIN projects p ON p.id=s.project_id""")
def _(t):
    return joins.with_scan(t.findings, t.scans, t.projects).select("id", F.col("project_name").alias("name"), F.col("scanner_source").alias("source"), "branch")


@query("jn_03_finding_feedback", "findings", "feedback", sql="""
SELECT f.id, coalesce(b.corrected_label,'') AS corrected_label, coalesce(b.source,'') AS source FROM findings f LEFT JOIN feedback b ON b.finding_id=f.id""")
def _(t):
    e = F.lit("")
    return joins.with_feedback(t.findings, t.feedback).select(
        "id", F.coalesce("feedback_corrected_label", e).alias("corrected_label"), F.coalesce("feedback_source", e).alias("source"))


@query("jn_04_existence", "findings", "contexts", "assessments", sql="""
SELECT id FROM findings f WHERE EXISTS (SELECT 1 FROM contexts c WHERE c.finding_id=f.id) AND EXISTS (SELECT 1 FROM assessments a WHERE a.finding_id=f.id AND a.reviewer='adjudicator')""")
def _(t):
    return joins.having(t.findings, t.contexts, t.assessments).select("id")


@query("jn_05_unreviewed_evidence", "findings", "contexts", "assessments", sql=f"SELECT id, context_hash FROM ({UNREVIEWED})")
def _(t):
    return joins.unreviewed(t.findings, t.contexts, t.assessments).select("id", "context_hash")


@query("jn_06_fresh_evidence", "contexts", "assessments", sql="""
SELECT a.id, a.reviewer FROM assessments a JOIN contexts c ON c.finding_id=a.finding_id AND c.context_hash=a.context_hash""")
def _(t):
    return joins.fresh(t.assessments, t.contexts).select("id", "reviewer")


@query("jn_07_pseudo_minus_trusted", "pseudo", "trusted", sql="""
SELECT id, fingerprint FROM pseudo p WHERE NOT EXISTS (SELECT 1 FROM trusted t WHERE t.fingerprint=p.fingerprint)""")
def _(t):
    from winnow.plans import snapshot

    rows = snapshot.identified(t.findings, t.scans)
    return sets.minus_fingerprints(filters.pseudo(rows, t.feedback), filters.trusted(rows, t.feedback)).select("id", "fingerprint")


WINDOW_SQL = """
SELECT CAST(f.id AS BIGINT) AS id, CAST(count(*) AS BIGINT) AS lines, CAST(min(l.line_no) AS INT) AS first_line, CAST(max(l.line_no) AS INT) AS last_line, count(*) FILTER (l.line_no=f.line_no) AS flagged,
  sha256(string_agg(l.text, chr(10) ORDER BY l.line_no)) AS code_sha
FROM code_lines f JOIN code_lines l ON l.file_path=f.file_path AND l.line_no BETWEEN f.line_no-{r} AND f.line_no+{r} GROUP BY 1"""


def _flagged_lines(t):
    """Every code line as the flagged line of its own finding."""
    return t.code_lines.select((F.col("doc_id") * 100000 + F.col("line_no")).alias("id"), "file_path", F.col("line_no").alias("line_number"))


@query("jn_08_line_window", "code_lines", sql=WINDOW_SQL.replace("f.id AS BIGINT", "f.doc_id*100000+f.line_no AS BIGINT").format(r=8))
def _(t):
    w = joins.line_window(_flagged_lines(t), t.code_lines, 8)
    return w.select(
        "id", F.size("window").cast("bigint").alias("lines"), F.element_at("window", 1)["line_no"].alias("first_line"),
        F.element_at("window", -1)["line_no"].alias("last_line"),
        F.size(F.filter("window", lambda x: x["flagged"])).cast("bigint").alias("flagged"),
        F.sha2(F.array_join(F.transform("window", lambda x: x["text"]), "\n"), 256).alias("code_sha"))


@query("jn_09_author_level", "findings", "blame", "commits", sql="""
, n AS (SELECT author, count(*) AS c FROM commits GROUP BY 1)
SELECT f.id, CASE WHEN b.author IS NULL THEN 'unknown' WHEN coalesce(n.c,0)>=200 THEN 'senior' WHEN coalesce(n.c,0)>=30 THEN 'mid' ELSE 'junior' END AS level
FROM findings f LEFT JOIN blame b ON b.file_path=f.file_path AND b.line_no=f.line_number LEFT JOIN n ON n.author=b.author""")
def _(t):
    return joins.author_level(t.findings, t.blame, t.commits).select("id", F.col("developer_experience_lvl").alias("level"))


@query("jn_10_register_rules", "findings", "rules", sql="""
SELECT external_id, coalesce(cwe_id,-1) AS cwe_id, false AS is_new FROM rules WHERE a_brand<20
UNION ALL SELECT rule_id, coalesce(arg_min_null(cwe_id, id),-1), true FROM findings f WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.a_brand<20 AND r.external_id=f.rule_id) GROUP BY rule_id""")
def _(t):
    known = t.rules.filter(F.col("a_brand") < 20)
    return joins.register_rules(t.findings, known).select("external_id", F.coalesce("cwe_id", F.lit(-1)).alias("cwe_id"), "is_new")


@query("jn_11_guidance", "findings", sql="""
SELECT id, CASE cwe_id WHEN 78 THEN 'Command injection' WHEN 22 THEN 'Path traversal' WHEN 89 THEN 'SQL injection' WHEN 79 THEN 'Cross-site scripting' WHEN 502 THEN 'Unsafe deserialization' WHEN 327 THEN 'Weak hashing' ELSE 'Security finding' END AS title FROM findings""")
def _(t):
    return joins.with_guidance(t.findings).select("id", "title")


@query("jn_12_finding_report", "findings", "scans", "projects", "feedback", "latest", "blame", sql=f"""
, o AS (SELECT f.id, a.classification AS ac, d.classification AS dc, f.predicted_label FROM findings f LEFT JOIN latest a ON a.finding_id=f.id AND a.reviewer='offensive' LEFT JOIN latest d ON d.finding_id=f.id AND d.reviewer='defensive')
, w AS (SELECT f.id, count(*) AS n, max(CASE WHEN l.line_no=f.line_number THEN l.author END) AS flagged FROM findings f JOIN blame l ON l.file_path=f.file_path AND l.line_no BETWEEN f.line_number-8 AND f.line_number+8 GROUP BY 1)
SELECT f.id, p.name AS project, coalesce(rtrim(p.source_path,'/') || '/' || replace(f.file_path,'\\','/'), '') AS absolute,
  array_to_string(list_slice(string_split(replace(f.file_path,'\\','/'),'/'),1,-2),'/') AS directory, coalesce(b.notes,'') AS reviewer_note,
  coalesce((SELECT {OUT_MODEL} FROM (SELECT f.predicted_label, {CL} AS cl FROM (SELECT o.ac AS classification)) ) , 'none') AS offensive_outcome,
  o.dc IS NOT NULL AS has_defensive, w.id IS NOT NULL AS has_code, CAST(coalesce(w.n, 0) AS INT) AS code_lines, coalesce(w.flagged, '') AS flagged
FROM findings f LEFT JOIN w ON w.id=f.id JOIN scans s ON s.id=f.scan_id JOIN projects p ON p.id=s.project_id JOIN o ON o.id=f.id LEFT JOIN feedback b ON b.finding_id=f.id
""".replace("coalesce((SELECT", "CASE WHEN o.ac IS NULL THEN 'none' ELSE (SELECT").replace(", 'none') AS offensive_outcome", " END AS offensive_outcome"))
def _(t):
    # the lines with a known author stand for the source of the findings' files
    lines = t.blame.select("file_path", "line_no", F.col("author").alias("text"))
    rep = joins.finding_report(t.findings, t.scans, t.projects, t.feedback, t.assessments, lines)
    e = F.lit("")
    return rep.select(
        "id", "finding.project", F.coalesce("location.absolute", e).alias("absolute"), "location.directory",
        F.coalesce("why.reviewer_note", e).alias("reviewer_note"),
        F.coalesce(F.col("reviewers")[0]["evaluation_outcome"], F.lit("none")).alias("offensive_outcome"),
        F.col("reviewers")[1]["available"].alias("has_defensive"), F.col("code.available").alias("has_code"),
        F.coalesce(F.size("code.lines"), F.lit(0)).alias("code_lines"),
        F.coalesce(F.get(F.filter("code.lines", lambda w: w["flagged"]), F.lit(0))["text"], e).alias("flagged"))


@query("jn_13_scan_detail", "findings", "feedback", "latest", "assessment_feedback", sql=f"""
, mine AS (SELECT assessment_id, arg_max(verdict, (reviewed_at, id)) AS v FROM (SELECT * FROM assessment_feedback WHERE user_id=3) GROUP BY 1)
, j AS (SELECT f.id, f.predicted_label, CASE WHEN coalesce(b.source,'')='ai_pseudo' THEN NULL ELSE f.final_label END AS truth, a.reviewer, a.classification, {CL} AS cl, m.v
  FROM findings f LEFT JOIN feedback b ON b.finding_id=f.id LEFT JOIN latest a ON a.finding_id=f.id LEFT JOIN mine m ON m.assessment_id=a.id)
SELECT id, coalesce(min(truth),'') AS trusted_final_label, coalesce(string_agg(reviewer || ':' || classification || ':' || {OUT_MODEL} || ':' || {OUT_HUMAN} || ':' || coalesce(v,'-'), ' ' ORDER BY CASE reviewer WHEN 'adjudicator' THEN 0 WHEN 'offensive' THEN 1 ELSE 2 END),'') AS reviews
FROM j GROUP BY id""")
def _(t):
    d = joins.scan_detail(t.findings, t.rules, t.feedback, t.assessments, t.assessment_feedback, user_id=3, size=None)
    text = F.transform("reviews", lambda r: F.concat_ws(
        ":", r["reviewer"], r["classification"], r["evaluation_outcome"], r["human_evaluation_outcome"], F.coalesce(r["own_verdict"], F.lit("-"))))
    return d.select("id", F.coalesce("trusted_final_label", F.lit("")).alias("trusted_final_label"), F.array_join(text, " ").alias("reviews"))


# ---- aggregations -----------------------------------------------------------
RULE_STATS = f"""SELECT rule_id, count(*) AS total_seen, count(*) FILTER (final_label='false_positive') AS total_false_positive,
  CAST(round(CAST(count(*) FILTER (final_label='false_positive') AS DOUBLE)/CAST(count(*) AS DOUBLE),4) AS DOUBLE) AS historical_fp_rate
  FROM findings f WHERE final_label IS NOT NULL AND {TRUSTED_EXISTS} GROUP BY rule_id"""


@query("ag_01_rule_fp_rate", "findings", "feedback", sql=RULE_STATS)
def _(t):
    return metrics.rule_stats(t.findings, t.feedback).drop("recommended_action")


@query("ag_02_rule_recommendation", "findings", "feedback", sql=f"""
SELECT rule_id, coalesce(CASE WHEN total_seen<20 THEN NULL WHEN historical_fp_rate>0.55 THEN 'suppress' WHEN historical_fp_rate>0.5 THEN 'review_config' END,'') AS action FROM ({RULE_STATS})""")
def _(t):
    from winnow.settings import Settings

    s = Settings(rule_suppress_rate=0.55, rule_review_rate=0.5)
    return metrics.rule_stats(t.findings, t.feedback, s).select("rule_id", F.coalesce("recommended_action", F.lit("")).alias("action"))


@query("ag_03_noisy_rules", "findings", "feedback", sql=f"""
SELECT * FROM (SELECT *, CASE WHEN total_seen<20 THEN NULL WHEN historical_fp_rate>0.55 THEN 'suppress' WHEN historical_fp_rate>0.5 THEN 'review_config' END AS recommended_action FROM ({RULE_STATS}))
WHERE total_seen>=20 AND recommended_action IS NOT NULL ORDER BY historical_fp_rate DESC""")
def _(t):
    from winnow.settings import Settings

    s = Settings(rule_suppress_rate=0.55, rule_review_rate=0.5)
    return metrics.noisy_rules(metrics.rule_stats(t.findings, t.feedback, s))


@query("ag_04_scan_summary", "findings", "scans", sql="""
SELECT s.id, count(f.id) AS findings_count, count(*) FILTER (f.predicted_label='true_positive') AS true_positive_count,
 count(*) FILTER (f.predicted_label='false_positive') AS false_positive_count, count(*) FILTER (f.status='pending') AS pending_triage_count
FROM scans s LEFT JOIN findings f ON f.scan_id=s.id GROUP BY 1""")
def _(t):
    return metrics.scan_summary(t.scans.select("id"), t.findings)


@query("ag_05_review_coverage", "findings", "contexts", "assessments", sql="""
SELECT scan_id, count(*) FILTER (id IN (SELECT finding_id FROM contexts)) AS ai_context_count,
 count(*) FILTER (id IN (SELECT finding_id FROM assessments WHERE reviewer='adjudicator')) AS ai_reviewed_count FROM findings GROUP BY 1""")
def _(t):
    return metrics.scan_review_coverage(t.findings, t.contexts, t.assessments)


@query("ag_06_project_rollup", "projects", "scans", "findings", sql="""
, fc AS (SELECT s.project_id, count(*) AS total, count(final_label) AS labelled, count(*) FILTER (final_label='true_positive') AS true_positive FROM findings f JOIN scans s ON s.id=f.scan_id GROUP BY 1)
, sc AS (SELECT project_id, count(*) AS scans_count, max(created_at) AS last FROM scans GROUP BY 1)
SELECT p.id, p.name, coalesce(scans_count,0) AS scans_count, coalesce(strftime(last,'%Y-%m-%d %H:%M:%S'),'') AS last_scanned_at, coalesce(total,0) AS total, coalesce(labelled,0) AS labelled,
 coalesce(true_positive,0) AS true_positive, coalesce(total-labelled,0) AS pending
FROM projects p LEFT JOIN sc ON sc.project_id=p.id LEFT JOIN fc ON fc.project_id=p.id""")
def _(t):
    return metrics.project_rollup(t.projects.select("id", "name"), t.scans, t.findings).withColumn(
        "last_scanned_at", F.coalesce(ts("last_scanned_at"), F.lit("")))


@query("ag_07_training_readiness", "trusted", sql="""
SELECT count(*) AS total, count(*) FILTER (label='true_positive') AS true_positive, count(*) FILTER (label='false_positive') AS false_positive, CAST(50 AS BIGINT) AS required,
 count(*)>=50 AND bool_or(label='true_positive') AND bool_or(label='false_positive') AS ready FROM trusted""")
def _(t):
    return metrics.training_readiness(t.findings, t.feedback)


@query("ag_08_partition_counts", "snapshot", sql="""
SELECT split, count(*) AS samples, count(*) FILTER (label='true_positive') AS true_positive, count(*) FILTER (label='false_positive') AS false_positive,
 count(DISTINCT group_key) AS groups, count(DISTINCT CASE WHEN label='true_positive' THEN group_key END) AS true_positive_groups FROM snapshot GROUP BY 1""")
def _(t):
    from winnow.plans import snapshot

    return metrics.partition_counts(snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).kept)


@query("ag_09_reviewer_coverage", "assessments", sql="SELECT reviewer, count(DISTINCT finding_id) AS findings FROM assessments GROUP BY 1")
def _(t):
    return metrics.reviewer_coverage(t.assessments)


CELLS = ", ".join(f"count(*) FILTER (outcome='{n}') AS {n}" for n in ["true_positive", "false_positive", "true_negative", "false_negative", "unresolved"])


@query("ag_10_outcome_vs_model", "findings", "latest", sql=f"""
SELECT reviewer, {CELLS} FROM (SELECT reviewer, {OUT_MODEL} AS outcome FROM (SELECT l.reviewer, f.predicted_label, {CL} AS cl FROM latest l JOIN findings f ON f.id=l.finding_id WHERE l.reviewer IN ('offensive','defensive'))) GROUP BY 1""")
def _(t):
    return metrics.outcome_matrix(t.assessments, t.findings)


@query("ag_11_outcome_vs_human", "findings", "feedback", "latest", sql=f"""
SELECT reviewer, {CELLS}, count(*) FILTER (outcome='awaiting_review') AS awaiting_review FROM (SELECT reviewer, CASE WHEN truth IS NULL THEN 'awaiting_review' ELSE {OUT_HUMAN} END AS outcome FROM
 (SELECT l.reviewer, CASE WHEN coalesce(b.source,'')='ai_pseudo' THEN NULL ELSE f.final_label END AS truth, {CL} AS cl FROM latest l JOIN findings f ON f.id=l.finding_id LEFT JOIN feedback b ON b.finding_id=f.id WHERE l.reviewer IN ('offensive','defensive'))) GROUP BY 1""")
def _(t):
    return metrics.human_outcome_matrix(t.assessments, t.findings, t.feedback)


@query("ag_12_confusion", "findings", "feedback", sql=f"""
, c AS (SELECT severity, count(*) AS sample_size, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn
 FROM (SELECT severity, coalesce(tp_probability>=0.8,false) AS p, final_label='true_positive' AS t FROM findings f WHERE has_vector AND final_label IS NOT NULL AND {TRUSTED_EXISTS}) GROUP BY 1)
, m AS (SELECT *, CAST(tp AS DOUBLE)/nullif(tp+fp,0) AS p, CAST(tp AS DOUBLE)/nullif(tp+fn,0) AS r FROM c)
SELECT severity, sample_size, tp, fp, fn, tn, CAST(coalesce(round(p,4),0) AS DOUBLE) AS precision, CAST(coalesce(round(r,4),0) AS DOUBLE) AS recall, CAST(coalesce(round(2*p*r/nullif(p+r,0),4),0) AS DOUBLE) AS f1_score, tp+fp AS flagged_count, tp+fp>0 AS precision_defined,
 CAST(round(CAST(tp+fp AS DOUBLE)/greatest(1,sample_size),4) AS DOUBLE) AS coverage FROM m""")
def _(t):
    rows = filters.trusted(t.findings, t.feedback).select(
        "severity", F.col("final_label").alias("label"),
        F.when(F.coalesce(F.col("tp_probability") >= 0.8, F.lit(False)), "true_positive").otherwise("false_positive").alias("predicted"))
    return metrics.confusion(rows, ["severity"])


@query("ag_13_flag_coverage", "findings", sql="""
SELECT count(*) FILTER (p) AS flagged_count, count(*) FILTER (p)>0 AS precision_defined, CAST(round(CAST(count(*) FILTER (p) AS DOUBLE)/count(*),4) AS DOUBLE) AS coverage
FROM (SELECT coalesce(tp_probability>=0.8,false) AS p FROM findings WHERE final_label IS NOT NULL)""")
def _(t):
    rows = t.findings.filter(F.col("final_label").isNotNull()).select(
        F.col("final_label").alias("label"),
        F.when(F.coalesce(F.col("tp_probability") >= 0.8, F.lit(False)), "true_positive").otherwise("false_positive").alias("predicted"))
    return metrics.confusion(rows).select("flagged_count", "precision_defined", "coverage")


@query("ag_14_avg_inference_seconds", "assessments", sql="""
SELECT avg(CASE WHEN total_duration>0 THEN CAST(total_duration AS DOUBLE)/1e9 END) AS average_seconds FROM (SELECT total_duration FROM assessments WHERE reviewer IN ('offensive','defensive') AND prompt_version='p1' AND total_duration IS NOT NULL ORDER BY completed_at DESC NULLS LAST, id DESC LIMIT 20)""")
def _(t):
    return metrics.avg_inference_seconds(t.assessments)


@query("ag_15_pending_per_rule", "findings", sql="SELECT rule_id, coalesce(cwe_id,-1) AS cwe_id, count(*) AS pending FROM findings WHERE final_label IS NULL GROUP BY 1,2")
def _(t):
    return metrics.rule_breakdown(t.findings).withColumn("cwe_id", F.coalesce("cwe_id", F.lit(-1)))


@query("ag_16_counts_by_rule_and_severity", "findings", sql="SELECT severity AS name, count(*) AS findings FROM findings GROUP BY 1 UNION ALL SELECT rule_id, count(*) FROM findings GROUP BY 1")
def _(t):
    f = t.findings
    return metrics.scan_breakdown(f).withColumnRenamed("severity", "name").unionByName(
        metrics.scan_breakdown(f, "rule_id").withColumnRenamed("rule_id", "name"))


@query("ag_17_label_and_source_counts", "findings", "feedback", sql="""
SELECT 'source:' || coalesce(b.source,'unattributed') AS name, count(*) AS records FROM findings f LEFT JOIN feedback b ON b.finding_id=f.id WHERE final_label IS NOT NULL GROUP BY 1
UNION ALL SELECT 'label:' || final_label, count(*) FROM findings WHERE final_label IS NOT NULL GROUP BY 1""")
def _(t):
    rows = joins.with_feedback(filters.filter_findings(t.findings).filter(F.col("final_label").isNotNull()), t.feedback).select(
        F.col("feedback_source").alias("label_source"), F.col("final_label").alias("label"))
    src = metrics.source_counts(rows).select(F.concat(F.lit("source:"), "label_source").alias("name"), "records")
    lab = metrics.label_counts(rows).select(F.explode(F.array(*[
        F.struct(F.lit(f"label:{v}").alias("name"), F.col(v).alias("records")) for v in ("true_positive", "false_positive")])).alias("x")).select("x.*")
    return src.unionByName(lab)


@query("ag_19_exclusions", "trusted", sql="""
SELECT CAST(coalesce(sum(n-1) FILTER (lo=hi),0) AS BIGINT) AS excluded_duplicates, CAST(coalesce(sum(n) FILTER (lo<>hi),0) AS BIGINT) AS excluded_conflicts, CAST(0 AS BIGINT) AS excluded_inconsistent_labels
FROM (SELECT fingerprint, count(*) AS n, min(label) AS lo, max(label) AS hi FROM trusted GROUP BY 1)""")
def _(t):
    from winnow.plans import snapshot

    return metrics.exclusion_stats(snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).deduped)


@query("ag_20_tp_per_rule", "snapshot", sql="SELECT rule_id, count(*) AS tp_count FROM snapshot WHERE label='true_positive' GROUP BY 1")
def _(t):
    from winnow.plans import snapshot

    return metrics.tp_per_rule(snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=["rule_id"]).kept)


@query("ag_21_ambiguous_vectors", "snapshot", sql="SELECT id, feature_sha256, ambiguous_feature FROM snapshot")
def _(t):
    from winnow.plans import snapshot

    return snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).rows.select("id", "feature_sha256", "ambiguous_feature")


@query("ag_22_dataset_fingerprint", "snapshot", sql="""
, d AS (SELECT sha256(concat(fingerprint, chr(0), group_key, chr(0), label, chr(0), sample)) AS d FROM snapshot)
SELECT sha256(concat_ws(':', count(*), CAST(sum(CAST('0x'||substr(d,1,15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x'||substr(d,17,15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x'||substr(d,33,15) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x'||substr(d,49,15) AS HUGEINT)) AS VARCHAR))) AS dataset_fingerprint FROM d""")
def _(t):
    from winnow.plans import snapshot

    return metrics.dataset_fingerprint(snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).kept)


@query("ag_23_run_progress", "runs", "assessments", sql="""
, s AS (SELECT r.id, u.pos-1 AS pos, u.fid FROM (SELECT id, unnest(candidate_finding_ids) AS fid, generate_subscripts(candidate_finding_ids,1) AS pos FROM runs) u JOIN runs r ON r.id=u.id)
, fl AS (SELECT finding_id, bool_or(reviewer='adjudicator' AND completed_at IS NOT NULL) AS adj, bool_or(reviewer='offensive' AND model='review-model' AND completed_at IS NOT NULL) AS off_done, bool_or(reviewer='defensive' AND model='review-model' AND completed_at IS NOT NULL) AS def_done,
  bool_or(reviewer='offensive' AND model='review-model') AS off_any, bool_or(reviewer='defensive' AND model='review-model') AS def_any FROM assessments GROUP BY 1)
, b AS (SELECT *, len(candidate_finding_ids) AS n, greatest(0, least(len(candidate_finding_ids), next_step-len(candidate_finding_ids))) AS processed, least(len(candidate_finding_ids), next_step) AS offs FROM runs)
, c AS (SELECT b.id, count(*) FILTER (adj AND pos<processed) AS reviewed, count(*) FILTER (off_done AND pos<offs) AS o, count(*) FILTER (def_done AND pos<processed) AS d, count(*) FILTER (off_any)+count(*) FILTER (def_any) AS anyc FROM b JOIN s ON s.id=b.id LEFT JOIN fl ON fl.finding_id=s.fid GROUP BY 1)
SELECT b.id, b.status, CAST(processed AS INT) AS processed, reviewed, greatest(0, processed-reviewed) AS failed, (o<offs OR d<processed) AS has_errors, CAST(least(2*n, greatest(least(2*n, anyc), next_step)) AS BIGINT) AS completed_steps,
  CAST(floor(least(2*n, greatest(least(2*n, anyc), next_step))*100/(2*n)) AS INT) AS progress_percent,
  CAST(CASE WHEN status IN ('complete','complete_with_errors','failed','skipped') THEN 0 ELSE (2*n-least(2*n, greatest(least(2*n, anyc), next_step)))*30 END AS BIGINT) AS estimated_remaining_seconds
FROM b JOIN c ON c.id=b.id""")
def _(t):
    p = metrics.run_progress(t.runs, t.assessments, "review-model", F.lit(30.0))
    return p.select("id", "status", "processed", "reviewed", "failed", "has_errors", F.col("completed_steps").cast("bigint"), "progress_percent", "estimated_remaining_seconds")


@query("ag_24_coverage_tree", "code_lines", sql="""
, files AS (SELECT DISTINCT file_path FROM code_lines)
SELECT split_part(file_path,'/',1) AS name, count(*) FILTER (split_part(file_path,'/',1)<>'Vendor' AND file_path NOT LIKE '%/public/%') AS php_files, split_part(file_path,'/',1)<>'Vendor' AS included FROM files GROUP BY 1""")
def _(t):
    return metrics.coverage_tree(t.code_lines.select(F.col("file_path").alias("path")).distinct())


@query("ag_25_promotion_counts", "findings", "feedback", "assessments", sql="""
SELECT (SELECT count(*) FROM assessments a JOIN findings f ON f.id=a.finding_id WHERE a.reviewer='adjudicator' AND a.classification<>'needs_validation' AND a.confidence>=0.85 AND f.final_label IS NULL AND f.has_vector) AS eligible,
 (SELECT count(*) FROM feedback WHERE source='ai_pseudo') AS promoted""")
def _(t):
    return metrics.promotion_counts(t.assessments, t.findings, t.feedback)


# ---- latest and representative rows -----------------------------------------
@query("wn_01_latest_assessment", "latest", sql="SELECT id, finding_id, reviewer, classification FROM latest")
def _(t):
    return latest.latest_assessment(t.assessments).select("id", "finding_id", "reviewer", "classification")


@query("wn_02_latest_feedback", "assessment_feedback", sql="""
SELECT id, assessment_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY reviewed_at DESC NULLS LAST, id DESC) AS rn FROM assessment_feedback) WHERE rn=1""")
def _(t):
    return latest.latest_feedback(t.assessment_feedback).select("id", "assessment_id", "verdict")


@query("wn_03_latest_trusted_triage", "feedback", sql="""
SELECT finding_id, source, notes FROM feedback WHERE source<>'ai_pseudo' AND NOT starts_with(notes,'AI training label from') AND NOT starts_with(notes,'AI_PROMOTED')""")
def _(t):
    return latest.latest_trusted_triage(t.feedback).select("finding_id", "source", "notes")


@query("wn_04_dedupe_context", "contexts", "assessments", sql="""
SELECT id, reviewer, context_hash FROM (SELECT a.*, row_number() OVER (PARTITION BY a.reviewer, a.context_hash ORDER BY completed_at DESC NULLS LAST, a.id DESC) AS rn FROM assessments a JOIN contexts c ON c.finding_id=a.finding_id AND c.context_hash=a.context_hash) WHERE rn=1""")
def _(t):
    return latest.dedupe_context(joins.fresh(t.assessments, t.contexts)).select("id", "reviewer", "context_hash")


@query("wn_05_fingerprint_representative", "dedup", sql="SELECT id, fingerprint, label, duplicate_count FROM dedup")
def _(t):
    from winnow.plans import snapshot

    d = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).deduped
    return d.filter(~F.col("label_conflict")).select("id", "fingerprint", "label", "duplicate_count")


@query("wn_08_pseudo_cap", "pseudo", "trusted", "snapshot", sql="""
, r AS (SELECT * FROM (SELECT *, count(*) OVER w AS dc, min(label) OVER w AS lo, max(label) OVER w AS hi, row_number() OVER (PARTITION BY fingerprint ORDER BY group_key, sample, id) AS rn FROM pseudo WHERE corrected_label=label WINDOW w AS (PARTITION BY fingerprint)) WHERE lo=hi AND rn=1)
, k AS (SELECT r.*, CASE WHEN (CAST('0x'||substr(sha256(group_key),1,8) AS BIGINT) % 100)<20 THEN 'validation' ELSE 'train' END AS split FROM r WHERE fingerprint NOT IN (SELECT fingerprint FROM snapshot))
, lim AS (SELECT label, CAST(floor(count(*)*0.25) AS BIGINT) AS n FROM snapshot WHERE split='train' GROUP BY 1)
SELECT id, label FROM (SELECT k.*, row_number() OVER (PARTITION BY label ORDER BY fingerprint) AS q FROM k WHERE split='train') x JOIN lim USING (label) WHERE q<=lim.n""")
def _(t):
    from winnow.plans import snapshot

    snap = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=())
    return snapshot.pseudo_rows(t.findings, t.scans, t.feedback, snap, keep=()).included.select("id", "label")


@query("wn_09_latest_run", "runs", sql="SELECT scan_id, max(id) AS id FROM runs GROUP BY 1")
def _(t):
    return latest.latest_run(t.runs).select("scan_id", "id")


@query("wn_09_model_history", "model_states", sql="SELECT id, f1_score, deployment_status FROM (SELECT * FROM model_states ORDER BY trained_at DESC, id DESC LIMIT 20)")
def _(t):
    return latest.model_history(derived.model_states(t)).select("id", "f1_score", "deployment_status")


@query("wn_09_latest_deployed", "model_states", sql="SELECT id, deployment_status FROM model_states WHERE deployment_status='deployed' ORDER BY trained_at DESC, id DESC LIMIT 1")
def _(t):
    return latest.latest_deployed(derived.model_states(t)).select("id", "deployment_status")


@query("wn_10_last_decision", "decisions", sql="SELECT finding_id, arg_max(label, event_id) AS label FROM decisions WHERE action='label' GROUP BY 1")
def _(t):
    batch = t.decisions.filter(F.col("action") == "label").withColumn("position", F.col("event_id"))
    return latest.last_decision(batch).select("finding_id", "label")


PAIR = """, fr AS (SELECT a.*, row_number() OVER (PARTITION BY a.finding_id, reviewer ORDER BY completed_at DESC NULLS LAST, a.id DESC) AS rn FROM assessments a JOIN contexts c ON c.finding_id=a.finding_id AND c.context_hash=a.context_hash WHERE reviewer IN ('offensive','defensive') AND model='review-model' AND prompt_version='p1')
, pair AS (SELECT o.finding_id, o.context_hash, o.id AS oid, d.id AS did, o.classification AS oc, d.classification AS dc, o.confidence AS ocf, d.confidence AS dcf, o.missing_evidence AS om, d.missing_evidence AS dm FROM fr o JOIN fr d ON d.finding_id=o.finding_id AND o.reviewer='offensive' AND d.reviewer='defensive' AND o.rn=1 AND d.rn=1)
"""


@query("wn_11_reviewer_pair", "contexts", "assessments", sql=PAIR + "SELECT finding_id, oid AS offensive_id, did AS defensive_id FROM pair")
def _(t):
    p = latest.reviewer_pair(t.assessments, t.contexts, "review-model", "p1")
    return p.select("finding_id", F.col("offensive.id").alias("offensive_id"), F.col("defensive.id").alias("defensive_id"))


@query("wn_12_superseded_runs", "runs", sql="""
SELECT r.id, r.scan_id, o.owner_id FROM runs r JOIN (SELECT scan_id, min(id) AS owner_id FROM runs WHERE status IN ('queued','running','running_with_errors') GROUP BY 1) o ON o.scan_id=r.scan_id WHERE r.status IN ('queued','running','running_with_errors') AND r.id>o.owner_id""")
def _(t):
    return latest.superseded(t.runs).select("id", "scan_id", "owner_id")


# ---- rankings ---------------------------------------------------------------
@query("tk_01_review_candidates", "findings", "contexts", "assessments", sql=f"""
SELECT scan_id, id, CAST(position AS INT) AS position FROM (SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY {QUEUE_RANK}, tp_probability DESC NULLS LAST, id) AS position FROM ({UNREVIEWED})) WHERE position<=10""")
def _(t):
    return topk.review_candidates(t.findings, t.contexts, t.assessments).select("scan_id", "id", "position")


@query("tk_03_queue_page", "findings", sql="SELECT id, file_path, line_number FROM findings WHERE final_label IS NULL ORDER BY file_path, line_number, id LIMIT 25 OFFSET 50")
def _(t):
    return topk.queue_page(t.findings, page=3).select("id", "file_path", "line_number")


@query("tk_03_queue_after_key", "findings", sql="""
SELECT id, file_path, line_number FROM findings WHERE final_label IS NULL AND (file_path > 'bin/run19' OR (file_path='bin/run19' AND (line_number>6 OR (line_number=6 AND id>0)))) ORDER BY file_path, line_number, id LIMIT 25""")
def _(t):
    return topk.queue_page(t.findings, after=("bin/run19", 6, 0)).select("id", "file_path", "line_number")


@query("tk_04_findings_page", "findings", sql="SELECT id, tp_probability FROM findings WHERE status='pending' ORDER BY tp_probability DESC NULLS LAST, id LIMIT 50 OFFSET 50")
def _(t):
    return topk.findings_page(t.findings, page=2, status="pending").select("id", "tp_probability")


@query("tk_05_focus_rule", "findings", sql="SELECT rule_id FROM findings WHERE final_label IS NULL GROUP BY rule_id, cwe_id ORDER BY count(*) DESC, rule_id LIMIT 1")
def _(t):
    return topk.focus_rule(t.findings)


# ---- sets -------------------------------------------------------------------
@query("st_03_missing_evidence", "contexts", "assessments", sql=PAIR + """SELECT finding_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(om,[]), coalesce(dm,[])))), ',') AS missing FROM pair""")
def _(t):
    p = latest.reviewer_pair(t.assessments, t.contexts, "review-model", "p1")
    both = scoring.missing_evidence("offensive.missing_evidence", "defensive.missing_evidence")
    return p.select("finding_id", F.array_join(F.array_sort(both), ",").alias("missing"))


@query("st_04_retry_set", "runs", "findings", "contexts", "assessments", sql=f"""
, u AS (SELECT id AS run_id, scan_id, unnest(candidate_finding_ids) AS finding_id, generate_subscripts(candidate_finding_ids,1)-1 AS position FROM runs WHERE status IN ('complete_with_errors','failed'))
SELECT u.run_id, u.finding_id, CAST(u.position AS INT) AS position FROM u WHERE finding_id IN (SELECT id FROM ({UNREVIEWED}))""")
def _(t):
    runs = t.runs.filter(F.col("status").isin("complete_with_errors", "failed"))
    return sets.retry_candidates(runs, t.findings, t.contexts, t.assessments).select("run_id", "finding_id", "position")
