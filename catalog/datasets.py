"""Queries for scalar functions, snapshot routing, exports and adjudication."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derived
from catalog.code import redact_sql
from catalog.registry import query
from catalog.relational import CL, OUT_HUMAN, OUT_MODEL, PAIR, TRUSTED_EXISTS
from catalog.tables import CTE, SAMPLE, bucket
from winnow import fixed_values as fv
from winnow.functions import identity, scoring, texts
from winnow.operators import latest, metrics, sets, topk
from winnow.plans import adjudication, export, reviewer_export, snapshot
from winnow.sinks import files


# ---- identity ---------------------------------------------------------------
@query("sc_01_fingerprint", "fs", sql="SELECT id, fingerprint FROM fs")
def _(t):
    return t.findings.select("id", identity.finding_fingerprint("rule_id", "cwe_id", "file_path", "line_number", "raw_snippet", "message").alias("fingerprint"))


@query("sc_02_group_key", "fs", sql="SELECT id, replace(group_key, chr(0), '|') AS group_key FROM fs")
def _(t):
    return snapshot.identified(t.findings, t.scans).select("id", F.replace("group_key", F.lit("\u0000"), F.lit("|")).alias("group_key"))


@query("sc_03_hash_split", "fs", sql=f"SELECT id, CASE WHEN {bucket('group_key')}<20 THEN 'validation' ELSE 'train' END AS split FROM fs")
def _(t):
    return snapshot.identified(t.findings, t.scans).select("id", identity.training_split("group_key", 20).alias("split"))


@query("sc_04_reviewer_split", "scans", sql=f"SELECT id, CASE WHEN {bucket('concat(project_id, chr(0), lower(trim(commit_sha)))')}<35 THEN 'validation' ELSE 'train' END AS split FROM scans")
def _(t):
    return t.scans.select("id", identity.reviewer_split("project_id", "commit_sha", 35).alias("split"))


@query("sc_05_feature_defaults", "findings", sql=f"SELECT id, {SAMPLE} AS sample FROM findings WHERE has_vector")
def _(t):
    rows = t.findings.filter("feature_vector IS NOT NULL").select("id", identity.normalized_vector("feature_vector").alias("v"))
    return rows.select("id", identity.sample_text("v").alias("sample"))


LEGACY_SAMPLE = SAMPLE[:SAMPLE.index(", 'reaches_request_input'")] + "}) AS VARCHAR)"


@query("sc_06_legacy_order", "findings", sql=f"SELECT id, {LEGACY_SAMPLE} AS sample FROM findings WHERE has_vector")
def _(t):
    order = fv.LEGACY_FEATURES
    rows = t.findings.filter("feature_vector IS NOT NULL").select("id", identity.normalized_vector("feature_vector", order).alias("v"))
    return rows.select("id", identity.sample_text("v", order).alias("sample"))


@query("sc_07_feature_sha256", "findings", sql=f"SELECT id, sha256({SAMPLE}) AS feature_sha256 FROM findings WHERE has_vector")
def _(t):
    rows = t.findings.filter("feature_vector IS NOT NULL").select("id", identity.normalized_vector("feature_vector").alias("v"))
    return rows.select("id", identity.feature_sha256(identity.sample_text("v")).alias("feature_sha256"))


# ---- scalars ----------------------------------------------------------------
@query("sc_08_is_test_file", "code_lines", sql="""
SELECT DISTINCT file_path, CAST(regexp_matches('/' || file_path, '(?i)/(tests?|spec)/') OR regexp_matches(file_path, '(Test|Spec)\\.php$') AS INT) AS is_test FROM code_lines""")
def _(t):
    return t.code_lines.select("file_path").distinct().select("file_path", scoring.is_test_file(F.concat(F.lit("/"), "file_path")).alias("is_test"))


@query("sc_09_file_extension", "findings", sql="""
SELECT id, CASE WHEN file_path LIKE '%.blade.php' THEN 'blade.php' WHEN file_path LIKE '%.php' THEN 'php' ELSE 'unknown' END AS ext FROM findings""")
def _(t):
    return t.findings.select("id", scoring.file_extension("file_path").alias("ext"))


@query("sc_10_severity_ranks", "findings", sql="""
SELECT severity, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS gate, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS queue, count(*) AS n FROM findings GROUP BY 1,2,3""")
def _(t):
    return t.findings.groupBy("severity", scoring.gate_rank("severity").alias("gate"), scoring.queue_rank("severity").alias("queue")).agg(F.count(F.lit(1)).alias("n"))


@query("sc_11_decision", "findings", sql="""
SELECT id, coalesce(CASE WHEN a_q%2=0 THEN NULL WHEN tp_probability>=0.8 THEN 'true_positive' WHEN tp_probability<=0.15 THEN 'false_positive' END,'') AS decision FROM findings""")
def _(t):
    return t.findings.select("id", F.coalesce(scoring.decision("tp_probability", F.col("a_q") % 2 != 0), F.lit("")).alias("decision"))


@query("sc_14_quarantine_reason", "findings", "feedback", sql=f"""
SELECT id, reason FROM (SELECT f.id, CASE WHEN b.id IS NULL THEN 'unattributed_label' WHEN NOT b.training_eligible THEN 'label_quality_review' WHEN b.source='ai_pseudo' THEN 'ai_pseudo_label' ELSE 'inconsistent_label' END AS reason
 FROM findings f LEFT JOIN feedback b ON b.finding_id=f.id WHERE f.has_vector AND f.final_label IS NOT NULL AND NOT {TRUSTED_EXISTS})""")
def _(t):
    from winnow.operators import filters

    side = t.feedback.select(F.col("finding_id").alias("id"), "source", "training_eligible", F.lit(True).alias("has"))
    rows = filters.untrusted(t.findings, t.feedback).select("id").join(side, "id", "left")
    return rows.select("id", scoring.quarantine_reason(F.coalesce("has", F.lit(False)), "training_eligible", "source").alias("reason"))


@query("sc_15_class_label", "assessments", sql=f"SELECT id, coalesce({CL},'') AS label FROM assessments")
def _(t):
    return t.assessments.select("id", F.coalesce(scoring.class_label("classification"), F.lit("")).alias("label"))


@query("sc_16_outcome_vs_model", "findings", "assessments", sql=f"SELECT id, {OUT_MODEL} AS outcome FROM (SELECT a.id, f.predicted_label, {CL} AS cl FROM assessments a JOIN findings f ON f.id=a.finding_id)")
def _(t):
    rows = t.assessments.join(t.findings.select(F.col("id").alias("finding_id"), "predicted_label"), "finding_id")
    return rows.select("id", scoring.outcome_vs_model("predicted_label", "classification").alias("outcome"))


@query("sc_17_outcome_vs_human", "findings", "assessments", sql=f"SELECT id, {OUT_HUMAN} AS outcome FROM (SELECT a.id, f.final_label AS truth, {CL} AS cl FROM assessments a JOIN findings f ON f.id=a.finding_id)")
def _(t):
    rows = t.assessments.join(t.findings.select(F.col("id").alias("finding_id"), "final_label"), "finding_id")
    return rows.select("id", scoring.outcome_vs_human("final_label", "classification").alias("outcome"))


@query("sc_18_trusted_label", "findings", "feedback", sql="""
SELECT f.id, coalesce(CASE WHEN coalesce(b.source,'')='ai_pseudo' THEN NULL ELSE f.final_label END,'') AS label FROM findings f LEFT JOIN feedback b ON b.finding_id=f.id""")
def _(t):
    rows = t.findings.select("id", "final_label").join(t.feedback.select(F.col("finding_id").alias("id"), "source"), "id", "left")
    return rows.select("id", F.coalesce(scoring.trusted_label("final_label", "source"), F.lit("")).alias("label"))


ADJ = """CASE WHEN oc IN ('confirmed_tp','likely_tp') AND dc IN ('confirmed_tp','likely_tp') AND predicted_label='true_positive' AND coalesce(tp_probability,0)>=0.75 THEN 'likely_tp'
 WHEN oc IN ('confirmed_fp','likely_fp') AND dc IN ('confirmed_fp','likely_fp') AND predicted_label='false_positive' AND coalesce(tp_probability,1)<=0.25 THEN 'likely_fp' ELSE 'needs_validation' END"""
ADJ_ROWS = PAIR + f""", adj AS (SELECT p.*, f.predicted_label, f.tp_probability, {ADJ} AS classification FROM pair p JOIN findings f ON f.id=p.finding_id)
, conf AS (SELECT *, {CL} AS cl, CAST(round(least(1.0, greatest(0.0, CAST((CASE WHEN classification='likely_tp' THEN coalesce(tp_probability,0.5) WHEN classification='likely_fp' THEN 1-coalesce(tp_probability,0.5) ELSE 0.5 END) AS DOUBLE)*CAST(0.40 AS DOUBLE) + CAST(coalesce(ocf,0.5) AS DOUBLE)*CAST(0.30 AS DOUBLE) + CAST(coalesce(dcf,0.5) AS DOUBLE)*CAST(0.30 AS DOUBLE))),4) AS DOUBLE) AS confidence FROM adj)
"""


@query("sc_20_adjudicate", "findings", "contexts", "assessments", sql=ADJ_ROWS + "SELECT finding_id, classification FROM conf")
def _(t):
    return adjudication.adjudications(t.findings, t.assessments, t.contexts, "review-model", "p1").select("finding_id", "classification")


@query("sc_21_adjudication_confidence", "findings", "contexts", "assessments", sql=ADJ_ROWS + "SELECT finding_id, CAST(round(confidence*1000) AS BIGINT) AS per_mille FROM conf WHERE confidence IS NOT NULL")
def _(t):
    rows = adjudication.adjudications(t.findings, t.assessments, t.contexts, "review-model", "p1")
    return rows.select("finding_id", F.round(F.col("confidence") * 1000).cast("bigint").alias("per_mille"))


@query("sc_22_confidence", sql="""
SELECT event_id, CAST(CASE WHEN v IS NULL THEN -1 ELSE round(least(1.0,greatest(0.0,CASE WHEN v>1 THEN v/100 ELSE v END)),4) END AS DOUBLE) AS confidence FROM
 (SELECT event_id, TRY_CAST(CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN '-3' WHEN 'click' THEN '0.25' ELSE CAST(event_id%150 AS VARCHAR) END AS DOUBLE) AS v FROM events)""")
def _(t):
    v = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "-3").when(
        F.col("event_type") == "click", "0.25").otherwise((F.col("event_id") % 150).cast("string"))
    return t.raw_events.select("event_id", F.coalesce(scoring.normalize_confidence(v), F.lit(-1.0)).alias("confidence"))


@query("sc_23_structured_answer", sql="""
SELECT conv_id, turn, CASE WHEN turn%3=2 THEN 'invalid' ELSE 'likely_tp' END AS classification FROM conversations""")
def _(t):
    strict = F.to_json(F.struct(F.lit("likely_tp").alias("classification"), F.col("text").alias("reasoning_summary")))
    raw = F.concat(F.lit('{"classification":"likely_tp","reasoning_summary":"'), F.translate("text", '"\\', "  "), F.lit("\t\n\"}"))
    broken = F.concat(F.lit('{"classification":"likely_tp", '), F.lit("oops"))
    content = F.when(F.col("turn") % 3 == 0, strict).when(F.col("turn") % 3 == 1, raw).otherwise(broken)
    return t.raw_conversations.select(
        "conv_id", "turn", F.coalesce(texts.parse_answer(content)["classification"], F.lit("invalid")).alias("classification"))


@query("sc_29_advisory_summary", "assessments", sql="""
, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id, reviewer ORDER BY completed_at DESC, id DESC) AS rn FROM assessments WHERE completed_at IS NOT NULL) WHERE rn=1)
SELECT finding_id, string_agg(reviewer || ':' || classification || '(' || coalesce(printf('%.4f', confidence),'n/a') || ')', ' | ' ORDER BY reviewer) AS summary FROM l GROUP BY 1""")
def _(t):
    return export.advisory_assessments(t.assessments).select(F.col("id").alias("finding_id"), texts.advisory_summary("advisory").alias("summary"))


@query("sc_30_outcome_reason", "findings", "assessments", sql=f"""
SELECT id, CASE WHEN predicted_label IS NULL THEN 'No model prediction yet, so the verdict of ' || n || ' cannot be scored.' ELSE CASE o WHEN 'true_positive' THEN 'Model predicted a vulnerability; ' || n || ' found support for it.'
 WHEN 'false_positive' THEN 'Model predicted a vulnerability; ' || n || ' judged it a false alarm.' WHEN 'true_negative' THEN 'Model predicted a false alarm; ' || n || ' agreed.' WHEN 'false_negative' THEN 'Model predicted a false alarm; ' || n || ' found a vulnerability.'
 ELSE n || ' needs more evidence to settle the model''s prediction.' END END AS reason
FROM (SELECT *, {OUT_MODEL} AS o FROM (SELECT a.id, upper(a.reviewer) AS n, f.predicted_label, {CL} AS cl FROM assessments a JOIN findings f ON f.id=a.finding_id))""")
def _(t):
    rows = t.assessments.join(t.findings.select(F.col("id").alias("finding_id"), "predicted_label"), "finding_id")
    rows = rows.withColumn("o", scoring.outcome_vs_model("predicted_label", "classification"))
    return rows.select("id", texts.outcome_reason("reviewer", "predicted_label", "o").alias("reason"))


@query("sc_31_path_parts", "findings", sql="""
SELECT id, array_to_string(list_slice(p,1,-2),'/') AS directory, p[-1] AS file, CAST(len(p)-1 AS INT) AS depth FROM (SELECT id, string_split(replace(file_path,'\\','/'),'/') AS p FROM findings)""")
def _(t):
    p = scoring.path_parts("file_path")
    return t.findings.select("id", p["directory"].alias("directory"), p["file"].alias("file"), F.size(p["segments"]).alias("depth"))


HINT = "CASE " + " ".join(f"WHEN cwe_id={c} THEN '{k}'" for c, k in fv.CWE_SINK_KINDS.items()) + " " + " ".join(
    "WHEN " + " OR ".join(f"contains(rule_id,'{w}')" for w in words) + f" THEN '{k}'" for words, k in fv.RULE_SINK_KEYWORDS) + " END"


@query("sc_33_sink_hint", "findings", sql=f"SELECT id, coalesce({HINT},'') AS hint FROM findings")
def _(t):
    return t.findings.select("id", F.coalesce(scoring.sink_hint("cwe_id", "rule_id"), F.lit("")).alias("hint"))


@query("sc_34_enum_conformance", "findings", "scans", sql="""
SELECT branch AS severity, count(*) AS n, max(CASE WHEN branch IN ('LOW','MEDIUM','HIGH','CRITICAL') THEN '' ELSE 'severity' END || CASE WHEN status IN ('pending','triaged','suppressed','reported') THEN '' ELSE '+status' END) AS violations FROM scans GROUP BY 1""")
def _(t):
    rows = t.scans.withColumn("v", F.array_join(scoring.enum_violations(severity="branch", status="status", source="source"), "+"))
    return rows.groupBy(F.col("branch").alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("violations"))


LOGS = """SELECT event_id, strftime(ts,'%H:%M:%S') AS time, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS level, 'Review ' || event_type AS message,
 CASE event_type WHEN 'error' THEN 'worker stopped' WHEN 'purchase' THEN 'OFFENSIVE | ' || (event_id%90) || 's | 12 input tokens | 7 output tokens' WHEN 'click' THEN '3/10 processed' ELSE '' END AS detail, ts FROM events"""


@query("sc_35_log_lines", sql=f"SELECT event_id, time, level, message, detail FROM ({LOGS})")
def _(t):
    rows = derived.log_lines(t).withColumn("p", texts.parse_log_line("line"))
    return rows.select("event_id", "p.time", "p.level", "p.message", F.coalesce("p.detail", F.lit("")).alias("detail"))


@query("sc_36_age_seconds", sql="SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-02-01 00:00:00') AS age FROM events")
def _(t):
    whole = F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.raw_events.select("event_id", scoring.age_seconds(whole, F.expr("timestamp_ntz'2024-02-01 00:00:00'")).alias("age"))


# ---- snapshot, quarantine, review queue --------------------------------------
@query("ml_03_training_snapshot", "snapshot", sql="SELECT id, fingerprint, split, label, duplicate_count, ambiguous_feature FROM snapshot")
def _(t):
    rows = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).rows
    return rows.select("id", "fingerprint", "split", "label", "duplicate_count", "ambiguous_feature")


QUAR = f"""
, u AS (SELECT f.*, b.source AS label_source, CASE WHEN b.id IS NULL THEN 'unattributed_label' WHEN NOT b.training_eligible THEN 'label_quality_review' WHEN b.source='ai_pseudo' THEN 'ai_pseudo_label' ELSE 'inconsistent_label' END AS reason
  FROM fs f LEFT JOIN feedback b ON b.finding_id=f.id WHERE f.has_vector AND f.final_label IS NOT NULL AND NOT {TRUSTED_EXISTS})
, q AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fingerprint, final_label, label_source) AS duplicate_count, row_number() OVER (PARTITION BY fingerprint, final_label, label_source ORDER BY group_key, id) AS rn FROM u) WHERE rn=1)"""
AMB = "(sha256(sample) IN (SELECT feature_sha256 FROM snapshot WHERE ambiguous_feature))"


@query("wn_06_quarantine", "snapshot", "feedback", "fs", sql=QUAR + f"""
SELECT id AS finding_id, reason AS quarantine_reason, final_label AS label, coalesce(label_source,'') AS label_source, duplicate_count, {AMB} AS ambiguous_feature FROM q""")
def _(t):
    rows = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).kept
    return export.quarantine_rows(t.findings, t.scans, t.feedback, rows, keep=()).select(
        "finding_id", "quarantine_reason", "label", F.coalesce("label_source", F.lit("")).alias("label_source"), "duplicate_count", "ambiguous_feature")


@query("st_02_quarantine_union", "snapshot", "feedback", "fs", sql=QUAR + " SELECT reason AS quarantine_reason, count(*) AS records FROM q GROUP BY 1")
def _(t):
    rows = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=()).rows
    _, bad = export.route_snapshot(rows)
    union = sets.union_rows(bad, export.quarantine_rows(t.findings, t.scans, t.feedback, rows, keep=()))
    return union.groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("records"))


CTE["review"] = (["fs"], """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fingerprint) AS duplicate_count, row_number() OVER (PARTITION BY fingerprint ORDER BY group_key, sample, id) AS rn FROM fs WHERE final_label IS NULL AND has_vector) WHERE rn=1""")
CTE["adv"] = (["assessments"], """
SELECT finding_id, list(classification) AS cl FROM (SELECT *, row_number() OVER (PARTITION BY finding_id, reviewer ORDER BY completed_at DESC, id DESC) AS rn FROM assessments WHERE completed_at IS NOT NULL) WHERE rn=1 GROUP BY 1""")
CTE["prio"] = (["review", "adv", "snapshot"], """
SELECT r.*, a.cl, n.tp, CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 30 WHEN 'MEDIUM' THEN 20 ELSE 10 END
 + CASE WHEN coalesce(n.tp,0)=0 THEN 30 WHEN n.tp<=2 THEN 20 WHEN n.tp<=5 THEN 10 ELSE 0 END
 + CASE WHEN contains(r.rule_id,'command-injection') THEN 25 WHEN contains(r.rule_id,'path-traversal') THEN 15 ELSE 0 END
 + CASE WHEN contains(r.rule_id,'path-traversal') AND contains(coalesce(raw_snippet,''),'file_get_contents') THEN 10 ELSE 0 END
 + CASE WHEN trim(coalesce(raw_snippet,''))<>'' THEN 5 ELSE 0 END + coalesce(CAST(round(tp_probability*5) AS INT),0)
 + CASE WHEN list_contains(cl,'confirmed_tp') THEN 15 WHEN list_contains(cl,'likely_tp') THEN 12 WHEN list_contains(cl,'needs_validation') THEN 6 WHEN list_contains(cl,'likely_fp') THEN 3 ELSE 0 END
 + CASE WHEN (list_contains(cl,'confirmed_tp') OR list_contains(cl,'likely_tp')) AND (list_contains(cl,'confirmed_fp') OR list_contains(cl,'likely_fp')) THEN 20 ELSE 0 END
 + least(10, duplicate_count-1) AS priority
FROM review r LEFT JOIN adv a ON a.finding_id=r.id LEFT JOIN (SELECT rule_id, count(*) AS tp FROM snapshot WHERE label='true_positive' GROUP BY 1) n ON n.rule_id=r.rule_id""")


def _review(t, *keep):
    rows = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=["rule_id"], once=True).kept
    return export.review_rows(t.findings, t.scans, t.assessments, rows, keep=keep)


@query("wn_07_review_representative", "review", sql="SELECT id, fingerprint, duplicate_count FROM review")
def _(t):
    return latest.dedupe_review(export.review_candidates(t.findings, t.scans, ())).select("id", "fingerprint", "duplicate_count")


@query("sc_12_review_priority", "prio", sql="SELECT id, CAST(priority AS INT) AS priority_score FROM prio")
def _(t):
    return _review(t).select("id", "priority_score")


@query("sc_13_priority_reasons", "prio", sql="""
SELECT id, concat_ws(',', 'severity_' || lower(severity), CASE WHEN coalesce(tp,0)=0 THEN 'no_trusted_tp_for_rule' WHEN tp<=2 THEN 'scarce_trusted_tp_for_rule' WHEN tp<=5 THEN 'limited_trusted_tp_for_rule' END,
 CASE WHEN contains(rule_id,'command-injection') THEN 'command_injection_priority' WHEN contains(rule_id,'path-traversal') THEN 'path_traversal_priority' END,
 CASE WHEN contains(rule_id,'path-traversal') AND contains(coalesce(raw_snippet,''),'file_get_contents') THEN 'dynamic_file_sink_candidate' END, CASE WHEN trim(coalesce(raw_snippet,''))<>'' THEN 'source_excerpt_present' END,
 CASE WHEN tp_probability IS NOT NULL THEN 'model_advisory_tiebreaker' END, CASE WHEN list_contains(cl,'needs_validation') THEN 'ai_needs_validation' END,
 CASE WHEN len(list_filter(cl, lambda c: c<>'confirmed_fp'))>0 THEN 'ai_advisory_signal' END,
 CASE WHEN (list_contains(cl,'confirmed_tp') OR list_contains(cl,'likely_tp')) AND (list_contains(cl,'confirmed_fp') OR list_contains(cl,'likely_fp')) THEN 'ai_disagreement' END, CASE WHEN duplicate_count>1 THEN 'repeated_finding' END) AS reasons FROM prio""")
def _(t):
    return _review(t).select("id", F.array_join("priority_reasons", ",").alias("reasons"))


@query("tk_02_review_queue", "prio", sql="SELECT id, CAST(priority AS INT) AS priority_score FROM prio ORDER BY priority DESC, fingerprint, id LIMIT 500")
def _(t):
    return topk.review_queue(_review(t), 500).select("id", "priority_score")


@query("tk_02_review_queue_counts", "review", "fs", sql="""
, c AS (SELECT (SELECT count(*) FROM fs WHERE final_label IS NULL AND has_vector) AS candidates, (SELECT count(*) FROM review) AS available)
SELECT candidates, available, candidates-available AS excluded_duplicates, least(available,500) AS exported, available-least(available,500) AS truncated FROM c""")
def _(t):
    cand = export.review_candidates(t.findings, t.scans, ())
    return topk.review_queue_counts(cand, latest.dedupe_review(cand), 500)


CSV_SQL = f"""
, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id, reviewer ORDER BY completed_at DESC, id DESC) AS rn FROM assessments WHERE completed_at IS NOT NULL) WHERE rn=1)
, s AS (SELECT finding_id, string_agg(reviewer || ':' || classification || '(' || coalesce(printf('%.4f', confidence),'n/a') || ')', ' | ' ORDER BY reviewer) AS summary FROM l GROUP BY 1)
SELECT p.id AS finding_id, {redact_sql('message')} AS message, CASE WHEN trim(coalesce(raw_snippet,''))<>'' THEN {redact_sql("regexp_replace(raw_snippet, '^[ " + chr(92) + "t]+|[ " + chr(92) + "t]+$', '', 'g')")} ELSE {redact_sql('message')} END AS source_excerpt, coalesce(summary,'') AS advisory_summary, '' AS human_label
FROM prio p LEFT JOIN s ON s.finding_id=p.id"""


@query("snk_03_review_csv", "prio", "assessments", sql=CSV_SQL)
def _(t):
    return export.review_csv(_review(t, "message", "advisory_assessments")).select("finding_id", "message", "source_excerpt", "advisory_summary", "human_label")


@query("ag_26_dataset_warnings", "snapshot", "feedback", "fs", "trusted", "review", sql=QUAR + """
, c AS (SELECT count(*) FILTER (label='true_positive' AND split='train') AS ttp, count(*) FILTER (label='false_positive' AND split='train') AS tfp, count(*) FILTER (ambiguous_feature) AS amb FROM snapshot)
, x AS (SELECT coalesce(sum(n) FILTER (lo<>hi),0) AS conf FROM (SELECT count(*) AS n, min(label) AS lo, max(label) AS hi FROM trusted GROUP BY fingerprint))
SELECT concat_ws(';', (SELECT count(*) FROM q) || ' weak or unattributed labeled record(s) were quarantined and cannot certify the model.',
 CASE WHEN (SELECT count(*) FROM review)>500 THEN ((SELECT count(*) FROM review)-500) || ' review candidate(s) were omitted by the review limit.' END,
 CASE WHEN amb>0 THEN amb || ' labeled row(s) share features with the opposite label.' END, CASE WHEN conf>0 THEN conf || ' exact finding row(s) were excluded because their labels conflict.' END) AS warnings FROM c, x""")
def _(t):
    built = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=())
    cand = export.review_candidates(t.findings, t.scans, ())
    counts = topk.review_queue_counts(cand, latest.dedupe_review(cand), 500)
    q = export.quarantine_rows(t.findings, t.scans, t.feedback, built.kept, keep=())
    stats = export.snapshot_statistics_row(snapshot.statistics(built), q, counts)
    return metrics.dataset_warnings(stats).select(F.array_join("warnings", ";").alias("warnings"))


@query("snk_02_export_partitions", "snapshot", "feedback", "fs", "review", sql=QUAR + """
SELECT split AS name, count(*) AS records FROM snapshot GROUP BY 1 UNION ALL SELECT 'quarantine', count(*) FROM q UNION ALL SELECT 'review_queue', count(*) FROM review""")
def _(t):
    """Writes the whole export to the shared folder and counts what is in the written files."""
    from winnow.session import scratch

    spark = t.spark
    root = scratch(spark, "export")
    export.export_dataset(t.findings, t.scans, t.feedback, t.assessments, root, "dataset", compression="gzip")
    parts = []
    for name in ("train", "validation", "quarantine", "review_queue"):
        lines = spark.read.text(f"{root}/dataset/{name}.jsonl")
        parts.append(lines.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("records")))
    return sets.union_rows(*parts)


# ---- reviewer dataset --------------------------------------------------------
CTE["records"] = (["findings", "scans", "contexts", "assessments", "assessment_feedback", "feedback"], f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reviewer, context_hash ORDER BY completed_at DESC, id DESC) AS rn FROM (
 SELECT a.id, a.reviewer, a.context_hash, a.completed_at, a.classification, s.project_id, s.commit_sha, f.predicted_label, c.context, x.id IS NOT NULL AS explicit, x.verdict,
  CASE WHEN x.id IS NOT NULL THEN coalesce(x.corrected_classification, CASE WHEN x.verdict='correct' THEN a.classification END) ELSE CASE WHEN f.final_label='true_positive' THEN 'confirmed_tp' ELSE 'confirmed_fp' END END AS rc,
  CASE WHEN x.id IS NOT NULL THEN NULL ELSE f.final_label END AS rl
 FROM assessments a JOIN findings f ON f.id=a.finding_id JOIN scans s ON s.id=f.scan_id JOIN contexts c ON c.finding_id=f.id AND c.context_hash=a.context_hash
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY reviewed_at DESC NULLS LAST, id DESC) AS rn FROM assessment_feedback) WHERE rn=1) x ON x.assessment_id=a.id
 LEFT JOIN (SELECT * FROM feedback WHERE source<>'ai_pseudo' AND NOT starts_with(notes,'AI training label from') AND NOT starts_with(notes,'AI_PROMOTED')) t ON t.finding_id=f.id
 WHERE a.reviewer IN ('offensive','defensive') AND a.completed_at IS NOT NULL AND (x.id IS NOT NULL OR (t.id IS NOT NULL AND f.final_label IS NOT NULL)))) WHERE rn=1""")
CTE["rec"] = (["records"], f"""
SELECT *, {CL} AS cl, coalesce(CASE WHEN rc IN ('confirmed_tp','likely_tp') THEN 'true_positive' WHEN rc IN ('confirmed_fp','likely_fp') THEN 'false_positive' END, rl) AS truth,
 CASE WHEN {bucket('concat(project_id, chr(0), lower(trim(commit_sha)))')}<20 THEN 'validation' ELSE 'train' END AS split FROM records""")


def _records(t):
    return reviewer_export.reviewer_records(t.assessments, t.assessment_feedback, t.feedback, t.findings, t.scans, t.contexts)


@query("sc_19_human_signal", "rec", sql="SELECT id AS assessment_id, coalesce(rc,'') AS reference_classification, coalesce(truth,'') AS reference_label, coalesce(verdict,'') AS verdict, CASE WHEN explicit THEN 'ai_assessment_feedback' ELSE 'triage_feedback' END AS feedback_source FROM rec")
def _(t):
    e = F.lit("")
    return _records(t).select("assessment_id", F.coalesce("reference_classification", e).alias("reference_classification"),
                              F.coalesce("reference_label", e).alias("reference_label"), F.coalesce("verdict", e).alias("verdict"), "feedback_source")


@query("jb_03_reviewer_dataset", "rec", sql=f"SELECT id AS assessment_id, reviewer, split, {OUT_HUMAN} AS outcome, sha256({redact_sql('context')}) AS input_context_sha256 FROM rec")
def _(t):
    return _records(t).select("assessment_id", "reviewer", "split", "outcome", "input_context_sha256")


@query("ag_18_reviewer_counters", "rec", sql=f"SELECT count(*) AS total, count(*) FILTER (reviewer='offensive') AS offensive, count(*) FILTER (split='validation') AS validation, count(*) FILTER (rc IS NULL) AS class_unresolved, count(*) FILTER (truth IS NULL) AS label_unresolved, count(*) FILTER (verdict IS NULL) AS not_explicit, count(*) FILTER (verdict='partially_correct') AS partially_correct, count(*) FILTER ({OUT_HUMAN}='true_negative') AS true_negative FROM rec")
def _(t):
    return metrics.reviewer_counters(_records(t)).select(
        "total", F.col("reviewer_offensive").alias("offensive"), F.col("split_validation").alias("validation"), "class_unresolved", "label_unresolved",
        F.col("verdict_not_explicit").alias("not_explicit"), F.col("verdict_partially_correct").alias("partially_correct"), F.col("outcome_true_negative").alias("true_negative"))


@query("snk_06_reviewer_files", "rec", sql="SELECT reviewer, count(*) AS records FROM rec GROUP BY 1")
def _(t):
    from winnow.session import scratch

    root = scratch(t.spark, "reviewers")
    reviewer_export.export_reviewer_dataset(_records(t), root, "dataset", compression="gzip")
    return sets.union_rows(*[
        t.spark.read.text(f"{root}/dataset/{r}.jsonl").agg(F.lit(r).alias("reviewer"), F.count(F.lit(1)).alias("records")) for r in fv.REVIEWERS])


# ---- adjudication and promotion ----------------------------------------------
@query("jb_05_adjudicate", "findings", "contexts", "assessments", sql=ADJ_ROWS + f"SELECT finding_id, classification, {OUT_MODEL} AS evaluation_outcome, 'Model TP probability: ' || printf('%.3f', coalesce(tp_probability,0)) AS first_evidence FROM conf")
def _(t):
    return adjudication.adjudications(t.findings, t.assessments, t.contexts, "review-model", "p1").select(
        "finding_id", "classification", "evaluation_outcome", F.col("supporting_evidence")[0].alias("first_evidence"))


@query("ml_10_promotion", "findings", "feedback", "assessments", sql=f"""
SELECT a.finding_id, {CL.replace('classification', 'a.classification')} AS corrected_label, a.id AS source_assessment_id, 'AI training label from adjudicator (' || a.classification || ', ' || printf('%.0f', a.confidence*100) || '% confidence).' AS notes FROM assessments a JOIN findings f ON f.id=a.finding_id
WHERE a.reviewer='adjudicator' AND a.classification<>'needs_validation' AND a.confidence>=0.85 AND f.final_label IS NULL AND f.has_vector AND NOT EXISTS (SELECT 1 FROM feedback b WHERE b.finding_id=f.id)""")
def _(t):
    return adjudication.promotions(t.assessments, t.findings, t.feedback, 1).select("finding_id", "corrected_label", "source_assessment_id", "notes")


@query("ml_11_f1_trend", "model_states", sql="SELECT CAST(row_number() OVER (ORDER BY trained_at, id) AS INT) AS attempt, id, f1_score FROM (SELECT * FROM model_states ORDER BY trained_at DESC, id DESC LIMIT 20)")
def _(t):
    return latest.model_trend(derived.model_states(t)).select("attempt", "id", "f1_score")


@query("ss_06_assessment_upsert", "findings", "assessments", sql=f"""
SELECT id, {OUT_MODEL} AS evaluation_outcome FROM (SELECT a.*, f.predicted_label, {CL.replace('classification', 'a.classification')} AS cl, row_number() OVER (PARTITION BY finding_id, reviewer, model, prompt_version, context_hash ORDER BY completed_at DESC NULLS LAST, a.id DESC) AS rn FROM assessments a JOIN findings f ON f.id=a.finding_id) WHERE rn=1""")
def _(t):
    return adjudication.assessment_upserts(t.assessments, t.findings).select("id", "evaluation_outcome")


@query("ss_07_reuse_completed", "contexts", "assessments", sql="""
SELECT c.finding_id FROM contexts c WHERE NOT EXISTS (SELECT 1 FROM assessments a WHERE a.finding_id=c.finding_id AND a.context_hash=c.context_hash AND a.reviewer='offensive' AND a.model='review-model' AND a.prompt_version='p1' AND a.completed_at IS NOT NULL)""")
def _(t):
    wanted = t.contexts.select("finding_id", F.lit("offensive").alias("reviewer"), F.lit("review-model").alias("model"), F.lit("p1").alias("prompt_version"), "context_hash")
    return adjudication.still_to_do(wanted, t.assessments).select("finding_id")


@query("snk_07_snippet_free", "findings", sql="SELECT id, rule_id, raw_snippet IS NULL AND false AS has_snippet FROM findings")
def _(t):
    return files.strip_snippets(t.findings).select("id", "rule_id", F.col("raw_snippet").isNotNull().alias("has_snippet"))


@query("snk_08_findings_json", "findings", sql="""SELECT rule_id AS "ruleId", severity, replace(file_path,'\\','/') AS file, line_number AS line, message, coalesce(raw_snippet,'') AS snippet FROM findings""")
def _(t):
    out = files.to_findings_json(t.findings)
    return out.select("ruleId", "severity", F.replace("file", F.lit("\\"), F.lit("/")).alias("file"), "line", "message", F.coalesce("snippet", F.lit("")).alias("snippet"))


@query("tk_06_activity_feed", "findings", "assessments", sql=f"""
, r AS (SELECT a.completed_at AS at_time, 'info' AS level, upper(reviewer) || ' completed finding #' || finding_id AS message, a.classification || ' | ' || CASE {OUT_MODEL.replace('cl ', 'cl ')} WHEN 'true_positive' THEN 'TP' WHEN 'false_positive' THEN 'FP' WHEN 'true_negative' THEN 'TN' WHEN 'false_negative' THEN 'FN' ELSE '?' END || ' | ' || CAST(round(coalesce(confidence,0)*100) AS INT) || '%' AS detail
  FROM (SELECT a.*, f.predicted_label, {CL.replace('classification', 'a.classification')} AS cl FROM assessments a JOIN findings f ON f.id=a.finding_id WHERE completed_at IS NOT NULL ORDER BY completed_at DESC, a.id DESC LIMIT 12) a)
, l AS (SELECT date_trunc('second', ts) AS at_time, level, message, detail FROM ({LOGS}) ORDER BY 1 DESC, message LIMIT 12)
SELECT strftime(at_time,'%Y-%m-%d %H:%M:%S') AS at_time, level, message, detail FROM (SELECT * FROM r UNION ALL SELECT * FROM l) ORDER BY at_time DESC, message, detail LIMIT 20""")
def _(t):
    logs = derived.log_lines(t).withColumn("p", texts.parse_log_line("line")).select(
        F.to_timestamp_ntz("p.date").alias("at"), "p.level", "p.message", F.coalesce("p.detail", F.lit("")).alias("detail"))
    feed = topk.activity_feed(t.assessments, t.findings, logs)
    return feed.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at_time"), "level", "message", "detail")
