"""Small literal tables for the tests."""

import hashlib

FINDING = (
    "id bigint, scan_id bigint, rule_id string, cwe_id int, file_path string, line_number int, severity string, message string, "
    "raw_snippet string, feature_vector struct<cwe_id:int,scanner_severity:string,file_extension:string,is_test_file:int,"
    "cyclomatic_complexity:int,has_sanitizer_in_ast:int,line_depth_in_function:int,historical_fp_rate_rule:double,"
    "developer_experience_lvl:string,reaches_request_input:int,taint_steps:int,sanitised_before_sink:int,"
    "attacker_reachable_context:string>, tp_probability double, predicted_label string, final_label string, status string"
)
SCAN = "id bigint, project_id bigint, source string, commit_sha string, branch string, status string"
FEEDBACK = "id bigint, finding_id bigint, user_id bigint, corrected_label string, source string, training_eligible boolean, notes string, updated_at timestamp"
ASSESSMENT = (
    "id bigint, finding_id bigint, reviewer string, model string, prompt_version string, classification string, confidence double, "
    "attacker_controlled boolean, sink_reachable boolean, mitigation_detected boolean, missing_evidence array<string>, "
    "context_hash string, total_duration bigint, completed_at timestamp"
)


def vector(complexity=2, sanitizer=0, depth=3, cwe=89):
    return (cwe, "HIGH", "php", 0, complexity, sanitizer, depth, 0.1, "mid", None, None, None, None)


def finding(i, scan=1, rule="php.security.path-traversal", label=None, vec=True, line=10, message="m", snippet="code($x);", **kw):
    row = dict(
        id=i, scan_id=scan, rule_id=rule, cwe_id=89, file_path=f"src/F{i}.php", line_number=line, severity="HIGH",
        message=message, raw_snippet=snippet, feature_vector=vector() if vec is True else vec, tp_probability=0.9,
        predicted_label="true_positive", final_label=label, status="triaged" if label else "pending",
    )
    row.update(kw)
    return tuple(row[c.split()[0]] for c in _fields(FINDING))


def _fields(ddl):
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def findings(spark, rows):
    return spark.createDataFrame(rows, FINDING)


def scans(spark, rows):
    return spark.createDataFrame([(i, p, "sarif", sha, "main", "complete") for i, p, sha in rows], SCAN)


def feedback(spark, rows):
    """(finding, label, source[, eligible])"""
    return spark.createDataFrame(
        [(r[0], r[0], 1, r[1], r[2], r[3] if len(r) > 3 else True, "", None) for r in rows], FEEDBACK)


def assessments(spark, rows=()):
    return spark.createDataFrame(list(rows), ASSESSMENT)


def bucket(project, commit):
    return int(hashlib.sha256(f"{project}\0{commit}".encode()).hexdigest()[:8], 16) % 100


def commit_for(project, validation, salt=""):
    """A commit whose group falls on the wanted side of a 20 percent split."""
    n = 0
    while True:
        sha = hashlib.sha1(f"{project}-{salt}-{n}".encode()).hexdigest()
        if (bucket(project, sha) < 20) == validation:
            return sha
        n += 1
