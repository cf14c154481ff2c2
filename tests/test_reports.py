import json

from pyspark.sql import functions as F

from tests.data import FINDING, finding
from winnow.plans import ingest
from winnow.sinks import files as sink
from winnow.sources import files, reports

SARIF = {
    "runs": [{
        "tool": {"driver": {"rules": [
            {"id": "r1", "properties": {"tags": ["CWE-1"]}},
            {"id": "r1", "properties": {"tags": ["x", "cwe-89", "CWE-5"]}},
            {"id": "r2"}]}},
        "results": [
            {"ruleId": "r1", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {
                "artifactLocation": {"uri": "a.php"}, "region": {"startLine": 4, "snippet": {"text": "s"}}}}]},
            {"ruleId": "r2", "properties": {"severity": "critical", "cweId": 22}, "locations": [{"physicalLocation": {}}]},
            {"level": "none", "locations": [{"physicalLocation": {"region": {}}}]},
            {"ruleId": "dropped"}]}],
}


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "scan_id bigint, source string, report string")


def test_sarif(spark):
    rows = [tuple(r)[1:] for r in reports.read_sarif(frame(spark, (1, "sarif", json.dumps(SARIF)))).collect()]
    assert rows == [
        ("r1", 89, "a.php", 4, "HIGH", "m", "s"),
        ("r2", 22, "unknown", 1, "CRITICAL", "", None),
        ("unknown", None, "unknown", 1, "MEDIUM", "", None)]


def test_other_scanners(spark):
    semgrep = {"results": [
        {"check_id": "c", "path": "p", "start": {"line": 3}, "extra": {"severity": "error", "metadata": {"cwe": ["CWE-78: x"]}}},
        {"extra": {"metadata": {"cwe": "x cwe-22"}}}, {}]}
    sonar = {"issues": [{"rule": "r", "component": "proj:src/a:b.php", "severity": "blocker", "line": 2, "message": "m"}, {}]}
    bandit = {"results": [{"test_id": "B1", "issue_cwe": {"id": 78}, "filename": "f", "line_number": 9, "issue_severity": "weird"}]}
    phpcs = {"files": {"x.php": {"messages": [{"source": "s", "line": 1, "type": "ERROR", "message": "m"}, {"type": "WARNING"}]}}}
    df = frame(spark, *[(i, s, json.dumps(b)) for i, (s, b) in enumerate(
        [("semgrep", semgrep), ("sonarqube", sonar), ("bandit", bandit), ("phpcs", phpcs)])], (9, "bandit", "{broken"), (10, "nessus", "{}"))
    got = {}
    for r in reports.normalize_reports(df).collect():
        got.setdefault(r["source"], []).append((r["rule_id"], r["cwe_id"], r["file_path"], r["line_number"], r["severity"]))
    assert got["semgrep"] == [("c", 78, "p", 3, "ERROR"), ("unknown", 22, "unknown", 1, "MEDIUM"), ("unknown", None, "unknown", 1, "MEDIUM")]
    assert got["sonarqube"] == [("r", None, "src/a:b.php", 2, "BLOCKER"), ("unknown", None, "unknown", 1, "MEDIUM")]
    assert got["bandit"] == [("B1", 78, "f", 9, "MEDIUM")]
    assert got["phpcs"] == [("s", None, "x.php", 1, "HIGH"), ("unknown", None, "x.php", 1, "MEDIUM")]
    assert [r["scan_id"] for r in reports.split_malformed(df)[1].collect()] == [9]
    assert [r["scan_id"] for r in reports.split_supported(df)[1].collect()] == [10]


def test_all_formats_in_one_pass(spark, tmp_path):
    """One scan of the reports, rules of a run found by its own results only, places numbered through a document."""
    runs = {"runs": [
        {"results": [{"ruleId": "r1", "locations": [{"physicalLocation": {}}]}]},
        {},
        {**SARIF["runs"][0], "results": SARIF["runs"][0]["results"][:1]}]}
    rows = [(1, "sarif", json.dumps(runs)), (2, "bandit", json.dumps({"results": [{"test_id": "B"}] * 2})), (3, "phpcs", '{"files": {"a": {}, "b": {"messages": [{}]}}}'),
            (4, "sonarqube", "{}"), (5, "semgrep", '{"results": null}'), (6, "sarif", None), (7, None, "{}"), (8, "bandit", '{"results": [{"test_id": "x"}')]
    path = str(tmp_path / "reports")
    frame(spark, *rows).write.parquet(path)
    out = reports.normalize_reports(reports.with_documents(spark.read.parquet(path)))
    got = sorted((r["scan_id"], r["ordinal"], r["rule_id"], r["cwe_id"], r["file_path"]) for r in out.collect())
    assert got == [(1, 0, "r1", None, "unknown"), (1, 1, "r1", 89, "a.php"), (2, 0, "B", None, "unknown"), (2, 1, "B", None, "unknown"), (3, 0, "unknown", None, "b")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_added_reader_beside_the_built_in_ones(spark):
    """Its equal rows get ids of their own, beside those of the places of the others."""
    def reader(df):
        rows = df.select("scan_id", F.explode(F.split(F.get_json_object("report", "$.l"), ",")).alias("rule_id"))
        none = F.lit(None).cast("string")
        return rows.select("scan_id", "rule_id", F.lit(None).cast("int").alias("cwe_id"), F.lit("f").alias("file_path"), F.lit(1).alias("line_number"),
                           F.lit("LOW").alias("severity"), F.lit("").alias("message"), none.alias("snippet"))

    reports.register_reader("plain", reader)
    try:
        df = reports.with_documents(frame(spark, (1, "plain", '{"l": "a,a,b"}'), (1, "bandit", json.dumps({"results": [{"test_id": "a"}] * 2}))))
        rows = ingest.with_ids(reports.normalize_reports(df)).collect()
        assert sorted((r["source"], r["rule_id"]) for r in rows) == [("bandit", "a"), ("bandit", "a"), ("plain", "a"), ("plain", "a"), ("plain", "b")]
        assert len({r["id"] for r in rows}) == 5
    finally:
        reports.READERS.pop("plain")


def test_arrivals(spark):
    rows = [(1, 1, "sarif", "A" * 40, "main", 10), (2, 1, "nessus", "g" * 40, "b" * 256, 10), (3, None, "sarif", "a" * 39, "", 60_000_000)]
    df = spark.createDataFrame(rows, "scan_id bigint, project_id bigint, source string, commit_sha string, branch string, size_bytes bigint")
    out = {r["scan_id"]: r for r in reports.validate_arrivals(df).collect()}
    assert out[1]["reject_reasons"] == [] and out[1]["commit_sha"] == "a" * 40
    assert out[2]["reject_reasons"] == ["source_unsupported", "commit_malformed", "branch_length"]
    assert out[3]["reject_reasons"] == ["project_missing", "commit_malformed", "branch_length", "report_too_large"]


def test_sarif_round_trip_in_parts(spark):
    rows = [finding(i, rule="team.rule", severity=s, cwe_id=c) for i, (s, c) in enumerate([("CRITICAL", 78), ("HIGH", 22), ("LOW", None)] * 40)]
    df = spark.createDataFrame(rows, FINDING)
    docs = sink.to_sarif(df, per_document=10)
    assert docs.count() > 5
    back = reports.read_sarif(docs)
    cols = ["rule_id", "cwe_id", "file_path", "line_number", "severity", "message", "snippet"]
    want = df.withColumnRenamed("raw_snippet", "snippet")
    assert back.select(cols).exceptAll(want.select(cols)).count() == 0 and back.count() == 120


def test_source_tree(spark, tmp_path):
    for p, text in {"app/A.php": "a\nb", "Vendor/x/B.php": "x", "app/c.js": "x", "app/storage/D.php": "x", "E.php": "e" * 30}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    from winnow.settings import Settings

    s = Settings(max_file_bytes=20)
    status = {r["path"]: r["status"] for r in files.list_source_files(spark, str(tmp_path), s).collect()}
    assert status == {"app/A.php": "scanned", "Vendor/x/B.php": "excluded", "app/c.js": "other", "app/storage/D.php": "excluded", "E.php": "skipped"}
    lines = files.read_source_lines(spark, str(tmp_path), s).orderBy("line_no").collect()
    assert [(r["file_path"], r["line_no"], r["text"]) for r in lines] == [("app/A.php", 1, "a"), ("app/A.php", 2, "b")]


def test_ingest_keeps_equal_rows_and_registers_rules_once(spark):
    body = {"results": [{"test_id": "B9", "filename": "f", "line_number": 1, "issue_severity": "HIGH", "issue_text": "t"}] * 3}
    arrivals = spark.createDataFrame(
        [(1, 1, "bandit", "a" * 40, "main", 10, json.dumps(body)), (2, 1, "bandit", "b" * 40, "main", 10, "{oops"), (3, 1, "bandit", "zz", "main", 10, "{}"),
         (4, 1, "bandit", "c" * 40, "main", 10, '{"results":[]}')],
        "scan_id bigint, project_id bigint, source string, commit_sha string, branch string, size_bytes bigint, report string")
    rules = spark.createDataFrame([("known", 1, "d")], "external_id string, cwe_id int, description string")
    out = ingest.ingest(arrivals, rules)
    found = out.findings.collect()
    assert len(found) == 3 and len({r["id"] for r in found}) == 3
    assert found[0]["feature_vector"]["cyclomatic_complexity"] == 1 and found[0]["tp_probability"] is None
    assert {r["scan_id"]: (r["status"], r["total_findings"]) for r in out.scans.collect()} == {1: ("complete", 3), 2: ("failed", 0), 4: ("complete", 0)}
    assert [r["scan_id"] for r in out.rejected.collect()] == [3]
    assert [r["external_id"] for r in out.rules.filter("is_new").collect()] == ["B9"]
    assert out.contexts.filter(F.col("context").contains("source workspace unavailable")).count() == 3


def test_projects_that_share_paths_stay_apart(spark):
    body = json.dumps({"results": [{"test_id": "B9", "filename": "index.php", "line_number": 7, "issue_severity": "HIGH", "issue_text": "t"}]})
    arrivals = spark.createDataFrame(
        [(1, 1, "bandit", "a" * 40, "main", 10, body), (2, 2, "bandit", "b" * 40, "main", 10, body), (2, 2, "bandit", "b" * 40, "main", 10, body),
         (2, 2, "bandit", "b" * 40, "main", 10, "{oops")],
        "scan_id bigint, project_id bigint, source string, commit_sha string, branch string, size_bytes bigint, report string")
    rules = spark.createDataFrame([], "external_id string, cwe_id int, description string")
    kinds = "project_id bigint, commit_sha string, file_path string, line_no int"
    code = spark.createDataFrame([(p, c * 40, "index.php", 7, n, 0, 1) for p, c, n in [(1, "a", 5), (2, "b", 9)]], kinds + ", cyclomatic_complexity int, has_sanitizer_in_ast int, line_depth_in_function int")
    lines = spark.createDataFrame([(1, "a" * 40, "index.php", 7, "first();"), (2, "b" * 40, "index.php", 7, "second();")], kinds + ", text string")
    out = ingest.ingest(arrivals, rules, code=code, lines=lines)
    assert {r["scan_id"]: r["feature_vector"]["cyclomatic_complexity"] for r in out.findings.collect()} == {1: 5, 2: 9}
    ids = {r["id"]: r["scan_id"] for r in out.findings.collect()}
    shown = {ids[r["finding_id"]]: r["context"] for r in out.contexts.collect()}
    assert "first();" in shown[1] and "second();" in shown[2] and "first();" not in shown[2]
    assert {r["scan_id"]: (r["status"], r["total_findings"]) for r in out.scans.collect()} == {1: ("complete", 1), 2: ("failed", 1)}


def _arrivals(spark):
    doc = lambda *lines: '{"results":[' + ",".join(f'{{"test_id":"B1","filename":"a.py","line_number":{n}}}' for n in lines) + "]}"
    rows = [(1, 7, "a" * 40, doc(1, 2)), (1, 7, "a" * 40, doc(1, 2)), (2, 7, "b" * 40, doc(3)), (2, 6, "c" * 40, doc(4)), (3, 7, "d" * 40, "{nope"), (None, 7, "e" * 40, doc(9))]
    return spark.createDataFrame([(i, p, "bandit", c, "main", 10, r) for i, p, c, r in rows],
                                 "scan_id bigint, project_id bigint, source string, commit_sha string, branch string, size_bytes bigint, report string")


def test_ingestion_moves_neither_reports_nor_findings(spark):
    """Reports that come once, and their findings, are written where they were read; repeated ones count once."""
    from winnow.sinks import files

    rules = spark.createDataFrame([("B1", 1, "x", 0.5)], "external_id string, cwe_id int, description string, historical_fp_rate double")
    moved = {}

    def store(df, name):
        moved[name] = "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()
        return files.stage(df, name)

    ingest.ingest(_arrivals(spark).filter("scan_id = 3 OR project_id = 6"), rules, store=store)
    assert moved == {"documents": False, "registered": False, "findings": False}
    out = ingest.ingest(_arrivals(spark), rules, store=store)
    found = {(r["scan_id"], r["line_number"], r["project_id"], r["commit_sha"][0], r["feature_vector"]["historical_fp_rate_rule"]) for r in out.findings.collect()}
    assert found == {(1, 1, 7, "a", 0.5), (1, 2, 7, "a", 0.5), (2, 3, 6, "c", 0.5), (2, 4, 6, "c", 0.5)} and out.findings.count() == 4
    assert sorted(((r["scan_id"] or 0, r["status"], r["total_findings"]) for r in out.scans.collect())) == [
        (0, "complete", 0), (1, "complete", 2), (2, "complete", 2), (3, "failed", 0)]
    assert out.documents.count() == 5


def test_rows_apart_by_hashes_equal_plain_ones(spark):
    from winnow.operators import sets

    schema = "a bigint, b string, wide string"
    rows = spark.createDataFrame([(1, "x", "w"), (1, "x", "w"), (1, "y", "w"), (None, "x", "w"), (None, "x", "w"), (None, None, "w"), (2, None, "w")], schema)
    taken = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (2, None), (5, "z")], "a bigint, b string")
    def key(r):
        return (r["a"] or 0, r["b"] or "")

    for some in (rows, rows.distinct()):
        assert sorted(map(key, sets.once_each(some, ["a", "b"]).collect())) == sorted(map(key, some.dropDuplicates(["a", "b"]).collect()))
        for other in (taken, taken.filter("a = 5")):
            got = sets.without(some, other, ["a", "b"])
            assert got.columns == some.columns and sorted(map(key, got.collect())) == sorted(map(key, some.join(other, ["a", "b"], "left_anti").collect()))
