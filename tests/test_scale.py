"""Plans and skew: what must hold at any size."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog.registry import Tables
from tests import data
from winnow.operators import joins, latest, metrics, topk

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "flt_03_trusted_labels", "jn_05_unreviewed_evidence", "jn_08_line_window", "ag_06_project_rollup", "ag_10_outcome_vs_model",
    "tk_01_review_candidates", "wn_05_fingerprint_representative", "jb_03_reviewer_dataset", "sc_12_review_priority"])
def test_no_nested_loops(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["flt_02_unlabelled_queue"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)" in text
    assert "l_tax" in plan(Tables(spark, SF).findings.select("id")) and "l_tax" not in plan(Tables(spark, SF).findings.select("rule_id"))


def test_latest_rows_are_cut_before_the_shuffle(spark):
    t = Tables(spark, SF)
    assert plan(latest.latest_assessment(t.assessments)).count("WindowGroupLimit") == 2
    assert plan(topk.review_candidates(t.findings, t.contexts, t.assessments)).count("WindowGroupLimit") == 2


def test_hot_fingerprint_and_hot_file(spark):
    """One fingerprint and one file hold most rows; results stay whole."""
    rows = [data.finding(i, file_path="hot.php" if i % 3 else f"f{i}.php", line=50 if i % 3 else i % 90 + 1, label="true_positive") for i in range(600)]
    f = data.findings(spark, rows)
    ids = f.select("id", F.concat_ws(":", "file_path", "line_number").alias("fingerprint"), F.col("final_label").alias("label"),
                   F.lit("g").alias("group_key"), F.lit("s").alias("sample"))
    out = latest.dedupe_findings(ids)
    assert out.agg(F.sum("duplicate_count")).first()[0] == 600
    assert out.filter("fingerprint = 'hot.php:50'").select("id", "duplicate_count").first() == (1, 400)
    lines = spark.createDataFrame([(p, n, f"{p} {n}") for p in ("hot.php", "f0.php", "f3.php") for n in range(1, 61)],
                                  "file_path string, line_no int, text string")
    for radius in (3, 8, 20):
        got = {r["id"]: [(w["line_no"], w["flagged"]) for w in r["window"]] for r in joins.line_window(f, lines, radius).collect()}
        assert len(got) == 402
        for i, window in got.items():
            at = rows[i][5]
            assert window == [(n, n == at) for n in range(max(1, at - radius), min(60, at + radius) + 1)]


def test_ambiguity_flags(spark):
    rows = [(i, "hot" if i < 60 else f"h{i % 5}", "true_positive" if i % 2 or i >= 60 else "false_positive") for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, feature_sha256 string, label string")
    flags = {r["id"]: r["ambiguous_feature"] for r in metrics.flag_ambiguous(df).collect()}
    assert flags == {i: i < 60 for i in range(90)}


def test_deep_page_by_key_equals_offset(spark):
    t = Tables(spark, SF)
    second = [tuple(r) for r in topk.queue_page(t.findings, page=2).select("file_path", "line_number", "id").collect()]
    first = topk.queue_page(t.findings, page=1).select("file_path", "line_number", "id").collect()
    after = tuple(first[-1])
    assert [tuple(r) for r in topk.queue_page(t.findings, after=after).select("file_path", "line_number", "id").collect()] == second


def test_shared_folder_is_required_off_local(spark, monkeypatch):
    from winnow import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_snapshot_moves_only_what_is_wanted(spark):
    """Without payload the snapshot decides the same, and neither texts nor vectors reach a shuffle."""
    from winnow.plans import snapshot

    t = Tables(spark, SF)
    lean = snapshot.training_snapshot(t.findings, t.scans, t.feedback, keep=())
    whole = snapshot.training_snapshot(t.findings, t.scans, t.feedback)
    assert {"file_path", "severity", "commit_sha"} <= set(whole.rows.columns) and not {"file_path", "severity", "commit_sha"} & set(lean.rows.columns)
    names = ["id", "fingerprint", "group_key", "sample", "label", "label_source", "duplicate_count", "split", "ambiguous_feature"]
    assert sorted(map(tuple, lean.rows.select(names).collect())) == sorted(map(tuple, whole.rows.select(names).collect()))
    rows = snapshot.hashed(t.findings.filter("final_label IS NOT NULL"), (), "final_label")
    assert rows.columns == ["id", "scan_id", "final_label", "fingerprint", "sample"] and dict(rows.dtypes)["fingerprint"] == "binary"


def test_reviewer_records_move_each_review_three_times(spark):
    """Reviews meet verdicts by id, everything else by finding, and are ranked by evidence; hashes need not be hex."""
    from winnow.plans import reviewer_export

    hashes = {1: "ab" * 32, 2: "AB" * 32, 3: "not hex", 4: "", 5: "abc", 6: "a\nb"}
    f = data.findings(spark, [data.finding(i, label="true_positive") for i in hashes])
    fb = data.feedback(spark, [(i, "true_positive", "human") for i in hashes])
    review = lambda i, k, h: (i * 10 + k, i, "offensive", "m", "p", "likely_tp", 0.5, None, None, None, None, h, None, datetime(2024, 1, k))
    a = data.assessments(spark, [review(i, k, h) for i, h in hashes.items() for k in (1, 2)] + [review(1, 3, "stale"), review(2, 3, None)])
    ctx = spark.createDataFrame([(i, h, f"context {i}") for i, h in hashes.items()], "finding_id bigint, context_hash string, context string")
    af = spark.createDataFrame([], "id bigint, assessment_id bigint, verdict string, corrected_classification string, reason_codes array<string>, notes string, reviewed_at timestamp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = reviewer_export.reviewer_records(a, af, fb, f, data.scans(spark, [(1, 1, "c")]), ctx)
        got = {r["assessment_id"]: (r["context_hash"], r["input_context"]) for r in rows.collect()}
        text = plan(reviewer_export.reviewer_records(a, af, fb, f, data.scans(spark, [(1, 1, "c")]), ctx))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i * 10 + 2: (h, f"context {i}") for i, h in hashes.items()}
    # three for the reviews, one each for verdicts, triage, evidence and scans, two for the findings
    assert text.count("Exchange hashpartitioning") == 9


def _plain_windows(findings, lines, radius):
    out = {}
    for i, path, at in findings:
        if path is not None and at is not None:
            hits = [(n, t, n == at) for p, n, t in lines if p == path and n is not None and max(1, at - radius) <= n <= at + radius]
            out.setdefault(i, []).extend(hits)
    return {i: sorted(w, key=lambda x: (x[0], x[1] or "")) for i, w in out.items() if w}


@pytest.mark.parametrize("radius", [0, 1, 3, 8])
def test_line_windows_match_brute_force(spark, radius):
    """Also for repeated and null ids, repeated lines, null files and lines, and places outside the file."""
    lines = [("a", n, f"t{n}") for n in range(1, 90)] + [("b", 5, "x"), ("b", 5, "y"), ("b", None, "z"), (None, 3, "n"), ("b", 0, "zero")]
    findings = [(n, "a", n) for n in range(-3, 100)] + [(7, "b", 5), (7, "b", 5), (None, "a", 4), (None, "b", 6), (500, None, 3), (501, "b", None), (502, "c", 1)]
    f = spark.createDataFrame(findings, "id bigint, file_path string, line_number int")
    side = spark.createDataFrame(lines, "file_path string, line_no int, text string")
    for together in (False, True):
        rows = [(r["id"], [tuple(x) for x in r["window"]]) for r in joins.line_window(f, side, radius, together=together).collect()]
        assert len(rows) == len(dict(rows)) and dict(rows) == _plain_windows(findings, lines, radius)


def test_windows_are_not_moved_line_by_line(spark):
    lines = spark.range(1, 400).selectExpr("'a' AS file_path", "int(id) AS line_no", "repeat('x', 200) AS text")
    f = spark.range(1, 400).selectExpr("id", "'a' AS file_path", "int(id) AS line_number")
    plan = joins.line_window(f, lines, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence" in plan and plan.count("collect_list(_line") == 2 and "collect_list(struct(line_no" not in plan


def test_scans_meet_projects_before_findings(spark):
    from tests import data

    f = data.findings(spark, [data.finding(1, 1), data.finding(2, 1), data.finding(3, 2), data.finding(4, 9)])
    s = data.scans(spark, [(1, 1, "aa"), (2, 2, "bb"), (2, 2, "bb")])
    p = spark.createDataFrame([(1, "one", "/x"), (2, "two", None), (2, "two", None)], "id bigint, name string, source_path string")
    out = joins.with_scan(f, s, p)
    assert out.columns == ["project_id", "scan_id", *[c for c in f.columns if c != "scan_id"], "scanner_source", "commit_sha", "branch", "project_name", "source_path"]
    assert sorted((r["id"], r["project_name"]) for r in out.collect()) == [(1, "one"), (2, "one")] + [(3, "two")] * 4


def test_lines_redacted_by_block_are_the_redacted_window(spark):
    """Secrets at and over the ends of lines, repeated lines and ids, and numbers as long as a token."""
    import random

    from winnow.plans import context

    draw = random.Random(7)
    bits = ["authorization: bearer", "Authorization:", "bearer abcdefgh1234", "$token = ", "'s3cretvalue", "api_key=>\\", "password: \"", "secret", "x1y2z3w4==", "", "  ", "\t=", "\r", "\"", "// é"]
    lines = [(p, n, "".join(draw.choice(bits) for _ in range(draw.randint(0, 4))) if draw.random() < 0.95 else None)
             for p, first in (("a.php", 1), ("b.php", 9_999_950), ("c.php", 999_990)) for n in range(first, first + 120) for _ in range(draw.choice([1, 1, 1, 2]))]
    lines += [("d.php", 9_999_999, "authorization: bearer"), ("d.php", 10_000_000, "$x;")]
    rows = [(draw.randint(1, 300), p, n) for p, n, _ in lines] + [(999, "d.php", 9_999_999)]
    side = spark.createDataFrame(lines, "file_path string, line_no int, text string")
    f = spark.createDataFrame(rows, "id bigint, file_path string, line_number int")
    got = {r["id"]: r["code"] for r in context.source_windows(f, side).collect()}
    want = {r["id"]: r["code"] for r in joins.line_window(f, side, 20).select("id", joins.window_code("window").alias("code")).collect()}
    assert got == want and len(got) > 200 and "[REDACTED:BEARER_TOKEN] | $x;" in got[999] and "[REDACTED:PASSWORD]" in "".join(got.values())
    # the patterns stand below the join, where a line is met once per block
    plan = context.source_windows(f, side)._jdf.queryExecution().optimizedPlan().toString()
    assert any("collect_list" in x and "REDACTED:API_KEY_OR_TOKEN" in x for x in plan.splitlines())


def test_a_reader_of_some_report_parts_moves_only_what_they_need(spark):
    t = Tables(spark, SF)
    lines = t.blame.select("file_path", "line_no", F.col("author").alias("text"))
    whole = joins.finding_report(t.findings, t.scans, t.projects, t.feedback, t.assessments, lines)
    some = ["finding.project", "location.directory", "reviewers[0].evaluation_outcome AS a", "reviewers[1].available AS b", "size(code.lines) AS n", "code.available AS c"]
    moved = [x for x in plan(whole.selectExpr("id", *some)).splitlines() if "Project" in x or "Scan" in x]
    assert moved and not any(c in x for x in moved for c in (" AS message#", " AS severity#", " AS suggested_fix#", " AS status#", "o_orderpriority"))
    assert any(" AS message#" in x for x in plan(whole).splitlines()) and "o_orderpriority" in plan(whole)
    kept = whole.select("id", *[F.expr(x) for x in some]).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in spark.createDataFrame(whole.collect(), whole.schema).selectExpr("id", *some).collect())
