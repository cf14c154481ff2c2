import hashlib
import json
from pathlib import Path

import pytest

from tests import data
from winnow.operators import metrics, sets
from winnow.plans import export, reviewer_export, snapshot
from winnow.sinks import files


def read(path):
    return [json.loads(line) for p in sorted(Path(path).glob("part-*")) for line in p.read_text().splitlines()]


def build(spark):
    t, v = data.commit_for(1, False), data.commit_for(1, True)
    scans = data.scans(spark, [(1, 1, t), (2, 1, v)])
    tp, fp = "true_positive", "false_positive"
    f = data.findings(spark, [
        data.finding(1, 1, label=tp), data.finding(2, 1, label=fp), data.finding(3, 2, label=tp), data.finding(4, 2, label=fp),
        data.finding(5, 1, label=tp),                      # no feedback
        data.finding(6, 1, label=tp),                      # machine label
        data.finding(7, 1, label=tp), data.finding(8, 2, label=tp, file_path="src/F7.php"),   # copies over both groups
        data.finding(9, 1, label=tp), data.finding(10, 1, label=fp, file_path="src/F9.php"),  # contradiction
        data.finding(11, 1, label=tp),                     # feedback says otherwise
        data.finding(12, 1, label=tp),                     # excluded from training
        data.finding(20, 1, message='$api_key = "abcdefghijklmnop";', snippet="=$token = \"zyxwvutsrq\";"),
        data.finding(21, 2, file_path="src/F20.php", message='$api_key = "abcdefghijklmnop";', snippet="=$token = \"zyxwvutsrq\";"),
        data.finding(22, 1, vec=None),
    ])
    fb = data.feedback(spark, [(1, tp, "human"), (2, fp, "benchmark"), (3, tp, "import"), (4, fp, "human"), (6, tp, "ai_pseudo"),
                               (7, tp, "human"), (8, tp, "human"), (9, tp, "human"), (10, fp, "human"), (11, fp, "human"), (12, tp, "human", False)])
    a = data.assessments(spark, [(1, 20, "offensive", "m", "p", "likely_tp", 0.5, None, None, None, None, "h", None, None),
                                 (2, 21, "defensive", "m", "p", "likely_fp", None, None, None, None, None, "h", None, None)])
    return f, scans, fb, a


def test_routing_and_files(spark, tmp_path):
    f, s, fb, a = build(spark)
    m = export.export_dataset(f, s, fb, a, str(tmp_path), "one")
    out = tmp_path / "one"
    train, val = read(out / "train.jsonl"), read(out / "validation.jsonl")
    ids = {r["finding_id"] for r in train + val}
    assert {1, 2, 3, 4} <= ids and ids & {7, 8} and not ids & {5, 6, 9, 10, 11, 12}
    assert next(r for r in train + val if r["finding_id"] in (7, 8))["duplicate_count"] == 2
    assert all(r["split"] == "train" for r in train) and not {r["group_sha256"] for r in train} & {r["group_sha256"] for r in val}
    reasons = {r["finding_id"]: r["quarantine_reason"] for r in read(out / "quarantine.jsonl")}
    assert reasons == {5: "unattributed_label", 6: "ai_pseudo_label", 11: "inconsistent_label", 12: "label_quality_review"}
    review = read(out / "review_queue.jsonl")
    assert len(review) == 1 and review[0]["duplicate_count"] == 2 and review[0]["label"] is None and review[0]["human_label"] == ""
    blob = "".join(p.read_text() for p in out.rglob("part-*"))
    assert "abcdefghijklmnop" not in blob and "zyxwvutsrq" not in blob and "[REDACTED:API_KEY_OR_TOKEN]" in blob
    csv = "".join(p.read_text() for p in (out / "review_queue.csv").glob("part-*.csv"))
    assert csv.count(",human_label") == 1 and "'=$token" in csv
    assert m["counts"] == {"train": len(train), "validation": len(val), "quarantine": 4, "review_queue": 1}
    assert m["snapshot_statistics"]["excluded_conflicts"] == 2 and m["snapshot_statistics"]["excluded_duplicates"] == 1
    for name, e in m["files"].items():
        parts = sorted(hashlib.sha256(p.read_bytes()).hexdigest() for p in (out / name).glob("part-*"))
        assert e["sha256"] == hashlib.sha256(":".join(parts).encode()).hexdigest()


def test_same_export_twice(spark, tmp_path):
    f, s, fb, a = build(spark)
    one = export.export_dataset(f, s, fb, a, str(tmp_path), "a")
    two = export.export_dataset(f.repartition(3), s, fb, a, str(tmp_path), "b")
    assert one["dataset_fingerprint"] == two["dataset_fingerprint"]
    for name in one["files"]:
        if name.endswith("jsonl"):
            assert read(tmp_path / "a" / name) == read(tmp_path / "b" / name)
    with pytest.raises(Exception, match="(?i)exists"):
        export.export_dataset(f, s, fb, a, str(tmp_path), "a")


@pytest.mark.parametrize("name", ["/abs", "a/../b", "C:/x", "//net", "./a", " "])
def test_output_paths(name):
    with pytest.raises(ValueError):
        files.relative_output(name)


def test_arguments(spark, tmp_path):
    f, s, fb, a = build(spark)
    for kw in ({"percent": 0}, {"percent": 51}, {"review_limit": -1}):
        with pytest.raises(ValueError):
            export.export_dataset(f, s, fb, a, str(tmp_path), "x", **kw)
    with pytest.raises(ValueError):
        reviewer_export.chosen_reviewers("nobody")


def test_every_vectorised_finding_lands_once(spark):
    f, s, fb, a = build(spark)
    snap = snapshot.training_snapshot(f, s, fb)
    trusted = {r["fingerprint"] for r in snap.rows.collect()}
    conflict = {r["fingerprint"] for r in snap.deduped.filter("label_conflict").collect()}
    quarantine = {r["fingerprint"] for r in export.quarantine_rows(f, s, fb, snap.rows).collect()}
    review = {r["fingerprint"] for r in export.review_rows(f, s, a, snap.rows).collect()}
    groups = [trusted, conflict, quarantine, review]
    assert sum(map(len, groups)) == len(set().union(*groups))
    every = snapshot.identified(f.filter("feature_vector IS NOT NULL"), s).select("fingerprint").distinct().count()
    assert every == len(set().union(*groups))


def test_cap_matches_brute_force(spark):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), i, "true_positive" if i % 3 else "false_positive") for i in range(3000)]
    df = spark.createDataFrame(rows, "fingerprint string, id bigint, label string")
    limits = spark.createDataFrame([("true_positive", 701), ("false_positive", 13)], "label string, limit bigint")
    got = {r["id"] for r in sets.cap_per_label(df, limits).collect()}
    want = set()
    for label, n in (("true_positive", 701), ("false_positive", 13)):
        want |= {r[1] for r in sorted(r for r in rows if r[2] == label)[:n]}
    assert got == want


def test_fingerprint_ignores_order_but_not_content(spark):
    rows = [(str(i), "g", "true_positive", "s") for i in range(50)]
    cols = "fingerprint string, group_key string, label string, sample string"
    a = metrics.dataset_fingerprint(spark.createDataFrame(rows, cols)).first()[0]
    b = metrics.dataset_fingerprint(spark.createDataFrame(rows[::-1], cols).repartition(7)).first()[0]
    c = metrics.dataset_fingerprint(spark.createDataFrame(rows[:-1] + [("49", "g", "false_positive", "s")], cols)).first()[0]
    assert a == b != c


def test_rule_statistics(spark):
    from winnow.settings import Settings

    tp, fp = "true_positive", "false_positive"
    labels = {"a": [fp] * 5, "b": [fp] * 3 + [tp], "c": [fp] * 3}
    rows, n = [], 0
    for rule, ls in labels.items():
        for label in ls:
            n += 1
            rows.append(data.finding(n, rule=rule, label=label, vec=None))
    fb = data.feedback(spark, [(r[0], r[-2], "human") for r in rows])
    out = {r["rule_id"]: (r["historical_fp_rate"], r["recommended_action"])
           for r in metrics.rule_stats(data.findings(spark, rows), fb, Settings(rule_min_samples=4)).collect()}
    assert out == {"a": (1.0, "suppress"), "b": (0.75, "review_config"), "c": (1.0, None)}


def test_compressed_export_holds_the_same_rows(spark, tmp_path):
    f, s, fb, a = build(spark)
    plain = export.export_dataset(f, s, fb, a, str(tmp_path), "plain")
    packed = export.export_dataset(f, s, fb, a, str(tmp_path), "packed", compression="gzip")
    assert packed["counts"] == plain["counts"] and set(packed["files"]) == set(plain["files"])
    for name, e in packed["files"].items():
        parts = sorted((tmp_path / "packed" / name).glob("part-*"))
        assert parts and all(p.name.endswith(".gz") for p in parts) and e["bytes"] == sum(p.stat().st_size for p in parts)
        same = [sorted(spark.read.text(str(tmp_path / d / name)).toPandas()["value"]) for d in ("plain", "packed")]
        assert same[0] == same[1]


def test_priorities_move_only_what_they_need(spark):
    """Without the columns shown of other tables the ranks are the same, and nothing is written for one reader of the snapshot."""
    from __spark_entry__ import queries

    from catalog.registry import Tables
    from winnow.plans import snapshot

    t = Tables(spark, "/root/testdata/sf0.001")
    whole = snapshot.training_snapshot(t.findings, t.scans, t.feedback)
    full = export.review_rows(t.findings, t.scans, t.assessments, whole.kept)
    lean = export.review_rows(t.findings, t.scans, t.assessments, whole.kept, keep=())
    assert {"ambiguous_feature", "advisory_assessments"} <= set(full.columns) and not {"ambiguous_feature", "advisory_assessments"} & set(lean.columns)
    names = ["id", "fingerprint", "priority_score", "priority_reasons"]
    assert sorted(map(tuple, lean.select(names).collect())) == sorted(map(tuple, full.select(names).collect()))
    plan = queries()["sc_12_review_priority"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "feature_sha256" not in plan and "confidence" not in plan
    once = snapshot.training_snapshot(t.findings, t.scans, t.feedback, once=True).kept
    assert not any("deduped" in f for f in once.inputFiles())
    assert sorted(once.select("id", "split").collect()) == sorted(whole.kept.select("id", "split").collect())


def reviewed(spark):
    """Reviews (some with the same or no id), verdicts, findings, scans and contexts."""
    from datetime import datetime

    day = [datetime(2024, 1, d) for d in range(1, 29)]
    tp = "true_positive"
    f = data.findings(spark, [data.finding(1, 1, label=tp), data.finding(2, 1), data.finding(3, 2), data.finding(4, 9, label=tp), data.finding(5, 2, label=tp)])
    s = data.scans(spark, [(1, 1, data.commit_for(1, True)), (2, 2, None)])
    a = data.assessments(spark, [
        (10, 1, "offensive", "m", "p", "likely_tp", 0.5, None, None, None, None, "h1", None, day[1]),
        (10, 3, "offensive", "m", "p", "likely_fp", 0.5, None, None, None, None, "h3", None, day[1]),  # an id again
        (11, 2, "defensive", "m", "p", "likely_fp", 0.5, None, None, None, None, "h2", None, day[2]),
        (12, 2, "offensive", "m", "p", "likely_fp", 0.5, None, None, None, None, "old", None, day[2]),  # of older evidence
        (13, 2, "offensive", "m", "p", "likely_fp", 0.5, None, None, None, None, "h2", None, day[2]),  # nobody said anything
        (14, 4, "offensive", "m", "p", "likely_fp", 0.5, None, None, None, None, "h4", None, day[2]),  # no scan
        (None, 5, "offensive", "m", "p", "likely_fp", 0.5, None, None, None, None, "h5", None, day[2]),
        (15, None, "offensive", "m", "p", "likely_fp", 0.5, None, None, None, None, "h5", None, day[2]),
        (16, 5, "offensive", "m", "p", "likely_tp", 0.5, None, None, None, None, "h5", None, day[1])])
    af = spark.createDataFrame(
        [(1, 10, "correct", None, None, "n", day[3]), (2, 10, "incorrect", "confirmed_fp", None, "n", day[4]), (3, 11, "correct", None, ["other"], None, day[4]),
         (4, 12, "correct", None, None, None, day[4]), (5, 14, "correct", None, None, None, day[4]), (6, None, "correct", None, None, None, day[4]), (7, 15, "correct", None, None, None, day[4])],
        "id bigint, assessment_id bigint, verdict string, corrected_classification string, reason_codes array<string>, notes string, reviewed_at timestamp")
    ctx = spark.createDataFrame([(1, "h1", "$token = 'abcdefgh'"), (2, "h2", "c2"), (3, "h3", "c3"), (4, "h4", "c4"), (5, "h5", "c5")], "finding_id bigint, context_hash string, context string")
    return a, af, data.feedback(spark, [(5, tp, "human")]), f, s, ctx


def test_verdicts_reach_every_review_of_their_id(spark):
    rows = reviewer_export.reviewer_records(*reviewed(spark)).collect()
    got = {(r["reviewer"], r["finding_id"]): (r["assessment_id"], r["verdict"], r["reference_classification"], r["split"], r["feedback_source"]) for r in rows}
    said, seen = "ai_assessment_feedback", "triage_feedback"
    assert len(rows) == 4 and got == {
        ("offensive", 1): (10, "incorrect", "confirmed_fp", "validation", said), ("offensive", 3): (10, "incorrect", "confirmed_fp", got["offensive", 3][3], said),
        ("defensive", 2): (11, "correct", "likely_fp", "validation", said), ("offensive", 5): (None, None, "confirmed_tp", got["offensive", 5][3], seen)}


def test_reviews_stay_while_verdicts_find_their_finding(spark):
    """Neither commits, nor reviews with all their columns, are moved where two ids or a side of the split will do."""
    rows = reviewer_export.reviewer_records(*reviewed(spark)).select("assessment_id", "split", "outcome")
    by_id, commits = [], []
    for line in rows._jdf.queryExecution().executedPlan().toString().splitlines():
        by_id += [line] if "hashpartitioning(id" in line else []
        commits += [line] if "Project" in line and "commit_sha" in line and "project_id" in line and "_held" not in line else []
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "_held" in plan and len(by_id) == 1
    scan_join = [x for x in plan.splitlines() if "Project" in x and "_held" in x]
    assert scan_join and not any("commit_sha" in x.split("[", 1)[1].split("AS _held")[-1] for x in scan_join)


def test_reviewer_files_may_be_compressed_and_leave_no_staged_rows(spark, tmp_path):
    records = reviewer_export.reviewer_records(*reviewed(spark))
    before = {p.name for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent.glob("*reviewer-records*")} if spark.sparkContext.getCheckpointDir() else set()
    plain = reviewer_export.export_reviewer_dataset(records, str(tmp_path), "plain")
    packed = reviewer_export.export_reviewer_dataset(records, str(tmp_path), "packed", compression="gzip")
    assert packed["counts"] == plain["counts"] and plain["record_count"] == 4
    for name, e in packed["files"].items():
        parts = sorted((tmp_path / "packed" / name).glob("part-*"))
        assert parts and all(p.name.endswith(".gz") for p in parts) and e["bytes"] == sum(p.stat().st_size for p in parts)
        same = [sorted(r["value"] for r in spark.read.text(str(tmp_path / d / name)).collect()) for d in ("plain", "packed")]
        assert same[0] == same[1]
    staged = files.stage(records, "gone")
    files.drop_staged(staged)
    assert not Path(staged._staged_at).exists() and before is not None


def test_staged_rows_go_when_their_last_reader_is_done(spark, tmp_path, monkeypatch):
    """Written rows are given back, the largest before the next are written; the small lists of rules and hashes may stay."""
    f, s, fb, a = build(spark)
    made, left = [], {}
    stage, jsonl = files.stage, files.write_jsonl
    monkeypatch.setattr(files, "stage", lambda df, name: made.append((name, out := stage(df, name))) or out)

    def write(df, path, *more):
        left[path.rsplit("/", 1)[1]] = {n for n, x in made if Path(x._staged_at).exists()}
        jsonl(df, path, *more)

    monkeypatch.setattr(files, "write_jsonl", write)
    export.export_dataset(f, s, fb, a, str(tmp_path), "one")
    names = {n for n, _ in made}
    assert {"deduped", "snapshot", "quarantine", "representatives", "review"} <= names
    assert not {"deduped", "representatives"} & left["review_queue.jsonl"] and "review" not in left["train.jsonl"]
    assert {n for n, x in made if Path(x._staged_at).exists()} <= {"ambiguous", "rules"}


def test_written_representatives_get_the_same_flags_and_reviews(spark):
    """Also for repeated and null ids, and for samples that are ambiguous in the snapshot."""
    f, s, fb, a = build(spark)
    tp, fp = "true_positive", "false_positive"
    v, w = data.vector(complexity=33), data.vector(complexity=44)
    more = [data.finding(40, 1, label=tp, vec=v), data.finding(41, 2, label=fp, vec=v), data.finding(50, 1, vec=v), data.finding(50, 1, vec=w, file_path="src/again.php"),
            data.finding(None, 1, vec=v, file_path="src/none.php"), data.finding(None, 2, vec=w, file_path="src/none2.php"), data.finding(0, 2, vec=w, file_path="src/zero.php")]
    f = f.unionByName(data.findings(spark, more))
    fb = fb.unionByName(data.feedback(spark, [(40, tp, "human"), (41, fp, "human")]))
    a = a.unionByName(data.assessments(spark, [(i, k, "offensive", "m", "p", "likely_tp", 0.5, None, None, None, None, "h", None, None) for i, k in ((3, 50), (4, None), (5, 0))]))
    from pyspark.sql import functions as F

    a = a.withColumn("completed_at", F.timestamp_seconds("id"))
    kept = snapshot.training_snapshot(f, s, fb).kept
    plain = export.review_rows(f, s, a, kept)
    best = files.stage(export.review_representatives(f, s), "representatives")
    for rows in (kept, metrics.flag_ambiguous(kept)):
        written = export.review_rows(f, s, a, rows, best=best)
        assert written.columns == plain.columns and sorted(map(str, written.collect())) == sorted(map(str, plain.collect()))
    flags = {(r["finding_id"], r["file_path"]): (r["ambiguous_feature"], len(r["advisory_assessments"])) for r in written.collect()}
    assert flags[50, "src/F50.php"] == (True, 1) and flags[50, "src/again.php"] == (False, 1) and flags[0, "src/zero.php"] == (False, 1)
    assert flags[None, "src/none.php"] == (True, 0) and flags[None, "src/none2.php"] == (False, 0)
