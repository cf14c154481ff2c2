import json
import time
from datetime import datetime, timedelta

from winnow.settings import Settings
from winnow.streaming import jobs, keyed, state

T0 = datetime(2024, 1, 1)
EVENT = "event_id bigint, decided_at timestamp, finding_id bigint, action string, label string, rule_id string"


def event(i, finding, action, label=None, rule="r", minutes=None):
    return (i, T0 + timedelta(minutes=i if minutes is None else minutes), finding, action, label, rule)


def test_undo_and_late_decisions(spark):
    log = spark.createDataFrame([
        event(1, 1, "label", "true_positive"), event(2, 1, "label", "false_positive"), event(3, 2, "label", "true_positive"),
        event(4, 2, "undo"), event(5, 1, "label", "true_positive", minutes=0), event(6, 3, "heartbeat")], EVENT)
    now = {r["finding_id"]: r["label"] for r in state.current_decisions(state.decision_state(log)).collect()}
    assert now == {1: "false_positive"}


def test_decision_job_rules_and_trigger(spark, tmp_path):
    src, root, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    cfg = Settings(retrain_batch_size=3, rule_min_samples=1)

    def push(*rows):
        spark.createDataFrame(list(rows), EVENT).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENT).parquet(src)
        jobs.run_decisions(stream, root, cp, cfg).awaitTermination()
        return {r["epoch"]: (r["pending"], r["fired"], r["waiting"]) for r in spark.read.parquet(f"{root}/retrain").collect()}

    def stats():
        return {r["rule_id"]: (r["total_seen"], r["historical_fp_rate"], r["recommended_action"]) for r in jobs.current_rule_stats(spark, root, cfg).collect()}

    fp = "false_positive"
    assert push(event(1, 1, "label", fp, "a"), event(2, 2, "label", fp, "a"), event(3, 2, "label", fp, "a"))[0] == (2, False, False)
    assert push(event(4, 3, "label", "true_positive", "b"), event(5, 4, "label", fp, "b"), event(6, 4, "heartbeat"))[1] == (4, True, True)
    # enough still, but it has fired; late decisions change nothing, corrections are no further findings
    assert push(event(7, 4, "label", "true_positive", "b"), event(8, 1, "undo", None, "a", minutes=0))[2] == (4, False, True)
    assert stats() == {"a": (2, 1.0, "suppress"), "b": (2, 0.0, None)}
    # a training between the decisions: what came before it no longer counts
    assert push(event(9, None, "train", minutes=6), event(10, 1, "undo", None, "a"), event(11, 2, "undo", None, "a"))[3] == (1, False, False)
    assert stats() == {"a": (0, 0.0, None), "b": (2, 0.0, None)}
    assert push(event(12, 5, "label", fp, "a"), event(13, 6, "label", fp, "c"))[4] == (3, True, True)
    assert stats() == {"a": (1, 1.0, "suppress"), "b": (2, 0.0, None), "c": (1, 1.0, "suppress")}
    batch = spark.read.parquet(src)
    want = state.refresh_rules(state.current_decisions(state.decision_state(batch)), state.touched_rules(batch), cfg)
    assert stats() == {r["rule_id"]: (r["total_seen"], r["historical_fp_rate"], r["recommended_action"]) for r in want.collect()}


def test_stalls_of_silent_active_runs(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    beat = "run_id bigint, heartbeat_at timestamp, status string"
    now = datetime.now()

    def push(*rows):
        spark.createDataFrame(list(rows), beat).coalesce(1).write.mode("append").parquet(src)
        jobs.run_stalls(spark.readStream.schema(beat).parquet(src), out, cp).awaitTermination()
        return sorted((r["run_id"], r["last_heartbeat"], r["beats"]) for r in spark.read.parquet(out).collect())

    first = push((1, T0, "running"), (2, T0, "running"), (2, T0 + timedelta(hours=1), "complete"), (3, now, "running"), (4, None, "running"),
                 (5, T0 + timedelta(hours=2), "queued"), (5, T0, "complete"))
    assert first == [(1, T0, 1), (5, T0 + timedelta(hours=2), 2)]
    # a late beat is no sign of life, a beat now is; a completed run is never reported
    assert push((1, T0 - timedelta(hours=1), "running"), (5, now, "running"), (2, T0 + timedelta(minutes=1), "running"), (3, now, "complete")) == first


def test_a_silent_run_is_reported_without_other_heartbeats(spark, tmp_path, monkeypatch):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    beat = "run_id bigint, heartbeat_at timestamp, status string"
    monkeypatch.setattr(jobs, "stalled_stream", lambda beats, cfg: keyed.stalls(beats, 5))
    spark.createDataFrame([(1, datetime.now(), "running")], beat).coalesce(1).write.parquet(src)
    stream = jobs.run_stalls(spark.readStream.schema(beat).parquet(src), out, cp, every="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            if stream.exception() is not None or any(f.suffix == ".parquet" for f in (tmp_path / "out").glob("*")) and spark.read.parquet(out).count():
                break
    finally:
        stream.stop()
    assert [r["run_id"] for r in spark.read.parquet(out).collect()] == [1]


def test_report_files_are_ingested_once(spark, tmp_path):
    drop, root, cp = tmp_path / "drop", str(tmp_path / "out"), str(tmp_path / "cp")
    body = json.dumps({"results": [{"test_id": "B1", "filename": "f", "line_number": 1, "issue_severity": "HIGH"}]})

    def put(scan, text, name):
        d = drop / f"scan_id={scan}/project_id=5/source=bandit/commit_sha={'a' * 40}/branch=main"
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(text)

    rules = spark.createDataFrame([], "external_id string, cwe_id int, description string")

    def run():
        jobs.run_ingest(jobs.report_file_stream(spark, str(drop)), root, rules, cp).awaitTermination()
        return {r["scan_id"]: (r["status"], r["total_findings"]) for r in jobs.current_scans(spark, root).collect()}

    put(1, body, "a.json")
    put(2, "{broken", "a.json")
    assert run() == {1: ("complete", 1), 2: ("failed", 0)}
    put(1, body, "again.json")
    put(3, body, "a.json")
    assert run() == {1: ("complete", 1), 2: ("failed", 0), 3: ("complete", 1)}
    assert spark.read.parquet(f"{root}/findings").count() == 2
    put(1, body.replace('"f"', '"g"'), "second.json")
    put(3, "{broken", "second.json")
    assert run() == {1: ("complete", 2), 2: ("failed", 0), 3: ("failed", 1)}
    stored = spark.read.parquet(f"{root}/findings")
    assert stored.count() == 3 and stored.select("id").distinct().count() == 3
    assert spark.read.parquet(f"{root}/rules").count() == 1


def test_stalled(spark):
    rows = [(1, 1, "running", T0), (2, 1, "queued", T0 + timedelta(minutes=9)), (3, 2, "complete", T0), (4, 3, "running", None)]
    runs = spark.createDataFrame(rows, "id bigint, scan_id bigint, status string, heartbeat_at timestamp")
    out = state.stalled_runs(runs, T0 + timedelta(minutes=10)).collect()
    assert [(r["id"], r["status"], r["phase"]) for r in out] == [(1, "failed", "stalled")]


def test_feedback_upsert_and_retract(spark):
    rows = [(1, 7, 1, T0, "put", "correct", None), (2, 7, 1, T0 + timedelta(1), "put", "incorrect", "likely_fp"),
            (3, 7, 2, T0, "put", "correct", None), (4, 7, 2, T0 + timedelta(1), "retract", None, None)]
    log = spark.createDataFrame(rows, "id bigint, assessment_id bigint, user_id bigint, reviewed_at timestamp, action string, verdict string, corrected_classification string")
    assert [(r["user_id"], r["verdict"]) for r in state.feedback_state(log).collect()] == [(1, "incorrect")]
