"""Domain tables that are themselves results of operators (runs, model states, logs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.tables import CTE
from winnow.operators import latest

QUEUE_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


def review_runs(t) -> DataFrame:
    """Two review runs per scan with findings: its ten most urgent findings each."""
    top = latest.candidates_per_scan(t.findings, 10)
    lists = top.groupBy("scan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda s: s["id"])  # ten at most
        .alias("candidate_finding_ids")
    )
    n = F.size("candidate_finding_ids")
    states = F.array(F.lit("complete"), F.lit("running"), F.lit("queued"), F.lit("failed"), F.lit("complete_with_errors"))
    return (
        lists.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
        .join(t.scans.select(F.col("id").alias("scan_id"), "created_at"), "scan_id")
        .select(
            (F.col("scan_id") * 2 + F.col("v")).alias("id"), "scan_id",
            F.element_at(states, ((F.col("scan_id") + F.col("v")) % 5 + 1).cast("int")).alias("status"),
            "candidate_finding_ids",
            F.least((F.col("scan_id") % 7 + F.col("v")).cast("int"), n * 2).alias("next_step"),
            (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("v"))).alias("heartbeat_at"),
        )
    )


CTE["runs"] = (["findings", "scans"], f"""
SELECT scan_id*2+v AS id, scan_id, CASE (scan_id+v)%5 WHEN 0 THEN 'complete' WHEN 1 THEN 'running' WHEN 2 THEN 'queued' WHEN 3 THEN 'failed' ELSE 'complete_with_errors' END AS status,
  ids AS candidate_finding_ids, CAST(least(scan_id%7+v, len(ids)*2) AS INT) AS next_step, created_at + to_minutes(v) AS heartbeat_at
FROM (SELECT scan_id, list(id ORDER BY pos) AS ids FROM (SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY {QUEUE_RANK}, tp_probability DESC NULLS LAST, id) AS pos FROM findings) WHERE pos<=10 GROUP BY scan_id) c
JOIN scans s ON s.id=c.scan_id, (VALUES (0),(1)) x(v)""")


def model_states(t) -> DataFrame:
    """One training attempt per month of orders: scores from its order counts."""
    per_month = t.raw_orders.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("f"),
        F.max("o_orderdate").cast("timestamp_ntz").alias("trained_at"),
    )
    return per_month.select(
        F.col("month").cast("bigint").alias("id"), "trained_at", F.col("n").alias("sample_size"),
        F.round(F.col("f").cast("double") / F.col("n"), 4).alias("f1_score"),
        F.when(F.col("f") * 3 > F.col("n"), "deployed").otherwise("rejected").alias("deployment_status"),
        F.lit(0.8).alias("decision_threshold"),
        F.concat(F.lit("models/m"), "month").alias("model_path"),
    )


CTE["model_states"] = ([], """
SELECT CAST(strftime(o_orderdate,'%Y%m') AS BIGINT) AS id, max(o_orderdate) AS trained_at, count(*) AS sample_size,
  CAST(round(CAST(count(*) FILTER (o_orderstatus='F') AS DOUBLE)/CAST(count(*) AS DOUBLE),4) AS DOUBLE) AS f1_score,
  CASE WHEN count(*) FILTER (o_orderstatus='F')*3>count(*) THEN 'deployed' ELSE 'rejected' END AS deployment_status
FROM orders GROUP BY 1""")


def log_lines(t) -> DataFrame:
    """Application log lines written from the event stream."""
    e = t.raw_events
    kind = F.col("event_type")
    tail = F.concat(
        F.lit('{"scan_id":'), F.col("user_id").cast("string"),
        F.when(kind == "error", F.lit(',"error":"worker stopped"'))
        .when(kind == "purchase", F.concat(F.lit(',"reviewer":"offensive","duration_seconds":'), (F.col("event_id") % 90).cast("string"),
                                           F.lit(',"prompt_tokens":12,"output_tokens":7')))
        .when(kind == "click", F.lit(',"processed":3,"total":10')).otherwise(F.lit("")),
        F.lit("}"),
    )
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] local."),
        F.when(kind == "error", "ERROR").otherwise("INFO"), F.lit(": Review "), kind,
        F.when(kind == "view", F.lit("")).otherwise(F.concat(F.lit(" "), tail)),
    )
    return e.select("event_id", "user_id", line.alias("line"))
