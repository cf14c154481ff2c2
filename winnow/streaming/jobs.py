"""Structured Streaming jobs.

Each epoch writes its own folder with overwrite, so a repeated epoch replaces
itself and no row is written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from winnow.operators import metrics, sets
from winnow.plans import ingest as plan
from winnow.settings import DEFAULTS, Settings
from winnow.sinks import files
from winnow.sources.reports import with_documents
from winnow.streaming import keyed, state

REPORT_SCHEMA = "value string, scan_id bigint, project_id bigint, source string, commit_sha string, branch string"


def report_file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Report files dropped below ``scan_id=../project_id=../source=../commit_sha=../branch=../``."""
    return (
        spark.readStream.format("text").schema(REPORT_SCHEMA).option("wholetext", "true").load(path)
        .select("scan_id", "project_id", "source", "commit_sha", "branch",
                F.col("_metadata.file_size").alias("size_bytes"), F.col("value").alias("report"))
    )


def _table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """What earlier epochs wrote, or None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{root}/{name}") if there else None


def _write(df: DataFrame, root: str, name: str, epoch: int) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/epoch={epoch}")


def run_ingest(arrivals: DataFrame, root: str, rules: DataFrame, checkpoint: str,
               scorer: Callable | None = None, cfg: Settings = DEFAULTS) -> StreamingQuery:
    """Ingest every new report once: the same bytes of a scan are not ingested again, further documents of it are."""

    def epoch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        seen = _table(spark, root, "documents")
        fresh = batch
        if seen is not None:
            earlier = seen.filter(F.col("epoch") != epoch_id).select("scan_id", "document")
            fresh = sets.without(with_documents(batch), earlier, ["scan_id", "document"]).drop("document")
        added = _table(spark, root, "rules")
        known = rules
        if added is not None:
            older = added.filter(F.col("epoch") != epoch_id)
            known = rules.select("external_id", "cwe_id", "description").unionByName(
                older.select("external_id", "cwe_id", "description"))

        def store(df: DataFrame, name: str) -> DataFrame:
            """Documents and findings are written where they stay, and read from there."""
            if name not in ("documents", "findings"):
                return files.stage(df, name)
            _write(df, root, name, epoch_id)
            return spark.read.schema(df.schema).parquet(f"{root}/{name}/epoch={epoch_id}")

        out = plan.ingest(fresh, known, scorer=scorer, cfg=cfg, store=store)
        _write(out.scans, root, "scans", epoch_id)
        _write(out.contexts, root, "contexts", epoch_id)
        _write(out.candidates, root, "candidates", epoch_id)
        _write(out.rules.filter("is_new").drop("is_new"), root, "rules", epoch_id)
        _write(out.rejected, root, "rejected", epoch_id)

    return (
        arrivals.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_scans(spark: SparkSession, root: str) -> DataFrame:
    """One row per scan over all epochs: failed if any document was, counts added up."""
    rows = spark.read.parquet(f"{root}/scans")
    about = ["project_id", "source", "commit_sha", "branch"]
    out = rows.groupBy("scan_id").agg(
        F.min(F.struct(*about)).alias("about"), F.max(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed"),
        F.sum("total_findings").alias("total_findings"), F.sum("suppressed_count").alias("suppressed_count"))
    return out.select("scan_id", "about.*", F.when(F.col("failed") == 1, "failed").otherwise("complete").alias("status"), "total_findings", "suppressed_count")


def decision_stream(events: DataFrame) -> DataFrame:
    """Streaming state per finding: one struct, updated in place; older late events lose by order."""
    return state.decision_state(events)


def run_decisions(events: DataFrame, root: str, checkpoint: str, cfg: Settings = DEFAULTS) -> StreamingQuery:
    """Keep the statistics of rules and the retrain trigger up to date; no epoch reads the history of decisions.

    The last decision of every finding is state; an epoch writes what changed, as
    signed rows, and their sums per rule.  The trigger counts the distinct findings
    whose label changed after the last training (an event with action ``train``),
    fires once when they are enough, and again only after another training.
    """

    def epoch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        _write(batch, root, "changes", epoch_id)
        changes = spark.read.schema(f"{keyed.CHANGES}, epoch bigint").parquet(f"{root}/changes")
        now = changes.filter(F.col("epoch") == epoch_id)
        _write(_rule_sums(now.filter("kind = 'label' AND rule_id IS NOT NULL"), F.col("n"), F.when(F.col("label") == "false_positive", F.col("n"))), root, "rule_stats", epoch_id)
        earlier = _table(spark, root, "retrain")
        last = None if earlier is None else earlier.filter(F.col("epoch") < epoch_id).orderBy(F.col("epoch").desc()).first()
        before = last["trained_at"] if last else None
        trained = now.filter("kind = 'train'").agg(F.max("at")).first()[0]
        trained = before if trained is None or (before is not None and trained <= before) else trained
        # without a training in this epoch its own rows suffice; after one, what came since then is counted once
        same = last is not None and trained == before
        counted = now if same else changes.filter(F.col("epoch") <= epoch_id)
        fresh = F.lit(True) if trained is None else F.col("at") > F.lit(trained)
        pending = (last["pending"] if same else 0) + (counted.filter(F.col("kind") == "label").filter(fresh).agg(F.sum("n")).first()[0] or 0)
        waiting = bool(same and last["waiting"])
        fired = not waiting and pending >= max(1, cfg.retrain_batch_size)
        row = spark.createDataFrame([(trained, pending, fired, waiting or fired)], "trained_at bigint, pending bigint, fired boolean, waiting boolean")
        _write(row, root, "retrain", epoch_id)

    changes = keyed.decision_changes(events)
    return keyed.started(changes.writeStream.outputMode("update").foreachBatch(epoch).option("checkpointLocation", checkpoint).trigger(availableNow=True))


def _rule_sums(df: DataFrame, seen, false_positive) -> DataFrame:
    return df.groupBy("rule_id").agg(F.sum(seen).alias("total_seen"), F.coalesce(F.sum(false_positive), F.lit(0)).alias("total_false_positive"))


def current_rule_stats(spark: SparkSession, root: str, cfg: Settings = DEFAULTS) -> DataFrame:
    """Statistics of every rule ever touched: the sums of all epochs' changes."""
    log = spark.read.parquet(f"{root}/rule_stats")
    return metrics.stats_of_counts(_rule_sums(log, F.col("total_seen"), F.col("total_false_positive")), cfg)


def stalled_stream(beats: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Runs that fell silent while active; ``beats`` has run_id, heartbeat_at and status.  Start it with ``run_stalls``."""
    return keyed.stalls(beats, max(120, cfg.stale_after_seconds))


def run_stalls(beats: DataFrame, path: str, checkpoint: str, cfg: Settings = DEFAULTS, every: str | None = None) -> StreamingQuery:
    """Append stalled runs to ``path``.

    With ``every`` the stream goes on and looks at its clock that often, heartbeats
    or not.  Without, it takes what has arrived, reports what is overdue and ends:
    a clock gives it no end of its own, so it makes no batches without heartbeats.
    """
    writer = stalled_stream(beats, cfg).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if every is not None:
        return keyed.started(writer.trigger(processingTime=every))
    return keyed.started(writer.trigger(availableNow=True), **{"spark.sql.streaming.noDataMicroBatches.enabled": "false"})


def run_append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_state(df: DataFrame, root: str, name: str, checkpoint: str) -> StreamingQuery:
    """Write the changed keys of every epoch; the newest row per key is the state."""
    return (
        df.writeStream.outputMode("update").foreachBatch(lambda b, e: _write(b, root, name, e))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
