"""Stateful processors: one small state per finding or run, kept by Spark's state store.

Each is a few comparisons per key; what it returns moves on as a DataFrame.
Times are microseconds, so no time zone is involved.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from winnow import fixed_values as fv

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class DecisionChanges(StatefulProcessor):
    """What a finding's newest decision changes: -1 for the label it replaces, +1 for the new one.

    Decisions come in any order; one older than the kept one changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint, event_id bigint, label string, rule_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = None
        for r in rows:
            if r["action"] == "train":
                yield change(None, None, r["at"], "train", 0)
            elif newest is None or (r["at"], r["event_id"]) > (newest["at"], newest["event_id"]):
                newest = r
        if newest is None:
            return
        old = self.last.get()
        if old is not None and (newest["at"], newest["event_id"]) <= (old[0], old[1]):
            return
        label = newest["label"] if newest["action"] == "label" else None
        self.last.update((newest["at"], newest["event_id"], label, newest["rule_id"]))
        if old is not None and old[2] is not None:
            yield change(old[3], old[2], old[0], "label", -1)
        yield change(newest["rule_id"], label, newest["at"], "label", 0 if label is None else 1)

    def close(self) -> None:
        pass


def change(rule_id, label, at, kind, n) -> Row:
    return Row(rule_id=rule_id, label=label, at=at, kind=kind, n=n)


CHANGES = "rule_id string, label string, at bigint, kind string, n int"


def decision_changes(events: DataFrame) -> DataFrame:
    """Signed changes of labels (rule_id, label, at, kind, n) from a stream of decisions.

    An undo leaves a row with ``n`` 0, so its rule is known as touched; an event
    with action ``train`` (a training has ended) passes as one of kind ``train``.
    Events without a time say nothing; heartbeats neither.
    """
    at = F.unix_micros(F.col("decided_at").cast("timestamp"))
    acts = events.where(F.col("action").isin("label", "undo", "train")).select("finding_id", at.alias("at"), "event_id", "action", "label", "rule_id")
    return acts.where("at IS NOT NULL").groupBy("finding_id").transformWithState(DecisionChanges(), CHANGES, "Update", "None")


class Stalls(StatefulProcessor):
    """A run is reported once its newest heartbeat is older than the limit, if it was active then."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "at bigint, status string, beats bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        beats = [(r["at"], r["status"]) for r in rows]
        old = self.run.get()
        known = [] if old is None else [(old[0], old[1])]
        at, status = max([*beats, *known], key=lambda b: (b[0], b[1] or ""))
        self.run.update((at, status, len(beats) + (0 if old is None else old[2])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status in fv.ACTIVE_RUN_STATUSES:
            self.handle.registerTimer(at // 1000 + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, status, beats = self.run.get()
        if status in fv.ACTIVE_RUN_STATUSES:
            # kept as failed, so it is not reported again without a newer heartbeat
            self.run.update((at, "failed", beats))
            yield Row(run_id=key[0], at=at, beats=beats)

    def close(self) -> None:
        pass


def stalls(beats: DataFrame, limit_seconds: int) -> DataFrame:
    """run_id, last_heartbeat, beats of runs that fell silent while active, from a stream of (run_id, heartbeat_at, status).

    The clock is the stream's own, so a silent run is reported without any other
    run's heartbeat, as long as the stream triggers.  Beats without a time say nothing.
    """
    rows = beats.select("run_id", F.unix_micros(F.col("heartbeat_at").cast("timestamp")).alias("at"), "status").where("at IS NOT NULL")
    kind = beats.schema["run_id"].dataType.simpleString()
    out = rows.groupBy("run_id").transformWithState(Stalls(limit_seconds * 1000), f"run_id {kind}, at bigint, beats bigint", "Append", "ProcessingTime")
    return out.select("run_id", F.timestamp_micros("at").alias("last_heartbeat"), "beats")


def started(writer, **settings):
    """Start a stream with the state store these processors need (and other settings), leaving the session's own as they were."""
    spark = writer._spark
    settings = {PROVIDER: ROCKS, **settings}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
