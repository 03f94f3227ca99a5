"""Scan progress with bounded state (T05): status per app, which timers let go of.

An app whose scan has ended is forgotten ``keep`` after its last event, one that merely fell silent after ``idle``, in event
time, once the watermark passes. What is kept at a time are the apps under way and those that ended lately, not all
that ever were. An app that comes back later starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("finished", "failed")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LATEST = "status string, at long, event_id long, changes long, expires long"
_UPDATES = "app_id {kind}, status string, updated_at long, changes long"


class Progress(StatefulProcessor):
    def __init__(self, terminal: Sequence[str], keep_ms: int, idle_ms: int):
        self._terminal, self._keep_ms, self._idle_ms = frozenset(terminal), keep_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._latest = handle.getValueState("latest", _LATEST)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self._latest.get() if self._latest.exists() else None
        status, at, event_id, changes, expires = known or (None, None, None, 0, None)
        # Timers that are due fire after the rows of a batch; for these rows they have fired already.
        if expires is not None and expires <= timerValues.getCurrentWatermarkInMs():
            status, at, event_id, changes = None, None, None, 0
        for row in rows:
            changes += 1
            if at is None or (row.at, row.event_id) > (at, event_id):
                status, at, event_id = row.status, row.at, row.event_id
        due = at // 1000 + (self._keep_ms if status in self._terminal else self._idle_ms)
        if due != expires:
            if expires is not None:
                self._handle.deleteTimer(expires)
            self._handle.registerTimer(due)
        self._latest.update((status, at, event_id, changes, due))
        yield Row(app_id=key[0], status=status, updated_at=at, changes=changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def bounded_progress(
    events: DataFrame, delay: str = "1 day", keep: str = "7 days", idle: str = "90 days", terminal: Sequence[str] = TERMINAL
) -> DataFrame:
    """Updates ``(app_id, status, updated_at, changes)`` of a stream ``(app_id, ts, event_id, status)``, in update mode.

    The status is that of the latest event by (time, id). Events with a null time or id are not events of a scan and are left out.
    """
    spark = events.sparkSession
    keep_ms, idle_ms = (int(spark.range(1).select(F.expr(f"unix_millis(timestamp_seconds(0) + INTERVAL {span})")).first()[0]) for span in (keep, idle))
    kind = events.schema["app_id"].dataType.simpleString()
    timed = events.where("ts IS NOT NULL AND event_id IS NOT NULL").select(
        "app_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("event_id").cast("long").alias("event_id"), "status",
    )
    updates = timed.withWatermark("ts", delay).groupBy("app_id").transformWithState(
        Progress(terminal, keep_ms, idle_ms), _UPDATES.format(kind=kind), "update", "eventTime"
    )
    return updates.withColumn("updated_at", F.timestamp_micros("updated_at"))


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """State with timers lives in RocksDB: streams started within use it, whatever the session has."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
