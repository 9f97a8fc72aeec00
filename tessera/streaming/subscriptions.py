"""Who follows a key is told of its events: arbitrary state by key, with timers of event time.

A key has one subscriber. A newer one takes its place, an event that ends the matter is the last it is told, and after
some time without either the subscription lapses, whether or not another event of the key ever comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

LASTING = 30 * 60
REPLACED, EXPIRED = "replaced", "expired"
TOLD = Row("key", "subscriber", "status", "at")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Following(StatefulProcessor):
    """State of a key: its subscriber and since when, in microseconds. Times of timers are in milliseconds."""

    def __init__(self, begins: tuple[str, ...], ends: tuple[str, ...], lasting: int):
        self.begins, self.ends, self.lasting = begins, ends, lasting * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("subscriber", "id long, since long")

    def _timer(self, since: int) -> int:
        return -(-(since + self.lasting) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = held = tuple(self.state.get()) if self.state.exists() else None
        for r in sorted(rows, key=lambda r: (r.at, r.id)):  # of one batch
            if held and r.at >= held[1] + self.lasting:
                yield TOLD(*key, held[0], EXPIRED, held[1] + self.lasting)
                held = None
            if r.what in self.begins:
                if held and (r.at, r.id) < (held[1], held[0]):
                    continue  # came late: the newer stays
                if held:
                    yield TOLD(*key, held[0], REPLACED, r.at)
                held = (r.id, r.at)
            elif held and r.at >= held[1]:
                yield TOLD(*key, held[0], r.what, r.at)
                held = None if r.what in self.ends else held
        if held != before:
            if before:
                self.handle.deleteTimer(self._timer(before[1]))
            if held:
                self.state.update(held)
                self.handle.registerTimer(self._timer(held[1]))
            else:
                self.state.clear()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            held = tuple(self.state.get())
            if self._timer(held[1]) == expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield TOLD(*key, held[0], EXPIRED, held[1] + self.lasting)

    def close(self) -> None:
        pass


def followed(stream: DataFrame, key: str, begins: tuple[str, ...], ends: tuple[str, ...], lasting: int = LASTING, late: str = "1 hour") -> DataFrame:
    """A stream of events (key, event_id, event_type, ts) to what subscribers are told: (key, subscriber, status, at in
    microseconds). Types in ``begins`` subscribe, the subscriber being the event's id; those in ``ends`` are the last that
    one is told. A subscription that another replaces is told ``replaced``, one that is ``lasting`` seconds old ``expired``:
    by an event of its key that comes later, or when the watermark passes, whichever is first.

    Events of a batch are taken in order of time and id, whatever order they came in, so a key's events of one batch are
    held by a task: ``maxFilesPerTrigger`` bounds them. Later than ``late``, or without key, time or type, they are left
    out; without anyone subscribed they go by. The stream's query needs :func:`state_on_disk`."""
    rows = stream.where(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("event_type").isNotNull()).withWatermark("ts", late)
    rows = rows.select(F.col(key).alias("key"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("what"), F.unix_micros("ts").alias("at"))
    kind = stream.schema[key].dataType.simpleString()
    told = f"key {kind}, subscriber long, status string, at long"
    found = rows.groupBy("key").transformWithState(_Following(begins, ends, lasting), told, "Append", "EventTime")
    return found.withColumnRenamed("key", key)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB, which timers need and which may be larger than memory. The
    session's setting is as before afterwards."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, was)
