"""The job log as a stream: which of its rows take effect, told once nothing earlier can come.

Each job's state is where it stands and those of its rows that are later than the watermark, which a still
later file may yet precede. When the watermark passes a row, it is applied in the order of (ts,
event_id), as ``plans.jobs.effective`` does over the whole log, and if it takes effect it is put
out. A timer ends jobs that have been pending for too long, and another forgets jobs some time after
their end. Both are timers of event time, so a stream that is stopped and started again, or fed in other
portions, gives the same rows, as long as none comes later than the lateness allows: those are dropped.

Rows without a job, time or event are ignored. A row of a job that was forgotten begins a new one.
"""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyspark.operators.keyed import KeyedTable
from tallyspark.plans.jobs import ENDED, PATIENCE_S

RESULT = "job_id long, ts timestamp, event_id long, status string, expected string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the watchdog's rows have for an event, so that they come after all rows of the same time.
WATCHDOG = (1 << 63) - 1


class Entry(NamedTuple):
    """A row of the log; times are microseconds since 1970."""

    ts: int
    event_id: int
    status: str
    expected: str | None


def follows(status: str | None, row: Entry) -> bool:
    """Whether a row takes effect on a job of that status, None for one that has not begun."""
    if status is None:
        return row.status == "pending" and row.expected is None
    if status == "pending":
        return row.expected == "pending" and row.status in ("running", *ENDED)
    return status == "running" and row.expected == "running" and row.status in ENDED


def advance(status: str | None, since: int, rows: list[Entry], now: int, patience: int | None) -> tuple[str | None, int, list[Entry]]:
    """Applies rows in order; the status, since when, and the rows that took effect, with those of the watchdog up to ``now``."""
    took = []
    for row in [*sorted(rows), None]:
        deadline = since + patience if patience is not None else 0
        if patience is not None and status == "pending" and (now if row is None else row.ts) > deadline:
            status, since = "error", deadline
            took.append(Entry(deadline, WATCHDOG, "error", "pending"))
        if row is not None and follows(status, row):
            status, since = row.status, row.ts
            took.append(row)
    return status, since, took


class JobStates(StatefulProcessor):
    def __init__(self, patience: int | None, keep: int):
        self.patience, self.keep = patience, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "status string, since long")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, status string, expected string")
        self.next = handle.getValueState("next", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r.at, r.event_id, r.status, r.expected) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(e[0] for e in new))
        return iter(())

    def _wake(self, ts: int) -> None:
        """Sets the job's one timer of waiting rows to that time, unless there is an earlier one."""
        ms = -(-ts // 1000)
        set_to = self.next.get()[0] if self.next.exists() else None
        if set_to is None or ms < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(ms)
            self.next.update((ms,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [Entry(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = [e for e in held if e.ts <= now]
        status, since = self.place.get() if self.place.exists() else (None, 0)
        if not ready and status in ENDED and now >= since + self.keep:
            self.place.clear()
            if len(held) == 0:
                self.waiting.clear()
            return
        status, since, took = advance(status, since, ready, now, self.patience)
        if ready:
            left = [tuple(e) for e in held if e.ts > now]
            self.waiting.clear()
            self.next.clear()
            if left:
                self.waiting.put(left)
                self._wake(min(e[0] for e in left))
        if took:
            self.place.update((status, since))
            if status == "pending" and self.patience is not None:
                self.handle.registerTimer(-(-(since + self.patience + 1) // 1000))
            if status in ENDED:
                self.handle.registerTimer(-(-(since + self.keep) // 1000))
        for e in took:
            yield Row(job_id=key[0], ts=datetime.datetime.fromtimestamp(e.ts / 1e6, datetime.timezone.utc).replace(tzinfo=None), event_id=e.event_id, status=e.status, expected=e.expected)

    def close(self) -> None:
        pass


def transitions(log: DataFrame, late: str = "0 seconds", patience_s: int | None = PATIENCE_S, keep_s: int = 86_400) -> DataFrame:
    """The rows of a streamed log (job_id, ts, event_id, status, expected) that took effect, and the watchdog's. ``late`` is by how much
    rows may come after later ones; without ``patience_s`` there is no watchdog. Needs the RocksDB state store."""
    known = log.where("job_id is not null and ts is not null and event_id is not null").withWatermark("ts", late)
    rows = known.select("job_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "status", "expected")
    states = JobStates(None if patience_s is None else patience_s * 1_000_000, keep_s * 1_000_000)
    return rows.groupBy("job_id").transformWithState(states, RESULT, "Append", "EventTime")


@contextlib.contextmanager
def _rocks(spark: SparkSession):
    """While a stream is started, its state store is RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(log: DataFrame, table: KeyedTable, checkpoint: str, late: str = "0 seconds", patience_s: int | None = PATIENCE_S, keep_s: int = 86_400) -> StreamingQuery:
    """Takes in all files that have come since the last run and keeps each job's last transition in a table by job_id (with ts,
    event_id, status, expected), where it can be looked up. A batch that is repeated after a failure gives the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the update reads it several times, and each would apply the log again
        try:
            if batch.head(1):
                table.update(batch.select("job_id", "ts", "event_id", "status", "expected", F.struct(F.col("ts"), F.col("event_id")).alias("stamp")), "ts", "event_id", "status", "expected", insert=True)
        finally:
            batch.unpersist()

    with _rocks(log.sparkSession):
        writer = transitions(log, late, patience_s, keep_s).writeStream.outputMode("append").foreachBatch(write)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(log: DataFrame, sink: str, checkpoint: str, late: str = "0 seconds", patience_s: int | None = PATIENCE_S, keep_s: int = 86_400) -> StreamingQuery:
    """Takes in all files that have come since the last run, writes the transitions that are certain, each once, and stops."""
    with _rocks(log.sparkSession):
        writer = transitions(log, late, patience_s, keep_s).writeStream.format("parquet").outputMode("append")
        return writer.option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
