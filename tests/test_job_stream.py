"""The streamed job log against the log as a whole."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.keyed import KeyedTable
from tallyspark.plans import jobs
from tallyspark.sources.versions import new_folder
from tallyspark.streaming import jobs as stream
from tallyspark.streaming.jobs import WATCHDOG, Entry, advance

SCHEMA = "job_id long, ts timestamp, event_id long, status string, expected string"
START = datetime.datetime(2026, 4, 1)


def log(n=600, seed=3, jobs_n=40):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        status = draw.choice(["pending", "running", "complete", "error", "clarification_needed", "odd"])
        expected = None if status == "pending" and draw.random() < 0.8 else draw.choice(["pending", "running", None])
        out.append((draw.randrange(jobs_n), START + datetime.timedelta(seconds=draw.randrange(4 * n)), i, status, expected))
    return sorted(out, key=lambda r: (r[1], r[2]))


def folder_of(spark, portions):
    path = new_folder(spark)
    for rows in portions:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, path, sink, checkpoint, **more):
    frame = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    query = stream.follow(frame, sink, checkpoint, **more)
    query.awaitTermination()
    return rows_of(spark.read.schema(stream.RESULT).parquet(sink))


def rows_of(frame):
    return sorted((r.job_id, r.ts, r.event_id, r.status) for r in frame.select("job_id", "ts", "event_id", "status").collect())


def watched(spark, rows, patience_s):
    """The log with a watchdog's row for each first pending row, as a batch."""
    frame = spark.createDataFrame(rows, SCHEMA)
    last = max(r[1] for r in rows)
    begun = frame.where("status = 'pending' and expected is null").groupBy("job_id").agg(F.min("ts").alias("ts"))
    dog = begun.select("job_id", (F.col("ts") + F.expr(f"INTERVAL {patience_s} SECONDS")).alias("ts"), F.lit(WATCHDOG).alias("event_id"), F.lit("error").alias("status"), F.lit("pending").alias("expected"))
    return frame.unionByName(dog.where(F.col("ts") < F.lit(last)))


@pytest.mark.parametrize("patience_s", [None, 90])
def test_same_as_the_whole_log(spark, patience_s):
    """Fed file by file, in the order of time: the rows that take effect are those of the whole log."""
    rows = log()
    whole = rows_of(jobs.effective(watched(spark, rows, patience_s) if patience_s else spark.createDataFrame(rows, SCHEMA)))
    path = folder_of(spark, [rows[i::1][:200] for i in (0, 200, 400)])
    assert run(spark, path, new_folder(spark), new_folder(spark), patience_s=patience_s) == whole
    assert not patience_s or any(r[2] == WATCHDOG for r in whole)


def test_restart(spark):
    """A stream that is stopped after each file and started again loses and repeats nothing."""
    rows = log(seed=4)
    whole = rows_of(jobs.effective(spark.createDataFrame(rows, SCHEMA)))
    sink, checkpoint, path = new_folder(spark), new_folder(spark), new_folder(spark)
    for part in (rows[:150], rows[150:400], rows[400:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        found = run(spark, path, sink, checkpoint, patience_s=None)
    assert found == whole


def test_job_table(spark):
    """The table by job holds each job's last transition after every run, and gives it by its number."""
    rows = log(seed=6)
    path, checkpoint = new_folder(spark), new_folder(spark)
    table = KeyedTable.create(spark.createDataFrame([], stream.RESULT), new_folder(spark), "job_id", buckets=4)
    for end in (250, 600):
        spark.createDataFrame(rows[end - 250 : end] if end == 250 else rows[250:], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream.keep(spark.readStream.schema(SCHEMA).parquet(path), table, checkpoint, patience_s=None).awaitTermination()
        whole = rows_of(jobs.effective(spark.createDataFrame([r for r in rows if r[1] <= rows[end - 1][1]][:end], SCHEMA)))
        last = {r[0]: r for r in whole}
        assert rows_of(table.read()) == sorted(last.values())
    some = next(iter(last))
    assert rows_of(table.lookup(some)) == [last[some]]


def test_rows_out_of_order(spark):
    """Rows that come after later ones, but not too late, are applied in their place."""
    rows = log(n=300, seed=5)
    draw = random.Random(1)
    shuffled = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=draw.randrange(600)))
    end = (-1, rows[-1][1] + datetime.timedelta(hours=2), 10**6, "odd", None)  # moves the watermark past all others
    path = folder_of(spark, [shuffled[:100], shuffled[100:200], shuffled[200:], [end]])
    whole = rows_of(jobs.effective(spark.createDataFrame(rows, SCHEMA)))
    assert run(spark, path, new_folder(spark), new_folder(spark), late="20 minutes", patience_s=None) == whole


def test_ended_jobs_are_forgotten(spark):
    """After its time a job's state goes, and its number begins a new job."""
    at = lambda s: START + datetime.timedelta(seconds=s)
    portions = [
        [(1, at(0), 1, "pending", None), (1, at(10), 2, "running", "pending"), (1, at(20), 3, "complete", "running"), (2, at(5), 4, "pending", None)],
        [(1, at(30), 5, "pending", None), (3, at(1000), 6, "pending", None)],  # too early: the job has ended, and is known
        [(1, at(2000), 7, "pending", None), (3, at(3000), 8, "odd", None)],
    ]
    found = run(spark, folder_of(spark, portions), new_folder(spark), new_folder(spark), patience_s=90, keep_s=100)
    assert [(r[0], r[2], r[3]) for r in found] == [(1, 1, "pending"), (1, 2, "running"), (1, 3, "complete"), (1, 7, "pending"), (1, WATCHDOG, "error"), (2, 4, "pending"), (2, WATCHDOG, "error"), (3, 6, "pending"), (3, WATCHDOG, "error")]


def test_rows_without_a_job(spark):
    rows = [(None, START, 1, "pending", None), (1, None, 2, "pending", None), (1, START, None, "pending", None), (1, START, 3, None, None)]
    assert run(spark, folder_of(spark, [rows]), new_folder(spark), new_folder(spark)) == []


def test_advance():
    rows = [Entry(5, 1, "pending", None), Entry(5, 2, "running", "pending"), Entry(6, 3, "running", "pending"), Entry(7, 4, "error", "pending"), Entry(9, 5, "complete", "running")]
    assert advance(None, 0, rows[::-1], 100, 90) == ("complete", 9, [rows[0], rows[1], rows[4]])
    assert advance("pending", 5, [Entry(95, 6, "running", "pending")], 95, 90)[0] == "running"
    assert advance("pending", 5, [Entry(96, 6, "running", "pending")], 96, 90) == ("error", 95, [Entry(95, WATCHDOG, "error", "pending")])
    assert advance("pending", 5, [], 95, 90) == ("pending", 5, []) and advance("pending", 5, [], 10**9, None) == ("pending", 5, [])
