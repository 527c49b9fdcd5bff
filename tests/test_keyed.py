"""Keyed updates: one version at a time, of two writers one loses, of a killed one nothing is seen."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.keyed import KeyedTable
from tallyspark.sources.versions import Conflict, Versions, new_folder


@pytest.fixture
def table(spark):
    rows = spark.createDataFrame([(i, f"t{i}", i % 3, None) for i in range(200)] + [(None, "no key", 0, None), (7, "again", 1, None)], "id long, topic string, n int, updated_at timestamp")
    return KeyedTable.create(rows, new_folder(spark), "id", buckets=8)


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, topic string, stamp int")


def topics(frame):
    return sorted(((r.id, r.topic) for r in frame.collect()), key=str)


def test_update(spark, table):
    before = topics(table.read())
    assert len(before) == 202 and before == topics(table.read(1))
    assert table.update(results(spark, (3, "old", 1), (3, "new", 2), (7, "both", 1), (999, "nobody", 1), (None, "null", 1)), "topic") == 2
    after = dict.fromkeys(before)
    assert set(topics(table.read())) == {(k, "new") if k == 3 else (k, "both") if k == 7 else (k, t) for k, t in after}
    assert topics(table.read(1)) == before  # the old version is as it was


def test_insert(spark, table):
    """With insert, keys that are not there become rows; a second time they are updated."""
    at = datetime.datetime(2026, 4, 1, 12)
    before = topics(table.read())
    for round_ in range(2):
        table.update(results(spark, (3, "new", 1), (5000, "first", 1), (5000, f"last {round_}", 2), (None, "null", 1)), "topic", clock=F.lit(at), insert=True)
        found = {r.id: r for r in table.read().collect() if r.id is not None}
        assert table.read().count() == len(before) + 1
        assert (found[5000].topic, found[5000].n, found[5000].updated_at, found[3].topic) == (f"last {round_}", None, at, "new")
    empty = KeyedTable.create(table.read().limit(0), new_folder(spark), "id", buckets=4)
    empty.update(results(spark, (1, "x", 1), (2, "y", 1)), "topic", insert=True)
    assert topics(empty.read()) == [(1, "x"), (2, "y")] and topics(empty.lookup(2)) == [(2, "y")]


def test_only_touched_buckets_are_written(spark, table):
    first = table.versions.read()[1]["folders"]
    table.update(results(spark, (3, "new", 1)), "topic")
    second = table.versions.read()[1]["folders"]
    assert sum(first[b] != second[b] for b in first) == 1 and len(first) == 8


def test_clock(spark, table):
    at = datetime.datetime(2026, 4, 1, 12)
    table.update(results(spark, (3, "new", 1)), "topic", clock=F.lit(at))
    table.update(results(spark, *[(i, "later", 1) for i in range(4, 60)]), "topic", clock=F.lit(datetime.datetime(2026, 5, 1)))
    stamps = {r.id: r.updated_at for r in table.read().collect()}
    assert stamps[3] == at and stamps[4] == datetime.datetime(2026, 5, 1) and stamps[100] is None


def test_second_writer_loses(spark, table, monkeypatch):
    """Both start from version 1; the one that comes second gets a conflict, or starts again and keeps what the first wrote."""
    base, state = table.versions.read()
    other = KeyedTable(spark, table.path)
    written = KeyedTable._written
    raced = []

    def late(self, rows, state):
        if self is other and not raced:
            raced.append(table.update(results(spark, (3, "first", 1)), "topic"))
        return written(self, rows, state)

    monkeypatch.setattr(KeyedTable, "_written", late)
    with pytest.raises(Conflict):
        other.update(results(spark, (4, "second", 1)), "topic", attempts=1)
    assert raced == [2] and dict(topics(table.read()))[4] == "t4"
    assert other.update(results(spark, (4, "second", 1)), "topic") == 3
    found = dict(topics(table.read()))
    assert (found[3], found[4]) == ("first", "second")


def test_many_writers(spark, table):
    """Threads that write at once: each version is one writer's, no update is lost."""
    made, failed = [], []

    def write(k):
        try:
            made.append(KeyedTable(spark, table.path).update(results(spark, (k, f"by {k}", 1)), "topic", attempts=20))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(20, 24)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(made) == [2, 3, 4, 5]
    found = dict(topics(table.read()))
    assert [found[k] for k in range(20, 24)] == [f"by {k}" for k in range(20, 24)]


def test_killed_writer(spark, table):
    """A writer that ends after its files and before its manifest leaves the table as it was, and usable."""
    before = topics(table.read())
    _, state = table.versions.read()
    table._written(spark.createDataFrame([(3, "lost", 1, None)], table.read().schema), state)
    assert topics(KeyedTable(spark, table.path).read()) == before
    table.update(results(spark, (3, "kept", 1)), "topic")
    assert dict(topics(table.read()))[3] == "kept"
    assert table.clear(older_than=0.0) and dict(topics(table.read()))[3] == "kept"
    assert len(table.versions.numbers()) == 1


def test_create_twice(spark, table):
    with pytest.raises(Conflict):
        KeyedTable.create(table.read(), table.path, "id")


def test_lookup(spark, table):
    """A lookup reads the key's bucket only."""
    frame = table.lookup(3, 4)
    assert topics(frame) == [(3, "t3"), (4, "t4")] and len(frame.inputFiles()) <= 4 < len(table.read().inputFiles())
    assert table.lookup(12345).collect() == []


def test_empty_update_and_empty_table(spark, table):
    before = topics(table.read())
    table.update(results(spark), "topic")
    assert topics(table.read()) == before
    empty = KeyedTable.create(table.read().limit(0), new_folder(spark), "id")
    empty.update(results(spark, (1, "x", 1)), "topic")
    assert empty.read().collect() == [] and empty.read().columns == table.read().columns


def test_manifest_is_whole_or_not_there(spark):
    versions = Versions(spark, new_folder(spark))
    assert versions.read() == (0, {})
    assert versions.commit(0, {"a": "é"}) == 1
    with pytest.raises(Conflict):
        versions.commit(0, {"a": 2})
    assert versions.read() == (1, {"a": "é"}) and versions.store.names("_drafts") == []


def test_lookup_reads_little(spark):
    """A lookup reads few rows of a large table, and none for a key that no Bloom filter holds."""
    rows = spark.range(200_000).select((F.col("id") * 7).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    table = KeyedTable.create(rows, new_folder(spark), "id", buckets=16)

    def read(frame, name):
        spark.sparkContext.setJobGroup(name, name)
        found = frame.select(F.sum(F.length("text")), F.count("*")).first()[1]
        store, tracker = spark._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
        stages = [store.lastStageAttempt(s) for job in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(job).stageIds]
        spark.sparkContext.setJobGroup("", "")
        return found, sum(s.inputRecords() for s in stages)

    found, every = read(table.read(), "whole")
    one, few = read(table.lookup(700), "one")
    none, seen = read(table.lookup(701), "none")
    assert (found, one, none) == (200_000, 1, 0)
    assert every == 200_000 and 0 < few <= 20_000 and seen == 0
