"""Removes repeated word windows with a log-structured fingerprint index.

The index is a list of immutable runs in the shared folder. A run holds fingerprints of
windows of earlier batches, one row for each distinct context of a content-chosen anchor
(see ``anchors``) that no older run holds, with the first document that has it; it is bucketed
and sorted by fingerprint. A new batch is fingerprinted, bucketed and sorted in the same way, and
merge-joined with each run where both are: the history is not moved again. Then

* an equal context of a smaller document settles all its windows at once;
* contexts that share only the anchor, in the batch or with a run, are *partial*: they are
  verified at the end, window by window, by two independent 64-bit hashes over the words of each
  window, taken from the texts again (of documents with such contexts only);
* contexts that no run holds become the batch's own run.

When ``FANOUT`` runs are there, they are compacted into one. A manifest in the same folder lists
the runs, so that a later session can open the index and add a batch. Batches must come in the
order of their ids.

Results for odd input: null texts have no words; texts shorter than a window lose
nothing; rows that share an id never remove each other's words, rows without one neither; those
come last; an empty table gives an empty table; extra columns are ignored unless kept.
"""

from __future__ import annotations

import contextlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.anchors import anchors_of, cut_spans, listed, ragged, tokens_of
from tallyspark.llm.frames import LAST, drop_stored, identified, shared_folder
from tallyspark.llm.text import prefix_hash, span_hash, text_slices

WIDTH = 50
SIZE = 16
FANOUT = 3
BATCHES = 4

_RUN = ("key", "context", "did", "uid", "pos", "windows", "off")
_COLUMNS = "key BIGINT, context BIGINT, did BIGINT, uid BIGINT, pos INT, windows INT, off INT"
_MATCH = "did long, uid long, pos int, windows int, kind string"


class FingerprintIndex:
    """An index in a folder: a new one, or with ``home`` the one that is there."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, size: int = SIZE, fanout: int = FANOUT, home: str | None = None):
        self.spark, self.home = spark, home or shared_folder(spark)
        self.names: list[str] = []
        self.state = {"width": width, "size": size, "fanout": fanout, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "made": 0, "runs": [], "matches": []}
        if home:
            found = spark.read.text(f"{home}/manifest/*").orderBy(F.get_json_object("value", "$.made").cast("int").desc()).first()
            self.state = json.loads(found["value"])
        self.width, self.size = self.state["width"], self.state["size"]

    @property
    def runs(self) -> list[str]:
        return self.state["runs"]

    def _path(self, kind: str) -> str:
        """A folder that no earlier session has begun: what a killed batch left is in nobody's way, and the manifest doesn't list it."""
        return f"{self.home}/{kind}-{uuid.uuid4().hex}"

    def _told(self) -> None:
        """Writes the manifest of the state after a batch or a compaction."""
        self.state["made"] += 1
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(f"{self.home}/manifest/{self.state['made']:09d}-{uuid.uuid4().hex}")

    def _write(self, rows: DataFrame, path: str, *parts: str) -> None:
        """A table bucketed and sorted by fingerprint in a folder."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*parts) if parts else rows.write
        writer.bucketBy(self.state["buckets"], "key").sortBy("key", "context").format("parquet").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only: the files stay where the manifest says

    def _table(self, path: str, more: str = "") -> DataFrame:
        """A table of the index under a name of its own, which is forgotten after the batch."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({_COLUMNS}{more}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (key) SORTED BY (key, context) INTO {self.state['buckets']} BUCKETS")
        self.names.append(name)
        return self.spark.table(name)

    def _forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")
        self.names = []

    def add(self, batch: DataFrame) -> None:
        """Merges a batch of ``identified`` rows, all with larger ids than those before."""
        with joined_by_bucket(self.spark):
            self._add(batch)
        if len(self.runs) >= self.state["fanout"]:
            self.compact()
        self._forget()
        self._told()

    def _add(self, batch: DataFrame) -> None:
        path = self._path("batch")
        self._write(anchors_of(batch, "word", self.width, self.size, same_document=False).repartition(self.state["buckets"], "key"), path)
        own = self._table(path, ", local BOOLEAN")
        anchors = own.where("not local")
        place = F.struct("did", "uid", "pos")
        keys = anchors.groupBy("key").agg(F.min("context").alias("low"), F.max("context").alias("high"))
        firsts = anchors.groupBy("key", "context").agg(F.min(place).alias("first"))
        rows = own.join(firsts, ["key", "context"], "left").join(keys, "key", "left")
        least, low, high, known = [F.col("first.did")], [F.col("low")], [F.col("high")], F.lit(False)
        part_of_history = None
        for k, run in enumerate(self.runs):
            history = self._table(run)
            rows = rows.join(history.select("key", "context", F.col("did").alias(f"did{k}")), ["key", "context"], "left")
            rows = rows.join(history.groupBy("key").agg(F.min("context").alias(f"low{k}"), F.max("context").alias(f"high{k}")), "key", "left")
            least, low, high, known = [*least, F.col(f"did{k}")], [*low, F.col(f"low{k}")], [*high, F.col(f"high{k}")], known | F.col(f"did{k}").isNotNull()
            part = history.join(keys, "key").where("low <> context or high <> context").select("did", "uid", "pos", "windows", F.lit("part").alias("kind"))
            part_of_history = part if part_of_history is None else part_of_history.unionByName(part)
        smallest = lambda f, c: f(*c) if len(c) > 1 else c[0]
        whole = F.col("local") | (F.col("did") > smallest(F.least, least))
        partly = ~F.col("local") & ~whole & (smallest(F.least, low) != smallest(F.greatest, high))
        fresh = ~F.col("local") & ~known & (F.col("first") == place)
        kinds = F.array_compact(F.array(F.when(whole, F.lit("whole")), F.when(partly, F.lit("part")), F.when(fresh, F.lit("run"))))
        merged = self._path("merged")
        self._write(rows.select(*_RUN, F.explode(kinds).alias("kind")), merged, "kind")
        self.state["matches"].append(merged)
        if part_of_history is not None:
            more = self._path("partial")
            part_of_history.write.partitionBy("kind").parquet(more)
            self.state["matches"].append(more)
        self.runs.append(f"{merged}/kind=run")
        drop_stored(self.spark, path)

    def compact(self) -> None:
        """Merges all runs into one. A context is in one run only, so rows are brought together by bucket and sorted."""
        path = self._path("run")
        rows = None
        for run in self.runs:
            one = self._table(run)
            rows = one if rows is None else rows.unionByName(one)
        self._write(rows.repartition(self.state["buckets"], "key"), path)
        self.state["runs"] = [path]

    def _matched(self, kind: str) -> DataFrame:
        out = None
        for path in self.state["matches"]:
            found = self.spark.read.schema(_MATCH).parquet(path).where(F.col("kind") == kind).select("did", "uid", "pos", "windows")
            out = found if out is None else out.unionByName(found)
        return out

    def repeated(self, docs: DataFrame) -> DataFrame:
        """Verified repeats of all batches: (did, uid, pos, windows). ``docs`` holds the texts of all batches."""
        candidates = self._matched("part").groupBy("did", "uid").agg(F.collect_set(F.struct("pos", "windows")).alias("found"))
        texts = docs.select("did", "uid", "text").join(candidates.hint("shuffle_hash"), ["did", "uid"]).select("did", "uid", "text", "found")
        windows = _windows(texts, self.width)
        least = F.min("did").over(Window.partitionBy("w1", "w2"))
        verified = windows.select("did", "uid", "pos", least.alias("least")).where("did > least").select("did", "uid", "pos", F.lit(1).alias("windows"))
        return self._matched("whole").select("did", "uid", "pos", "windows").unionByName(verified)

    def close(self) -> None:
        drop_stored(self.spark, self.home)


@contextlib.contextmanager
def joined_by_bucket(spark: SparkSession):
    """While the jobs of a batch are planned, joins on (key, context) take tables bucketed by key as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _windows(texts: DataFrame, width: int) -> DataFrame:
    """Both hashes of every window of the partial contexts."""

    def run(batches):
        for batch in batches:
            did, uid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            owner, entries = listed(batch.column(3))
            pos, windows = np.asarray(entries.field("pos")).astype(np.int64), np.asarray(entries.field("windows")).astype(np.int64)
            for first, end, data, offsets in text_slices(batch.column(2)):
                a, b = np.searchsorted(owner, (first, end))
                if a == b:
                    continue
                values, cuts, _, _ = tokens_of(data, offsets, "word")
                row, n = np.repeat(owner[a:b] - first, windows[a:b]), windows[a:b]
                at = ragged(cuts[owner[a:b] - first] + pos[a:b], n)
                w1 = span_hash(prefix_hash(values), at, at + width, 7)
                w2 = span_hash(prefix_hash(tokens_of(data, offsets, "word", 1)[0], 1), at, at + width, 13, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[first:end][row]), pa.array(uid[first:end][row]), pa.array((at - cuts[row]).astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))],
                    names=["did", "uid", "pos", "w1", "w2"],
                )

    return texts.mapInArrow(run, "did long, uid long, pos int, w1 long, w2 long")


def _batches(rows: DataFrame, count: int) -> list[DataFrame]:
    """Ranges of ids of equal width; the last also takes rows without an id."""
    low, high = rows.where(F.col("did") < LAST).agg(F.min("did"), F.max("did")).first()
    if low is None or count == 1:
        return [rows]
    cuts = sorted({low + (high - low + 1) * k // count for k in range(1, count)})
    bounds = list(zip([None, *cuts], [*cuts, None]))
    return [rows.where((F.lit(True) if a is None else F.col("did") >= a) & (F.lit(True) if b is None else F.col("did") < b)) for a, b in bounds]


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, size: int = SIZE, batches: int = BATCHES) -> DataFrame:
    """Cuts the words covered by a ``width``-word window that a document with a smaller id has too.

    Returns the kept columns, kept (binary, words joined by one space), n_units (words),
    n_removed and n_spans. The index stays in the shared folder until the session ends it.
    """
    rows = identified(docs, *keep)
    index = FingerprintIndex(docs.sparkSession, width, size)
    for batch in _batches(rows, batches):
        index.add(batch)
    return cut_spans(rows, index.repeated(rows), "word", width, keep)
