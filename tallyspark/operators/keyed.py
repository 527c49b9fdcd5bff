"""A table of rows by key that can be updated: what UPDATE ... WHERE key = ... is to a database.

Rows are dealt to buckets by a hash of their key. An update reads and rewrites only the buckets in
which its keys are, in a folder of its own, and then commits a manifest that lists, for each
bucket, the folder where it is. Readers see one version, writers that lose start again from the
new one. A lookup of keys opens their buckets only, and in them, by Bloom filters, the row
groups that can hold a key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.operators.backlog import updated
from tallyspark.sources.versions import Conflict, Versions


class KeyedTable:
    """Rows with one key column. Rows of a null key are kept and never updated; repeated keys are updated together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        """Writes the first version; a table that is there already is a ``Conflict``."""
        table = cls(rows.sparkSession, path)
        state = {"key": key, "buckets": buckets, "schema": json.loads(rows.schema.json()), "folders": {}}
        table.versions.commit(0, table._written(rows, state))
        return table

    def _bucket(self, state: dict) -> Column:
        return F.pmod(F.xxhash64(state["key"]), F.lit(state["buckets"])).cast("int")

    def _written(self, rows: DataFrame, state: dict) -> dict:
        """Writes rows to a new folder, and the state with their buckets there."""
        folder = uuid.uuid4().hex
        dealt = rows.withColumn("_bucket", self._bucket(state)).hint("rebalance", "_bucket")
        dealt.sortWithinPartitions("_bucket", state["key"]).write.option(f"parquet.bloom.filter.enabled#{state['key']}", "true").partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        found = [int(n.removeprefix("_bucket=")) for n in self.versions.store.names(f"data/{folder}") if n.startswith("_bucket=")]
        return {**state, "folders": {**state["folders"], **{str(b): folder for b in found}}}

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for b, folder in state["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.versions.read(version)[1])

    def lookup(self, *keys) -> DataFrame:
        """Rows of some keys."""
        state = self.versions.read()[1]
        kind = StructType.fromJson(state["schema"])[state["key"]].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType().add(state["key"], kind))
        buckets = [r[0] for r in asked.select(self._bucket(state)).distinct().collect()]
        return self._rows(state, buckets).where(F.col(state["key"]).isin(list(keys)))

    def update(self, results: DataFrame, *columns: str, clock: Column | None = None, attempts: int = 5, insert: bool = False) -> int:
        """Gives rows the values that results (key, columns, stamp) have for them; of several the last by stamp.
        Returns the version that was made. Keys that no row has change nothing, or with ``insert`` become rows, null in all other columns."""
        for attempt in range(attempts):
            try:
                return self._update(results, columns, clock, insert)
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("no attempt")

    def _update(self, results: DataFrame, columns: tuple[str, ...], clock: Column | None, insert: bool) -> int:
        base, state = self.versions.read()
        results = results.where(F.col(state["key"]).isNotNull())
        touched = [r[0] for r in results.select(self._bucket(state)).distinct().collect()]  # a row for each bucket
        old = self._rows(state, touched)
        stamped = "updated_at" in old.columns
        new = updated(old.withColumn("_was", F.col("updated_at")) if stamped else old, results, state["key"], *columns, clock=clock)
        if stamped:  # rows without a result keep their stamp
            new = new.withColumn("updated_at", F.coalesce("updated_at", "_was") if clock is not None else F.col("_was"))
        if insert:
            latest = results.groupBy(state["key"]).agg(F.max_by(F.struct(*columns), F.struct("stamp", *columns)).alias("_new")).select(state["key"], "_new.*")
            latest = latest.withColumn("updated_at", clock) if stamped and clock is not None else latest
            new = new.unionByName(latest.join(old.select(state["key"]), state["key"], "left_anti"), allowMissingColumns=True)
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromJson(state["schema"])])
        return self.versions.commit(base, self._written(new, state))

    def clear(self, keep: int = 1, older_than: float = 86_400.0) -> list[str]:
        """Deletes versions but the last ``keep``, and folders that no kept version lists and nobody has written to for a day."""
        used = {folder for n in self.versions.numbers()[-keep:] for folder in self.versions.read(n)[1]["folders"].values()}
        return self.versions.clear(used, keep, older_than)
