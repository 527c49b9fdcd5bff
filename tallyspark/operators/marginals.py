"""Standing marginals: partial aggregates of answers by month, from which cross-tabs are answered without the facts.

For each month and cell of the chosen dimensions there is a row of sums: answers, known values,
their total, and any further counts. They add up to cells of fewer dimensions and longer times, so
means are made of sums, never of means. People can't be added up, as one may answer in many months: for
these there are, by month and base (a question, say), bitmaps of their ids, which merge exactly, and
sketches, which merge approximately and stay small.

A load replaces the months it holds, so that it may be repeated; other months stay as they are, and
readers see one version of the list of months (``sources.versions``).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.operators.metrics import MIN_N, n_band
from tallyspark.sources.versions import Versions


class Marginals:
    """``dims`` are the columns of the cells, ``base`` those for which people are counted; ``measure`` is averaged,
    ``person`` is a whole number from 0 on."""

    def __init__(self, spark: SparkSession, path: str, dims: list[str], base: list[str], measure: str = "joy_index", person: str = "respondent_id"):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        self.dims, self.base, self.measure, self.person = dims, base, measure, person

    def load(self, answers: DataFrame, **counts: Column) -> None:
        """Replaces the months that the answers hold (year_month; null is no month). ``counts`` are conditions whose answers are counted too.
        The answers are read twice, for sums and for people: what is costly to join should be written before."""
        rows = answers.where("year_month is not null")
        load = uuid.uuid4().hex
        value = F.col(self.measure)
        sums = [F.count("*").alias("n"), F.count(value).alias("known"), F.sum(value).alias("total"), *[F.count_if(c).alias(name) for name, c in counts.items()]]
        cells = rows.groupBy("year_month", *self.dims).agg(*sums)
        cells.write.partitionBy("year_month").parquet(f"{self.path}/data/cells/load={load}")
        people = self._people(rows)
        people.write.partitionBy("year_month").parquet(f"{self.path}/data/people/load={load}")
        months = [n.removeprefix("year_month=") for n in self.versions.store.names(f"data/cells/load={load}") if n.startswith("year_month=")]
        counted = {n.removeprefix("year_month=") for n in self.versions.store.names(f"data/people/load={load}")}
        schemas = {"cells": cells.schema.json(), "people": people.schema.json()}
        self.versions.change(lambda state: {**state, **schemas, "months": {**state.get("months", {}), **{m: [load, m in counted] for m in months}}})

    def _people(self, rows: DataFrame) -> DataFrame:
        """Bitmaps and sketches of ids by month and base. Ids are shuffled, not bitmaps: a part of one has 4 kB whatever its few
        ids, and each task would send one for each group."""
        person, group = F.col(self.person).cast("long"), ["year_month", *self.base, "bucket"]
        known = rows.where(person.isNotNull()).select("year_month", *self.base, F.bitmap_bucket_number(person).alias("bucket"), person.alias("person"))
        return known.repartition(*group).groupBy(*group).agg(F.bitmap_construct_agg(F.bitmap_bit_position("person")).alias("bits"), F.hll_sketch_agg("person").alias("sketch"))

    def _read(self, what: str, since: str | None, until: str | None) -> DataFrame:
        _, state = self.versions.read()
        if not state:
            raise ValueError(f"nothing was loaded to {self.path}")
        months = {m: load for m, (load, people) in state["months"].items() if (since is None or m >= since) and (until is None or m <= until) and (people or what == "cells")}
        schema = StructType.fromJson(json.loads(state[what]))
        paths = [f"{self.path}/data/{what}/load={load}/year_month={m}" for m, load in sorted(months.items())]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{what}").parquet(*paths)

    def months(self) -> list[str]:
        return sorted(self.versions.read()[1].get("months", {}))

    def crosstab(self, *dims: str, min_n: int = MIN_N, since: str | None = None, until: str | None = None) -> DataFrame:
        """Mean and sample size of each cell of these dimensions (year_month may be one) with at least ``min_n`` answers, both months included."""
        cells = self._read("cells", since, until).groupBy(*dims).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("total").alias("total")).where(F.col("n") >= min_n)
        return cells.select(*dims, (F.col("total").cast("double") / F.nullif(F.col("known"), F.lit(0))).alias(self.measure), "n", n_band(F.col("n")).alias("n_band"))

    def counts(self, *dims: str, since: str | None = None, until: str | None = None) -> DataFrame:
        """The further counts of each cell of these dimensions."""
        cells = self._read("cells", since, until)
        more = [c for c in cells.columns if c not in ("year_month", "known", "total", *self.dims)]
        return cells.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in more])

    def people(self, *base: str, since: str | None = None, until: str | None = None, exact: bool = True) -> DataFrame:
        """How many people answered, for each base of these dimensions: exactly, or by sketches (about 1 % off)."""
        rows = self._read("people", since, until)
        if not exact:
            return rows.groupBy(*base).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("people"))
        merged = rows.groupBy(*base, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("people"))
        return merged.groupBy(*base).agg(F.sum("people").alias("people"))
