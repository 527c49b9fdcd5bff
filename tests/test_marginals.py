"""Marginals against the facts, after each load."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import metrics
from tallyspark.operators.marginals import Marginals
from tallyspark.sources.versions import new_folder


def facts(spark, months, seed):
    draw = random.Random(seed)
    rows = [(m, draw.randrange(300), draw.randrange(4), draw.choice(["x", "y", None]), draw.choice(["f", "m"]), draw.choice([None, *range(-60, 101, 20)]), draw.random() < 0.3) for m in months for _ in range(400)]
    return spark.createDataFrame(rows, "year_month string, respondent_id long, question_id int, topic string, gender string, joy_index int, chosen boolean")


def same(got, want):
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


@pytest.fixture
def marginals(spark):
    return Marginals(spark, new_folder(spark), ["question_id", "topic", "gender"], ["question_id"])


def test_after_each_load(spark, marginals, capsys):
    """Cells, further counts and people are those of the facts, also after a month was replaced."""
    held = {}
    for months, seed in ((["2026-01", "2026-02"], 1), (["2026-03"], 2), (["2026-02", "2026-04"], 3)):
        part = facts(spark, months, seed).cache()
        held |= {m: part.where(F.col("year_month") == m) for m in months}
        marginals.load(part, chosen=F.col("chosen"))
        whole = None
        for frame in held.values():
            whole = frame if whole is None else whole.unionByName(frame)
        for dims in (("topic",), ("gender", "question_id"), ("year_month", "topic")):
            same(marginals.crosstab(*dims, min_n=30).drop("n_band"), metrics.joy_crosstab(whole, *dims, min_n=30))
        same(marginals.counts("gender").select("gender", "chosen"), whole.groupBy("gender").agg(F.count_if("chosen").alias("chosen")))
        same(marginals.people("question_id"), whole.groupBy("question_id").agg(F.count_distinct("respondent_id").alias("people")))
        late = whole.where("year_month >= '2026-02'")
        same(marginals.people("question_id", since="2026-02"), late.groupBy("question_id").agg(F.count_distinct("respondent_id").alias("people")))
        same(marginals.crosstab("topic", min_n=1, since="2026-02", until="2026-02").drop("n_band"), metrics.joy_crosstab(whole.where("year_month = '2026-02'"), "topic", min_n=1))
    assert marginals.months() == ["2026-01", "2026-02", "2026-03", "2026-04"]
    marginals.crosstab("topic").explain()
    plan = capsys.readouterr().out
    assert "FileScan parquet" in plan and "Scan ExistingRDD" not in plan and "InMemory" not in plan.replace("InMemoryFileIndex", "")


def test_sketches(spark, marginals):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "2026-01").otherwise("2026-02").alias("year_month"), (F.col("id") % 15_000).alias("respondent_id"), F.lit(1).alias("question_id"), F.lit("x").alias("topic"), F.lit("f").alias("gender"), F.lit(20).alias("joy_index"))
    marginals.load(rows)
    assert marginals.people("question_id").first().people == 15_000
    assert abs(marginals.people("question_id", exact=False).first().people - 15_000) < 750


def test_nulls_and_nothing(spark, marginals):
    with pytest.raises(ValueError):
        marginals.crosstab("topic")
    rows = facts(spark, ["2026-01"], 1)
    marginals.load(rows.withColumn("year_month", F.lit(None).cast("string")))
    assert marginals.crosstab("topic").collect() == [] and marginals.people("question_id").collect() == []
    marginals.load(rows.limit(5).withColumns({"respondent_id": F.lit(None).cast("long"), "joy_index": F.lit(None).cast("int")}))
    assert [tuple(r) for r in marginals.crosstab(min_n=1).collect()] == [(None, 5, "suppress")] and marginals.people("question_id").collect() == []
    assert marginals.crosstab("topic", since="2027-01").collect() == []


def test_ids_are_shuffled_and_not_bitmaps(spark, marginals):
    """Bitmaps are made after the one exchange, where all ids of a group are; ids of several buckets are counted as they are."""
    rows = spark.range(4000).selectExpr("id * 97 % 70000 AS respondent_id", "concat('2024-0', id % 3 + 1) AS year_month", "cast(id % 2 AS int) AS question_id", "'x' AS topic", "'f' AS gender", "1 AS joy_index")
    marginals.load(rows)
    same(marginals.people("question_id"), rows.groupBy("question_id").agg(F.count_distinct("respondent_id").alias("people")))
    plan = marginals._people(rows)._jdf.queryExecution().sparkPlan().toString()
    made = marginals._people(rows)._jdf.queryExecution().executedPlan().toString()
    assert made.count("Exchange") == 1 and "bitmap_construct_agg" not in made[made.index("Exchange") :].split("\n\n")[0], plan
