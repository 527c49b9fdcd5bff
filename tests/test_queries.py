"""Every named query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyspark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalogue.SQL[name])
    names = sorted(frame.columns)
    assert names == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    at = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_answers_are_counted_before_they_meet_the_scale(spark):
    """What is joined with the scale, whose few labels would be as many tasks, is a row for each label."""
    from tallyspark.operators import metrics

    rows = spark.createDataFrame([(1, "A"), (1, "A"), (1, "R"), (1, "?"), (2, "N"), (None, "R")], "question_id int, raw_value string")
    found = metrics.top2_box(rows, catalogue.scale(spark), "returns", "question_id")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 3, 200 / 3), (2, 1, 100.0), (None, 1, 0.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]
    assert metrics.top2_box(rows.limit(0), catalogue.scale(spark), "returns").collect() == [(0, None)]
