"""Work lists hold whole texts."""

from pyspark.sql import functions as F

from tallyspark.operators import backlog


def test_long_texts_stay_whole(spark):
    text = "word " * 20_000 + "end"
    (row,) = spark.createDataFrame([(None, "s", text)], "a string, b string, c string").select(backlog.embedding_text(F.col("a"), F.col("b"), F.col("c")).alias("input")).collect()
    assert row.input == " | s | " + text


def test_a_later_result_counts_as_a_whole(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    results = spark.createDataFrame([(1, "p", "z", 5), (1, "q", "y", 5), (1, "zz", "zz", 4)], "k int, x string, y string, stamp int")
    found = backlog.updated(rows, results, "k", "x", "y", clock=F.lit("now")).orderBy("k").collect()
    assert [tuple(r) for r in found] == [(1, "q", "y", "now"), (2, "c", "d", None)]
