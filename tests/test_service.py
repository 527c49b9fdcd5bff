"""The guard, the limits, the job log and the backlog."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark import schema
from tallyspark.operators import ranking, retrieval
from tallyspark.plans import jobs, service
from tallyspark.streaming import backlog


@pytest.mark.parametrize("sql", ["SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SELECT 'please update me' AS x;", "SELECT 1 UNION SELECT 2", "SELECT * FROM (VALUES (1)) AS t(x) WHERE x IN (SELECT 1)"])
def test_reads(spark, sql):
    assert service.run(spark, sql).error is None


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO t SELECT 1", "CREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", "SET x = 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SHOW TABLES", "", "SELEC 1", "SELECT * FROM text.`/etc/hostname`", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT 1 WHERE EXISTS (SELECT * FROM csv.`/etc/passwd`)", "SELECT (SELECT java_method('java.lang.System', 'nanoTime')) AS x", "SELECT input_file_name()", "SELECT * FROM nowhere", "WITH a AS (SELECT * FROM json.`/tmp/x`) SELECT * FROM a"])
def test_refuses(spark, sql):
    assert service.run(spark, sql).error


def test_reads_views_by_name(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert service.run(spark, "SELECT sum(id) AS s, upper('x') AS u FROM three t JOIN (SELECT explode(array(1, 2)) AS e) ON true").error is None


def test_payload_is_json():
    step = service.Step("q", "r", ['{"x": "' + "y" * 1000 + '"}'] * 100, 100)
    text = step.payload()
    found = json.loads(text)
    assert len(text) <= service.PAYLOAD_CHARS and 40 < len(found["result"]) < 100 and found["left_out"] == 100 - len(found["result"])


def test_limits(spark):
    assert service.run(spark, "SELECT * FROM range(10000)").rowcount == 50
    assert service.run(spark, "SELECT * FROM range(10000)", rows=9999).rowcount == 500
    slow = service.run(spark, "SELECT count(*) FROM range(3000000) a JOIN range(300000) b ON a.id + b.id > 1", timeout_s=2)
    assert slow.error.startswith("timeout")


def test_limits_of_depth():
    assert [jobs.turns(d) for d in ("none", "minimal", None, "odd")] == [0, 4, 10, 10]


def test_log_rows_that_took_effect(spark):
    rows = [("a", 1, "pending", None), ("a", 2, "pending", None), ("a", 3, "complete", "running"), ("a", 4, "running", "pending"), ("a", 5, "error", "pending"), ("a", 6, "complete", "running"), ("a", 7, "error", "running"), ("b", 1, "running", "pending"), ("c", 1, "pending", None), ("c", 2, "error", "pending"), ("c", 3, "running", "pending")]
    log = spark.createDataFrame([(j, t, t, st, e) for j, t, st, e in rows], "job_id string, ts int, event_id int, status string, expected string")
    assert sorted((r.job_id, r.ts, r.status) for r in jobs.effective(log).collect()) == [("a", 1, "pending"), ("a", 4, "running"), ("a", 6, "complete"), ("c", 1, "pending"), ("c", 2, "error")]


def test_status_domain(spark):
    rows = spark.createDataFrame([("pending",), ("lost",)], "status string")
    with pytest.raises(Exception, match="not allowed"):
        schema.checked(rows, "status", schema.STATUSES).collect()
    assert schema.commented(schema.JOBS, status="where it is")["status"].metadata == {"comment": "where it is"}


def test_retrieval(spark):
    assert retrieval.parse_terms("red small OR blue") == [["red", "small"], ["blue"]]
    rows = spark.createDataFrame([("Studies studied",), ("study",), ("sturdy",)], "t string")
    assert [r[0] for r in rows.select(F.col("t").rlike(retrieval.inflections("study"))).collect()] == [True, True, False]
    forms = {"run": ("ran", "running", "runner"), "buy": ("bought", "purchase", "buyer"), "stop": ("stopped", "stopping", "stopover"), "visit": ("visited", "visits", "visitation"), "play": ("played", "plays", "playful")}
    for stem, (one, two, other) in forms.items():
        found = spark.createDataFrame([(one,), (two,), (other,)], "t string").select(F.col("t").rlike(retrieval.inflections(stem))).collect()
        assert [r[0] for r in found] == [True, True, False], stem
    nulls = spark.createDataFrame([(["a", None],), (None,), ([],)], "t array<string>")
    got = nulls.select(retrieval.overlaps(F.col("t"), ["b"]), retrieval.holds(F.col("t"), "b"), retrieval.holds_all(F.col("t"), ["a"]), retrieval.array_length(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(False, False, True, 2), (False, False, False, None), (False, False, False, None)]


def test_cases(spark):
    rows = spark.createDataFrame([("Conversion and CAC",), ("brand identity, budget cut",), ("a quiet year",), (None,)], "t string")
    assert [r[0] for r in rows.select(ranking.context_kind(F.col("t"))).collect()] == ["performance", "mixed", "brand", "brand"]


def test_tagging(spark):
    rows = spark.createDataFrame([(i, f"joy {i}", "home") for i in range(90)], "id int, t string, topic string")

    def broken(text: pd.Series) -> pd.DataFrame:
        raise RuntimeError("busy")

    assert backlog.tagged(rows, "id", "t").where("primary_topic = 'joy' and error is null").count() == 90
    assert backlog.tagged(rows, "id", "t", broken).where("error = 'busy' and error_kind = 'failed' and primary_topic = 'general'").count() == 90

    def limited(text: pd.Series) -> pd.DataFrame:
        raise RuntimeError("answer 429: slow down")

    assert backlog.tagged(rows, "id", "t", limited, parent="topic").where("error_kind = 'rate_limit' and primary_topic = 'home'").count() == 90


def test_word_tagger():
    tag = backlog.word_tagger({"drink": ["Wine", "root beer"], "food": ["beer", "ham"], "empty": []})
    got = tag(pd.Series(["WINE and wine, ham", "root beer", "ham-wine", "swine hamper", "", None]))
    assert list(zip(got.primary_topic, got.confidence)) == [("drink", 2 / 3), ("drink", 0.5), ("drink", 0.5), ("general", 0.0), ("general", 0.0), ("general", 0.0)]
    assert list(backlog.word_tagger({})(pd.Series(["wine"])).primary_topic) == ["general"]


def test_drain(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "id long, t string")
    for turn in range(2):
        rows.withColumn("id", F.col("id") + 10 * turn).write.mode("append").parquet(str(tmp_path / "in"))
        backlog.drain(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "state"), "id", "t").awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 10 * (turn + 1)


def test_activity(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2026-01-01 00:50:00', 'a', 2.0D UNION ALL SELECT timestamp'2026-01-01 01:10:00', 'b', 4.0D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = backlog.activity(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("activity").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


@pytest.mark.parametrize("sql", ["SELECT * FROM a.b.c", "SELECT * FROM a.b.c.d", "SELECT * FROM nowhere.t", "SELECT repeat('x', 2000000000)", "SELECT lpad('x', 2000000000, 'y')", "SELECT size(sequence(1, 1000000000))", "SELECT rpad('x', 2000000000)", "SELECT * FROM sequence(1, 5)"])
def test_refused_in_the_step(spark, sql):
    """Names of catalogues that there aren't, and values that the planner itself would blow up."""
    step = service.run(spark, sql)
    assert step.error and step.error.startswith("refused") and step.rowcount == 0


def test_tags_are_dealt_to_all_cores(spark):
    """Rows of one small file are tagged by many tasks, each batch of one still on its own."""
    rows = spark.range(300).selectExpr("id", "if(id % 3 = 0, 'a joy', 'none') AS t").coalesce(1)

    def fussy(text):
        assert len(text) == 1
        if "joy" in text.iloc[0]:
            raise TimeoutError("answer 429")
        return backlog.keyword_tagger(text)

    found = backlog.tagged(rows, "id", "t", fussy, size=1)
    assert found.rdd.getNumPartitions() > 1
    assert found.groupBy("error_kind").count().orderBy("error_kind").collect() == [(None, 200), ("rate_limit", 100)]
    assert found.where("error_kind is null and primary_topic <> 'general'").count() == 0
