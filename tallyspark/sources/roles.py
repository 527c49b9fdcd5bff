"""Survey tables as roles over the given star schema, and the same roles in SQL.

Personal columns (names, coordinates, post codes) are not part of any role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Survey:
    """Lazy role tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def respondents(self) -> DataFrame:
        people = self.table("customer").join(self.nations(), F.col("c_nationkey") == F.col("n_nationkey"))
        key, balance = F.col("c_custkey"), F.col("c_acctbal")
        gender = F.when(key % 2 == 0, "Female").otherwise("Male")
        band = F.when(balance < 1500, "Under $35K").when(balance < 4500, "$35K-75K").when(balance < 7500, "$75K-125K").otherwise("Over $125K")
        return people.select(key.alias("respondent_id"), F.col("c_mktsegment").alias("generation"), gender.alias("gender"), band.alias("income_band"), "region", F.col("n_name").alias("state"), balance.alias("balance"))

    def nations(self) -> DataFrame:
        """Nations with their regions."""
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("region"))

    def items(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_type").alias("primary_topic"), F.col("p_brand").alias("canonical_brand"), F.split("p_name", " ").alias("subtags"), F.col("p_size").alias("size"))

    def _answers(self, rows: DataFrame, *more: Column) -> DataFrame:
        numeric = F.col("l_quantity").cast("int") % 9 - 3
        return rows.select(
            F.col("l_linenumber").alias("question_id"), F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("raw_value"),
            numeric.alias("numeric_value"), (numeric * 20).alias("joy_index"), (F.col("l_linestatus") == "F").alias("is_selected"), *more,
        )

    def answers(self) -> DataFrame:
        """Responses without respondent and month: one scan, no join."""
        return self._answers(self.table("lineitem"))

    def responses(self, since: Column | str | None = None, until: Column | str | None = None) -> DataFrame:
        """All responses, or those of days from ``since`` to before ``until``: a bound on the date is met by the scan, before the join."""
        day, asked = F.col("o_orderdate"), self.table("orders")
        asked = asked if since is None else asked.where(day >= (F.lit(since).cast("timestamp") if isinstance(since, str) else since))
        asked = asked if until is None else asked.where(day < (F.lit(until).cast("timestamp") if isinstance(until, str) else until))
        rows = self.table("lineitem").join(asked.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        return self._answers(rows, F.col("o_custkey").alias("respondent_id"), F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))

    def fieldings(self) -> DataFrame:
        """Months with the days and respondents that they cover."""
        month = F.date_format("o_orderdate", "yyyy-MM").alias("year_month")
        return self.table("orders").groupBy(month).agg(F.count_distinct("o_custkey").alias("n_respondents"), F.min("o_orderdate").alias("field_start"), F.max("o_orderdate").alias("field_end"))

    def usage(self) -> DataFrame:
        n = F.col("n")
        level = F.when(n >= 13, "Heavy").when(n >= 10, "Frequent").when(n >= 7, "Moderate").otherwise("Light")
        return self.table("orders").groupBy(F.col("o_custkey").alias("respondent_id")).agg(F.count("*").alias("n")).select("respondent_id", F.lit("orders").alias("category"), level.alias("usage_level"))

    def verbatims(self) -> DataFrame:
        labels = self.table("labels").select(F.col("doc_id").alias("label_id"), "quality", "toxic")
        texts = self.table("documents").join(labels, F.col("doc_id") == F.col("label_id"), "left")
        return texts.select("doc_id", F.col("doc_id").alias("respondent_id"), "text", F.col("lang").alias("category"), "source", (F.col("quality") == 1).alias("is_quotable"), (F.col("toxic") == 1).alias("is_toxic"))

    def dated_verbatims(self, since: str | None = None) -> DataFrame:
        """Texts with the month in which they were given (that of the order of the same number), of days from ``since`` on."""
        asked = self.table("orders").select("o_orderkey", "o_orderdate")
        asked = asked if since is None else asked.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp"))
        return self.verbatims().join(asked, F.col("doc_id") == F.col("o_orderkey")).withColumn("year_month", F.date_format("o_orderdate", "yyyy-MM")).drop("o_orderkey", "o_orderdate")

    def jobs(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", "event_id", "props", "value")


SQL = {
    "respondents": "SELECT c_custkey AS respondent_id, c_mktsegment AS generation, CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, CASE WHEN c_acctbal < 1500 THEN 'Under $35K' WHEN c_acctbal < 4500 THEN '$35K-75K' WHEN c_acctbal < 7500 THEN '$75K-125K' ELSE 'Over $125K' END AS income_band, r_name AS region, n_name AS state, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "items": "SELECT p_partkey AS item_id, p_name AS item_name, p_type AS primary_topic, p_brand AS canonical_brand, string_split(p_name, ' ') AS subtags, p_size AS size FROM part",
    "responses": "SELECT o_custkey AS respondent_id, l_linenumber AS question_id, l_partkey AS item_id, l_returnflag AS raw_value, CAST(l_quantity AS INT) % 9 - 3 AS numeric_value, (CAST(l_quantity AS INT) % 9 - 3) * 20 AS joy_index, l_linestatus = 'F' AS is_selected, strftime(o_orderdate, '%Y-%m') AS year_month FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "answers": "SELECT l_linenumber AS question_id, l_partkey AS item_id, l_returnflag AS raw_value, CAST(l_quantity AS INT) % 9 - 3 AS numeric_value, (CAST(l_quantity AS INT) % 9 - 3) * 20 AS joy_index, l_linestatus = 'F' AS is_selected FROM lineitem",
    "fieldings": "SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(DISTINCT o_custkey) AS n_respondents, min(o_orderdate) AS field_start, max(o_orderdate) AS field_end FROM orders GROUP BY 1",
    "usage": "SELECT o_custkey AS respondent_id, 'orders' AS category, CASE WHEN count(*) >= 13 THEN 'Heavy' WHEN count(*) >= 10 THEN 'Frequent' WHEN count(*) >= 7 THEN 'Moderate' ELSE 'Light' END AS usage_level FROM orders GROUP BY 1",
    "verbatims": "SELECT d.doc_id, d.doc_id AS respondent_id, d.text, d.lang AS category, d.source, quality = 1 AS is_quotable, toxic = 1 AS is_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "jobs": "SELECT user_id AS job_id, event_type AS status, ts, event_id, props, value FROM events",
}


def with_roles(sql: str, *roles: str) -> str:
    """The SQL with the named roles as common table expressions."""
    return "WITH " + ", ".join(f"{r} AS ({SQL[r]})" for r in roles) + " " + sql
