"""Queries that write given tables in one of the forms the library takes in or gives out, and read them back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schema
from tallyspark.operators import backlog, ingest
from tallyspark.plans.ingestion import FIELDS, KINDS, SHEET_SQL
from tallyspark.plans.registry import query
from tallyspark.sources import files
from tallyspark.sources.roles import Survey
from tallyspark.sources.versions import new_folder
from tallyspark.streaming.backlog import tagged, word_tagger


#: Rows of a file of a sheet at most.
SHEET_ROWS = 250_000


@query(
    "landed_sheet",
    f"""WITH sheet AS ({SHEET_SQL}) SELECT respondent_id, 1 AS question_id, a AS raw_value FROM sheet
    UNION ALL SELECT respondent_id, 2, b FROM sheet WHERE trim(b) <> '' UNION ALL SELECT respondent_id, 3, c FROM sheet WHERE c IS NOT NULL""",
)
def landed_sheet(s: Survey) -> DataFrame:
    """A sheet of strings as CSV in files of a bounded number of rows, landed with ordinals, its columns mapped by a JSON file, as long answers."""
    key, path = F.col("o_orderkey"), new_folder(s.spark)
    texts = [F.lit("id"), F.lit("x").alias("c1"), F.date_format("o_orderdate", "yyyy-MM-dd"), (key % 6).cast("string"), F.when(key % 3 == 0, F.col("o_orderstatus")).otherwise(" "), F.when(key % 7 == 0, F.col("o_orderpriority")), F.lit('a "quoted", cell\nof two lines')]
    s.table("orders").orderBy(key).select(*[t.alias(f"x{i}") for i, t in enumerate(texts)]).write.option("quoteAll", True).option("escape", '"').option("maxRecordsPerFile", SHEET_ROWS).csv(f"{path}/sheet")
    landed = files.land_sheet(s.spark, f"{path}/sheet", f"{path}/landed")
    fields = [(f"c{3 + i}", question, item) for i, (_, question, item) in enumerate(FIELDS)]
    entries = ", ".join(f'"{f}": {{"question_id": {q}, "item_id": {i}}}' for f, q, i in fields)
    s.spark.createDataFrame([("{" + entries + "}",)], "value string").coalesce(1).write.text(f"{path}/map")
    column_map = files.json_map(s.spark, f"{path}/map", "field", "struct<question_id:int,item_id:int>")
    s.spark.createDataFrame([("{" + ", ".join(f'"{q}": "{k}"' for q, k in KINDS) + "}",)], "value string").coalesce(1).write.text(f"{path}/kinds")
    kinds = files.json_map(s.spark, f"{path}/kinds", "question", "string").select(F.col("question").cast("int").alias("question_id"), F.col("v").alias("question_type"))
    rows = ingest.with_ids(ingest.wave(landed, "1995-03", ingest.Layout()), 100)
    return ingest.answers(rows, column_map, kinds, [f for f, _, _ in fields], "1995-03").select("respondent_id", "question_id", "raw_value")


@query("contacts_file", "SELECT name, company, context FROM (SELECT 'O\"' || c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS company, CASE WHEN c_custkey % 2 = 0 THEN 'one, \"two\" | ' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS context FROM customer)")
def contacts_file(s: Survey) -> DataFrame:
    """A contact list as CSV with all fields quoted and quotes doubled, bound by its headers."""
    key, path = F.col("c_custkey"), new_folder(s.spark)
    rows = s.table("customer").select(F.concat(F.lit('O"'), "c_name").alias("Full Name"), F.when(key % 3 > 0, F.col("c_mktsegment")).alias("Organisation"), F.when(key % 2 == 0, 'one, "two"').alias("Industries"), key.cast("string").alias("Notes"))
    files.write_csv(rows, path)
    return files.contacts(files.read_contacts(s.spark, path)).select("name", "company", "context")


@query("chunked_sink", "SELECT count(*) AS n, sum(p_partkey)::BIGINT AS total, 700 AS most FROM part")
def chunked_sink(s: Survey) -> DataFrame:
    """Rows written in files of 700 at most: how many rows come back, and how many the largest file may have."""
    path = new_folder(s.spark)
    files.write_chunks(s.table("part"), path, 700)
    per_file = s.spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("total"))
    return per_file.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.greatest(F.max("n"), F.lit(700)).cast("int").alias("most"))


@query("schema_versions", "SELECT p_partkey AS item_id, CASE WHEN p_size > 25 THEN p_name END AS short_label, NULL::VARCHAR AS intent_tag FROM part")
def schema_versions(s: Survey) -> DataFrame:
    """Files of a version without a column, of one with it, and a column that no file has."""
    path, parts = new_folder(s.spark), s.table("part")
    parts.where("p_size <= 25").select(F.col("p_partkey").alias("item_id")).write.parquet(f"{path}/version=1")
    parts.where("p_size > 25").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("short_label")).write.parquet(f"{path}/version=2")
    wanted = T.StructType().add("item_id", T.LongType()).add("short_label", T.StringType()).add("intent_tag", T.StringType())
    return schema.read_all_versions(s.spark, path, wanted)


@query("status_domain", "SELECT status, count(*) AS n, max(comment) AS comment FROM (SELECT CASE event_type WHEN 'view' THEN 'pending' WHEN 'error' THEN 'error' ELSE 'complete' END AS status, 'one of five' AS comment FROM events) GROUP BY 1")
def status_domain(s: Survey) -> DataFrame:
    """Statuses that were checked on the way out, with the comment that their column keeps in the file."""
    path = new_folder(s.spark)
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "error").otherwise("complete")
    rows = schema.checked(s.table("events").select(status.alias("status")), "status", schema.STATUSES)
    commented = schema.commented(rows.schema, status="one of five")
    rows.select(F.col("status").alias("status", metadata=commented["status"].metadata)).write.parquet(path)
    back = s.spark.read.parquet(path)
    return back.groupBy("status").agg(F.count("*").alias("n")).withColumn("comment", F.lit(back.schema["status"].metadata.get("comment")))


@query("months_replaced", "SELECT year_month, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (SELECT strftime(o_orderdate, '%Y-%m') AS year_month, CASE WHEN month(o_orderdate) = 3 THEN 2 ELSE 1 END AS value FROM orders) GROUP BY 1")
def months_replaced(s: Survey) -> DataFrame:
    """A load of all months, a second one of some of them in their place, and that once more."""
    path = new_folder(s.spark)
    rows = s.table("orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"), F.lit(1).alias("value"))
    ingest.write_month(rows, path)
    for _ in range(2):
        ingest.write_month(rows.where("substring(year_month, 6) = '03'").withColumn("value", F.lit(2)), path)
    return s.spark.read.parquet(path).groupBy(F.col("year_month").cast("string").alias("year_month")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("guarded_catalogue", "SELECT p_partkey AS item_id, p_name AS item_name FROM part WHERE p_partkey > (SELECT max(p_partkey) // 2 FROM part)")
def guarded_catalogue(s: Survey) -> DataFrame:
    """A part of the catalogue, loaded as it was prepared for the last id and the number of rows there are; a repeat of the load is refused."""
    items = s.items().select("item_id", "item_name")
    half = items.agg((F.max("item_id") / 2).cast("long").alias("half")).first()["half"]
    old, new, path = items.where(F.col("item_id") <= half), items.where(F.col("item_id") > half), new_folder(s.spark)
    ingest.guarded_load(new, path, old, half, new.count())
    try:
        ingest.guarded_load(new, path, old, half, new.count())
    except ValueError:
        return s.spark.read.parquet(path)
    raise AssertionError("a load was repeated")


@query("stamped_update", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'new' ELSE primary_topic END AS primary_topic, CASE WHEN item_id % 3 = 0 THEN '2026-04-01 12:00:00' END AS updated_at FROM items", "items")
def stamped_update(s: Survey) -> DataFrame:
    """Rows with the time at which they got a value, by a given clock."""
    results = s.items().where("item_id % 3 = 0").select("item_id", F.lit("new").alias("primary_topic"), F.lit(1).alias("stamp"))
    clock = F.to_timestamp(F.lit("2026-04-01 12:00:00"))
    out = backlog.updated(s.items().select("item_id", "primary_topic"), results, "item_id", "primary_topic", clock=clock)
    return out.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


def length_tagger(text: pd.Series) -> pd.DataFrame:
    """A tagger that fails for batches with a very long text, as one behind a service may."""
    sizes = [len(t or "") for t in text]
    if max(sizes, default=0) > 11:
        raise TimeoutError("answer 429")
    return pd.DataFrame({"primary_topic": pd.Series(["short" if n < 9 else "long" for n in sizes], dtype=object), "confidence": [n / 100.0 for n in sizes]})


@query("tagged_items", "SELECT item_id, CASE WHEN length(item_name) > 11 THEN primary_topic WHEN length(item_name) < 9 THEN 'short' ELSE 'long' END AS primary_topic, CASE WHEN length(item_name) > 11 THEN 'rate_limit' END AS error_kind FROM items", "items")
def tagged_items(s: Survey) -> DataFrame:
    """Tags of all items, one in a batch; items whose batch failed have their parent topic and the kind of error."""
    rows = s.items().select("item_id", "item_name", F.col("primary_topic").alias("parent"))
    return tagged(rows, "item_id", "item_name", length_tagger, size=1, parent="parent").select("item_id", "primary_topic", "error_kind")


TOPICS = {"colour": ["Red", "blue", "green"], "size": ["small", "large"], "part": ["bolt", "ring", "gear", "small ring"], "none": ["nothing at all"]}


@query(
    "tagged_by_words",
    """SELECT item_id, CASE WHEN total = 0 THEN 'general' WHEN c >= s AND c >= p THEN 'colour' WHEN s >= p THEN 'size' ELSE 'part' END AS primary_topic, CASE WHEN total = 0 THEN 0 ELSE greatest(c, s, p)::DOUBLE / total END AS confidence
    FROM (SELECT *, c + s + p AS total FROM (SELECT item_id, len(list_filter(w, lambda x: x IN ('red', 'blue', 'green'))) AS c, len(list_filter(w, lambda x: x IN ('small', 'large'))) AS s,
    len(list_filter(w, lambda x: x IN ('bolt', 'ring', 'gear'))) + CASE WHEN item_name = 'small ring' THEN 1 ELSE 0 END AS p FROM (SELECT *, string_split(item_name, ' ') AS w FROM items)))""",
    "items",
)
def tagged_by_words(s: Survey) -> DataFrame:
    """Items tagged by a vocabulary of topics."""
    return tagged(s.items(), "item_id", "item_name", word_tagger(TOPICS)).select("item_id", "primary_topic", "confidence")
