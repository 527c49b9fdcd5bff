"""Queries over what the query service says and hears: briefs, follow-ups, outcomes, and events by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.plans import jobs, service
from tallyspark.plans.ingestion import picked
from tallyspark.plans.registry import query
from tallyspark.sources.roles import Survey
from tallyspark.streaming import backlog

DEPTHS = ["none", "minimal", "focused", "thorough"]


@query(
    "triage_briefs",
    """SELECT item_id, CASE WHEN read THEN question ELSE 'asked ' || item_name END AS question, CASE WHEN read AND item_id % 3 > 0 THEN (['none', 'minimal', 'focused', 'thorough'])[1 + size % 4] ELSE 'focused' END AS depth, CASE WHEN read AND size % 3 = 0 THEN 'long' ELSE 'medium' END AS length,
    CASE WHEN read THEN CASE WHEN size % 5 = 0 THEN primary_topic END ELSE 'Triage JSON parse failed. Apply default focused investigation.' END AS brief, CAST(CASE WHEN read THEN len(subtags) ELSE 0 END AS INTEGER) AS seeds, read AND size % 7 = 0 AS leaves
    FROM (SELECT *, item_id % 4 < 3 AS read, 'what of "' || item_name || '"?' AS question FROM items)""",
    "items",
)
def triage_briefs(s: Survey) -> DataFrame:
    """Briefs as JSON of each row's own values, plain, fenced, with fields left out, and cut off in the middle."""
    size, key = F.col("size"), F.col("item_id")
    fields = F.struct(
        F.concat(F.lit('what of "'), "item_name", F.lit('"?')).alias("the_question"), F.when(key % 3 > 0, F.get(F.array(*map(F.lit, DEPTHS)), (size % 4).cast("int"))).alias("investigation_depth"), F.when(size % 3 == 0, "long").alias("response_length"),
        F.when(size % 5 == 0, F.col("primary_topic")).alias("investigator_brief"), F.col("subtags").alias("followup_seeds"), F.when(size % 7 == 0, True).alias("early_exit"),
    )
    text = F.to_json(fields)
    text = F.when(key % 4 == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(key % 4 == 3, F.substr(text, F.lit(1), F.length(text) - 5)).otherwise(text)
    briefs = s.items().select("item_id", jobs.brief(text, F.concat(F.lit("asked "), "item_name")).alias("b"))
    return briefs.select("item_id", F.col("b.the_question").alias("question"), F.col("b.investigation_depth").alias("depth"), F.col("b.response_length").alias("length"), F.col("b.investigator_brief").alias("brief"), F.size("b.followup_seeds").alias("seeds"), F.col("b.early_exit").alias("leaves"))


ANSWER_SQL = r"""substr(coalesce(text, ''), 1, 400) || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN E'\nwhere to Go next\n' ELSE E'\n**WHERE TO GO NEXT**\n' END || '1. [' || substr(coalesce(text, ''), 20, 30) || E']\n2. ' || substr(coalesce(text, ''), 60, doc_id % 23) || E'\n 3. '
    || substr(coalesce(text, ''), 90, 25) || E'\n4) ' || substr(coalesce(text, ''), 120, 30) || E'\nWHERE TO GO NEXT\n55.  ' || substr(coalesce(text, ''), 150, 40) || E'  \n6.[' || substr(coalesce(text, ''), 200, 20) || ']'"""
FOLLOWUP_SQL = rf"""WITH said AS (SELECT doc_id, replace({ANSWER_SQL}, chr(13), '') AS answer FROM documents),
    lines AS (SELECT doc_id, list_filter(string_split(regexp_extract(answer, '(?is)where to go next.*'), chr(10)), lambda x: regexp_matches(x, '^\s*[0-9]+\.')) AS found FROM said),
    bare AS (SELECT doc_id, list_transform(found, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[0-9]+\.\s*', ''), '^\[', ''), '\]$', '')) AS found FROM lines),
    plain AS (SELECT doc_id, list_filter(list_transform(found, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: length(x) > 15) AS found FROM bare)
    SELECT doc_id, array_to_string(list_slice(found, 1, 3), '|') AS lines FROM plain"""


@query("followup_lines", FOLLOWUP_SQL)
def followup_lines(s: Survey) -> DataFrame:
    """Lines that an answer proposes, of answers that are made of the given texts."""
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id")
    cut = lambda at, n: F.substr(text, F.lit(at), n if isinstance(n, Column) else F.lit(n))
    marker = F.when(key % 4 == 0, "").when(key % 4 == 1, "\nwhere to Go next\n").otherwise("\n**WHERE TO GO NEXT**\n")
    answer = F.concat(
        cut(1, 400), marker, F.lit("1. ["), cut(20, 30), F.lit("]\n2. "), cut(60, (key % 23).cast("int")), F.lit("\n 3. "), cut(90, 25), F.lit("\n4) "), cut(120, 30), F.lit("\nWHERE TO GO NEXT\n55.  "), cut(150, 40), F.lit("  \n6.["), cut(200, 20), F.lit("]"),
    )
    return s.table("documents").select("doc_id", F.array_join(jobs.followups(F.replace(answer, F.lit("\r"), F.lit(""))), "|").alias("lines"))


def asked_of_service(s: Survey, *statements: str, rows: int = service.DEFAULT_ROWS) -> list[service.Step]:
    """Steps of the read-only service over views of the tables."""
    for name in ("orders", "customer"):
        s.table(name).createOrReplaceTempView(f"service_{name}")
    return [service.run(s.spark, sql, "why", rows, timeout_s=60) for sql in statements]


@query("service_rows", "SELECT o_orderkey, o_orderpriority, count(*) OVER () AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500)")
def service_rows(s: Survey) -> DataFrame:
    """What a statement gives through the service, which was asked for more rows than it ever gives."""
    (step,) = asked_of_service(s, "SELECT o_orderkey, o_orderpriority FROM service_orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey;", rows=10_000)
    found = s.spark.createDataFrame([(r,) for r in step.result], "row string").select(F.from_json("row", "o_orderkey long, o_orderpriority string").alias("r"))
    return found.select("r.o_orderkey", "r.o_orderpriority", F.lit(step.rowcount).cast("long").alias("n"))


@query(
    "service_scratch",
    """SELECT 0 AS step, (SELECT least(count(*), 50) FROM customer) AS rows, false AS refused, NULL AS least UNION ALL SELECT 1, 1, false, (SELECT CAST(min(c_custkey) AS VARCHAR) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
    UNION ALL SELECT step, 0, true, NULL FROM (VALUES (2), (3), (4), (5)) AS v(step)""",
)
def service_scratch(s: Survey) -> DataFrame:
    """The record of an investigation: what each statement gave, or that it was refused; a word that only a text holds is no reason to."""
    steps = asked_of_service(
        s, "SELECT c_name, 'please update or drop' AS said FROM service_customer", "WITH o AS (SELECT DISTINCT o_custkey FROM service_orders) SELECT min(c_custkey) AS least FROM service_customer JOIN o ON o_custkey = c_custkey",
        "DELETE FROM service_orders", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/tmp`", "WITH x AS (SELECT 1) INSERT INTO service_orders SELECT * FROM x",
    )
    rows = [(i, step.rowcount, bool(step.error and step.error.startswith("refused")), step.result[0] if i == 1 and step.result else None) for i, step in enumerate(steps)]
    record = s.spark.createDataFrame(rows, "step int, rows long, refused boolean, first string")
    return record.select("step", "rows", "refused", F.get_json_object("first", "$.least").alias("least"))


@query("service_payload", "SELECT 50000 AS most, true AS fits, (SELECT count(*) FROM (SELECT 1 FROM documents LIMIT 500)) AS given, true AS whole")
def service_payload(s: Survey) -> DataFrame:
    """A step's record as JSON: never more than its limit, whole rows from the first on, and how many are left out."""
    s.table("documents").createOrReplaceTempView("service_documents")
    step = service.run(s.spark, "SELECT doc_id, text FROM service_documents ORDER BY doc_id", rows=500, timeout_s=60)
    payload = s.spark.createDataFrame([(step.payload(),)], "payload string")
    parsed = payload.select(F.length("payload").alias("size"), F.from_json("payload", "result array<string>, left_out int, rowcount long").alias("p"))
    given = F.size("p.result") + F.col("p.left_out")
    return parsed.select(F.lit(service.PAYLOAD_CHARS).alias("most"), (F.col("size") <= service.PAYLOAD_CHARS).alias("fits"), given.cast("long").alias("given"), (given == F.col("p.rowcount")).alias("whole"))


PREVIEWS = ["<title>Password Protection</title>", "no"]


@query(
    "dispatch_outcomes",
    """SELECT CASE WHEN size % 7 = 0 THEN 'threw' WHEN status = 401 AND item_id % 2 = 0 THEN 'password_gate' WHEN status IN (401, 403) THEN 'denied' WHEN status < 200 OR status > 299 THEN 'refused' ELSE 'accepted' END AS outcome, count(*) AS n
    FROM (SELECT *, [202, 401, 403, 500, NULL, 302, 199][1 + item_id % 7] AS status FROM items) GROUP BY 1""",
    "items",
)
def dispatch_outcomes(s: Survey) -> DataFrame:
    status = F.get(F.array(*[F.lit(x).cast("int") for x in (202, 401, 403, 500, None, 302, 199)]), (F.col("item_id") % 7).cast("int"))
    outcome = jobs.dispatch_outcome(F.col("size") % 7 == 0, status, picked(F.col("item_id"), PREVIEWS))
    return s.items().groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("activity_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def activity_windows(s: Survey) -> DataFrame:
    return backlog.activity(s.table("events"))
