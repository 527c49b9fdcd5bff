"""Runs read-only SQL with a row cap, a time limit and a record of each step."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import asdict, dataclass

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession

from tallyspark.plans import functions as retrieval

DEFAULT_ROWS, MOST_ROWS, PAYLOAD_CHARS, TIMEOUT_S = 50, 500, 50_000, 5.0

# Plan nodes that only read.
READING = {
    "Project", "Filter", "Join", "Aggregate", "Sort", "Distinct", "Union", "Except", "Intersect", "GlobalLimit", "LocalLimit", "Offset", "OneRowRelation", "LocalRelation", "SubqueryAlias",
    "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "UnresolvedWith", "UnresolvedTableValuedFunction", "Generate", "Window", "WithWindowDefinition", "LateralJoin", "Pivot", "Unpivot", "Expand", "Sample", "Range", "UnresolvedHint", "Tail",
}


# Functions that a statement may call, besides those for retrieval. All others are refused, those that reach
# outside of the data (reflect, java_method, input_file_name, ...) among them, and those that make values of any
# size from a few characters (repeat, lpad, sequence, ...), which the planner would do before a time limit can end it.
FUNCTIONS = set(
    "abs acos add_months any_value approx_count_distinct array array_agg array_append array_compact array_contains array_distinct array_except array_intersect array_join array_max array_min "
    "array_position array_remove array_size array_sort array_union arrays_overlap arrays_zip asin atan avg bool_and bool_or cardinality case ceil ceiling char_length coalesce collect_list "
    "collect_set concat concat_ws contains corr cos count count_if cume_dist current_date current_timestamp date_add date_diff date_format date_sub date_trunc datediff day dayofweek "
    "dense_rank element_at endswith every exists exp explode explode_outer extract filter first first_value flatten floor format_number from_json get get_json_object greatest hash hour if "
    "ifnull ilike initcap inline instr isnan isnotnull isnull json_tuple lag last last_value lcase lead least left len length levenshtein like listagg ln locate log log10 log2 lower "
    "ltrim map map_keys map_values max max_by md5 mean median min min_by minute mod mode month months_between named_struct ntile nullif nvl nvl2 percent_rank percentile "
    "percentile_approx pmod posexplode pow power quarter range rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regexp_substr replace reverse right "
    "rlike round row_number rtrim second shuffle sign sin size slice some sort_array split split_part sqrt stack startswith std stddev stddev_pop stddev_samp string_agg "
    "strpos struct substr substring substring_index sum tan to_char to_date to_json to_timestamp transform translate trim trunc try_cast try_divide try_element_at ucase unnest upper "
    "var_pop var_samp variance weekofyear when width_bucket xxhash64 year zip_with aggregate reduce".split()
)


class NotReadOnly(ValueError):
    pass


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def parsed(spark: SparkSession, sql: str) -> tuple[set[str], list[list[str]], set[str], set[str]]:
    """Of a statement, inside WITH and subqueries too: the names of its plan nodes, its relations, its
    functions, and the names that its WITH parts define. The one place that needs the classic session's JVM handle."""
    nodes, relations, functions, defined = set(), [], set(), set()
    catalyst, gateway = "org.apache.spark.sql.catalyst", spark.sparkContext._gateway
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            relations.append(_each(node.multipartIdentifier()))
        elif kind == "UnresolvedTableValuedFunction":
            functions.add(".".join(_each(node.name())).lower())
        elif kind == "UnresolvedWith":
            defined |= {str(x._1()).lower() for x in _each(node.cteRelations())}
        elif kind == "UnresolvedFunction":
            functions.add(".".join(_each(node.nameParts())).lower())
        if is_instance_of(gateway, node, f"{catalyst}.plans.logical.LogicalPlan"):
            nodes.add(node.nodeName())
            todo += _each(node.expressions())
            todo += [x for x in _each(node.innerChildren()) if is_instance_of(gateway, x, f"{catalyst}.plans.logical.LogicalPlan")]
        elif is_instance_of(gateway, node, f"{catalyst}.expressions.PlanExpression"):
            todo.append(node.plan())
        todo += _each(node.children())
    return nodes, relations, functions, defined


def check_read_only(spark: SparkSession, sql: str) -> str:
    """The statement without its closing semicolon. Raises NotReadOnly for all that isn't one SELECT
    over tables and views of the catalogue (never files by path) with functions of the list."""
    plain = sql.strip().removesuffix(";").strip()
    if plain.split(None, 1)[:1] and plain.split(None, 1)[0].upper().lstrip("(") not in ("SELECT", "WITH"):
        raise NotReadOnly("only SELECT and WITH are allowed")
    try:
        nodes, relations, functions, defined = parsed(spark, plain)
    except ParseException as e:
        raise NotReadOnly(str(e).splitlines()[0]) from e
    if other := nodes - READING:
        raise NotReadOnly(f"not allowed: {', '.join(sorted(other))}")
    if other := functions - FUNCTIONS - retrieval.NAMES:
        raise NotReadOnly(f"functions not allowed: {', '.join(sorted(other))}")
    for name in relations:
        quoted = ".".join("`" + part.replace("`", "``") + "`" for part in name)
        if not (len(name) == 1 and name[0].lower() in defined) and not _is_table(spark, quoted):
            raise NotReadOnly(f"no table {quoted}")
    return plain


def _is_table(spark: SparkSession, quoted: str) -> bool:
    try:
        return spark.catalog.tableExists(quoted)
    except AnalysisException:  # a catalogue or namespace that there isn't
        return False


@dataclass
class Step:
    query: str
    rationale: str
    result: list[str]
    rowcount: int
    error: str | None = None

    def payload(self) -> str:
        """The step as JSON of at most PAYLOAD_CHARS characters: whole rows from the first on, as many as
        fit, and whether any are left out. Long texts of the query and the reason are cut to fit."""
        some = asdict(self) | {"query": self.query[: PAYLOAD_CHARS // 8], "rationale": self.rationale[: PAYLOAD_CHARS // 8], "result": [], "left_out": 0}
        room = PAYLOAD_CHARS - len(json.dumps(some)) - 20
        for row in self.result:
            room -= len(json.dumps(row)) + 2
            if room < 0:
                break
            some["result"].append(row)
        some["left_out"] = len(self.result) - len(some["result"])
        return json.dumps(some)


def run(spark: SparkSession, sql: str, rationale: str = "", rows: int = DEFAULT_ROWS, timeout_s: float = TIMEOUT_S) -> Step:
    """Up to ``rows`` (500 at most) rows as JSON; errors, refusals and timeouts come back in the step."""
    try:
        plain = check_read_only(spark, sql)
    except NotReadOnly as e:
        return Step(sql, rationale, [], 0, f"refused: {e}")
    group, late = uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(timeout_s, stop)
    spark.sparkContext.setJobGroup(group, rationale, interruptOnCancel=True)
    timer.start()
    try:
        found = [r for r in spark.sql(plain).limit(min(max(rows, 0), MOST_ROWS)).toJSON().collect()]
        return Step(sql, rationale, found, len(found))
    except Exception as e:  # what a bad or slow query raises is its result
        return Step(sql, rationale, [], 0, f"timeout after {timeout_s} s" if late.is_set() else str(e).splitlines()[0])
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
