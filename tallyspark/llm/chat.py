"""Formats preference pairs of conversations with DataFrame functions only.

For each pair the longest common prefix of turns (equal role and text, null equal to
null) is rendered once as the prompt; what is left of each side is its completion. A
completion's mask says, in order, how many characters are trained on (``n:1``: the text
and end mark of assistant turns) and how many are not (``n:0``: all else).

Results for odd input: turns are ordered by (turn, role, text), nulls first; repeated
rows are repeated turns; a null text is rendered empty and a null role as ``unknown``; a
missing side has no turns, so that the prompt and that completion are empty; equal sides
give two empty completions; rows without a pair id are left out; an empty table gives an
empty table; extra columns are ignored. Texts of any length are rendered whole; all turns of a pair
are in one row, which holds each of them up to three times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    def one(t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(_body(t))
        trained = F.coalesce(t["role"] == TRAINED, F.lit(False))
        return F.when(trained, F.concat(head.cast("string"), F.lit(":0 "), body.cast("string"), F.lit(":1"))).otherwise(F.concat((head + body).cast("string"), F.lit(":0")))

    return F.array_join(F.transform(turns, one), " ")


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, side 'chosen' or 'rejected', turn, role, text) rows to one row for each pair."""
    turn = F.struct("turn", "role", "text")
    sides = turns.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == side, turn))).alias(side) for side in ("chosen", "rejected")])
    return format_sides(sides)


def format_sides(sides: DataFrame) -> DataFrame:
    """The same from rows (pair_id, chosen, rejected) that hold both sides' turns in order."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    equal = F.zip_with(F.slice("chosen", 1, shorter), F.slice("rejected", 1, shorter), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    sides = sides.withColumn("n_prompt", F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, shorter.cast("long")).cast("int"))
    rest = {side: F.slice(side, F.col("n_prompt") + 1, F.size(side)) for side in ("chosen", "rejected")}
    return sides.select(
        "pair_id",
        F.col("n_prompt").cast("long").alias("n_prompt"),
        F.size("chosen").cast("long").alias("n_chosen"),
        F.size("rejected").cast("long").alias("n_rejected"),
        _rendered(F.slice("chosen", 1, F.col("n_prompt"))).alias("prompt"),
        *[x for side in ("chosen", "rejected") for x in (_rendered(rest[side]).alias(side), _mask(rest[side]).alias(f"{side}_mask"))],
    )


def continuations(conversations: DataFrame) -> DataFrame:
    """Sides for ``format_sides``, one row for each conversation, whose turns up to its last reply are chosen.
    Rejected is the same beginning with the reply before it said again, or with no reply where there was none
    before. A conversation without replies is the same on both sides."""
    turn = F.struct("turn", "role", "text")
    rows = conversations.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("pair_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    trained = lambda t: F.coalesce(t["role"] == TRAINED, F.lit(False))
    last = F.coalesce(F.array_max(F.transform(F.col("turns"), lambda t, i: F.when(trained(t), i + 1))), F.lit(0))
    rows = rows.select("pair_id", "turns", last.alias("last"), F.filter("turns", trained).alias("replies"))
    begin = F.slice("turns", 1, F.greatest(F.col("last") - 1, F.lit(0)))
    rejected = F.when(F.col("last") == 0, F.col("turns")).when(F.size("replies") > 1, F.concat(begin, F.slice("replies", F.size("replies") - 1, F.lit(1)))).otherwise(begin)
    return rows.select("pair_id", F.when(F.col("last") == 0, F.col("turns")).otherwise(F.slice("turns", 1, F.col("last"))).alias("chosen"), rejected.alias("rejected"))


SQL = """
WITH t AS (SELECT conv_id AS pair_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
l AS (SELECT *, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: coalesce(turns[i].role = 'assistant', false))), 0) AS last,
    list_filter(turns, lambda x: coalesce(x.role = 'assistant', false)) AS replies FROM t),
sides AS (SELECT pair_id, CASE WHEN last = 0 THEN turns ELSE list_slice(turns, 1, last) END AS chosen,
    CASE WHEN last = 0 THEN turns WHEN len(replies) > 1 THEN list_concat(list_slice(turns, 1, last - 1), [replies[len(replies) - 1]]) ELSE list_slice(turns, 1, last - 1) END AS rejected FROM l),
cut AS (
  SELECT *, least(len(chosen), len(rejected)) AS shorter,
    coalesce(nullif(coalesce(list_position(list_transform(range(1, least(len(chosen), len(rejected)) + 1),
      lambda i: chosen[i].role IS NOT DISTINCT FROM rejected[i].role AND chosen[i].text IS NOT DISTINCT FROM rejected[i].text), false), 0), 0) - 1,
      least(len(chosen), len(rejected))) AS n FROM sides),
parts AS (
  SELECT pair_id, n, len(chosen) AS n_chosen, len(rejected) AS n_rejected, list_slice(chosen, 1, n) AS p,
    list_slice(chosen, n + 1, len(chosen)) AS c, list_slice(rejected, n + 1, len(rejected)) AS r FROM cut)
SELECT pair_id, CAST(n AS BIGINT) AS n_prompt, CAST(n_chosen AS BIGINT) AS n_chosen, CAST(n_rejected AS BIGINT) AS n_rejected,
  coalesce(array_to_string(list_transform(p, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '') AS chosen,
  coalesce(array_to_string(list_transform(c, lambda t: CASE WHEN t.role = 'assistant' THEN '14:0 ' || (length(coalesce(t.text, '')) + 8) || ':1'
    ELSE (length(coalesce(t.role, 'unknown')) + 5 + length(coalesce(t.text, '')) + 8) || ':0' END), ' '), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(r, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10)), ''), '') AS rejected,
  coalesce(array_to_string(list_transform(r, lambda t: CASE WHEN t.role = 'assistant' THEN '14:0 ' || (length(coalesce(t.text, '')) + 8) || ':1'
    ELSE (length(coalesce(t.role, 'unknown')) + 5 + length(coalesce(t.text, '')) + 8) || ':0' END), ' '), '') AS rejected_mask
FROM parts
"""
