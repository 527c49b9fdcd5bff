"""The job log: append-only rows, of which those that fit the state before them make a job's state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of an investigation, and the marks of the password gate.
TURNS = {"none": 0, "minimal": 4, "focused": 10, "thorough": 12}
TOKENS = {"short": 1500, "medium": 4000, "long": 16000}
PATIENCE_S = 90
GATE_STATUS, GATE_TEXT = 401, "Password Protection"

ENDED = ("complete", "error", "clarification_needed")

# The fields of a triage brief and what stands for those of one that can't be read.
BRIEF = (
    "the_question string, investigation_depth string, response_posture string, response_length string, investigator_brief string, followup_seeds array<string>, "
    "needs_clarification boolean, clarifying_question string, early_exit boolean, early_exit_response string"
)
BRIEF_DEFAULTS = {"investigation_depth": "focused", "response_posture": "interpretive", "response_length": "medium"}
UNREAD = "Triage JSON parse failed. Apply default focused investigation."


def latest(log: DataFrame, key: str = "job_id", *order: str) -> DataFrame:
    """The last row of each job."""
    columns = [c for c in log.columns if c != key]
    stamp = F.struct(*(order or ("ts", "event_id")))
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), stamp).alias("last")).select(key, "last.*")


def effective(log: DataFrame, key: str = "job_id", *order: str) -> DataFrame:
    """The rows of a log (status, and the state ``expected`` before it, null for a new job) that took effect.

    A job begins with its first pending row. From pending it goes to the first later row that
    expects pending (running, or an end); from running to the first later one that expects
    running and ends it. All other rows came too late or at the wrong time and change nothing:
    a job that isn't pending is not started again, and a watchdog that loses the race has no effect.
    """
    job = Window.partitionBy(key)
    stamp = F.struct(*(order or ("ts", "event_id")))
    first = lambda condition: F.min(F.when(condition, stamp)).over(job)
    status, expected = F.col("status"), F.col("expected")
    rows = log.withColumn("_new", first((status == "pending") & expected.isNull()))
    leaves = (expected == "pending") & status.isin("running", *ENDED)
    rows = rows.withColumn("_left", first(leaves & (stamp > F.col("_new"))))
    rows = rows.withColumn("_to", F.max(F.when(leaves & (stamp == F.col("_left")), status)).over(job))
    ends = (expected == "running") & status.isin(*ENDED) & (F.col("_to") == "running")
    rows = rows.withColumn("_end", first(ends & (stamp > F.col("_left"))))
    took = ((status == "pending") & expected.isNull() & (stamp == F.col("_new"))) | (leaves & (stamp == F.col("_left"))) | (ends & (stamp == F.col("_end")))
    return rows.where(took).drop("_new", "_left", "_to", "_end")


def overdue(log: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows to append for jobs that still wait after the patience: error, expecting the waiting state,
    so that a job that starts meanwhile is left alone. Facts is one row of now and waiting."""
    state = latest(log.select("job_id", "status", "ts", "event_id")).join(F.broadcast(facts))
    late = F.col("ts") < F.col("now") - F.expr(f"INTERVAL {PATIENCE_S} SECONDS")
    return state.where((F.col("status") == F.col("waiting")) & late).select("job_id", "ts", F.lit("error").alias("status"), F.col("waiting").alias("expected"))


def stage(status: Column, triaged: Column) -> Column:
    """What a job is doing, from its status and whether it has a brief."""
    return F.when(status == "pending", "queued").when(status == "running", F.when(triaged, "investigation").otherwise("triage")).otherwise(status)


def turns(depth: str | None) -> int:
    return TURNS.get(depth or "", TURNS["focused"])


def dispatch_outcome(threw: Column, status: Column, preview: Column) -> Column:
    """How handing a job over went: threw, password_gate, denied (401, 403), refused (any other
    answer outside 200 to 299) or accepted. No answer at all without an error is no failure."""
    gate = (status == GATE_STATUS) & F.contains(preview, F.lit(GATE_TEXT))
    return F.when(threw, "threw").when(F.coalesce(gate, F.lit(False)), "password_gate").when(status.isin(401, 403), "denied").when((status < 200) | (status >= 300), "refused").otherwise("accepted")


def brief(text: Column, question: Column | None = None) -> Column:
    """A triage brief from JSON text, fenced or not. What can't be read becomes a focused,
    interpretive investigation of medium length of the question as it was asked."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*\n", ""), r"\n```\s*$", ""))
    parsed = F.from_json(plain, BRIEF)
    known = F.coalesce(F.get_json_object(plain, "$").isNotNull() & plain.startswith("{"), F.lit(False))
    names = [field.split()[0] for field in BRIEF.split(", ")]
    kinds = {"needs_clarification": F.lit(False), "early_exit": F.lit(False), "followup_seeds": F.array().cast("array<string>"), "the_question": question if question is not None else F.lit(None).cast("string")}
    out = []
    for name in names:
        default = kinds.get(name, F.lit(BRIEF_DEFAULTS.get(name)).cast("string"))
        unread = F.lit(UNREAD) if name == "investigator_brief" else default
        out.append(F.when(known, F.coalesce(parsed[name], default)).otherwise(unread).alias(name))
    return F.struct(*out)


#: What a trim of the interface takes off: blanks of any kind.
_BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def followups(text: Column, marker: str = "WHERE TO GO NEXT") -> Column:
    """The first three numbered lines (``1.``, perhaps indented) of more than 15 characters from the first marker on, whatever its
    case. Their number, if they are not indented, and brackets around them are taken off."""
    section = F.regexp_extract(text, rf"(?is){re.escape(marker)}.*", 0)
    numbered = F.filter(F.split(section, "\n"), lambda x: x.rlike(rf"^{_BLANK}*[0-9]+\."))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, rf"^[0-9]+\.{_BLANK}*", ""), r"^\[|\]\z", "")
    plain = F.transform(numbered, lambda x: F.regexp_replace(bare(x), rf"^{_BLANK}+|{_BLANK}+\z", ""))
    return F.coalesce(F.slice(F.filter(plain, lambda x: F.length(x) > 15), 1, 3), F.array().cast("array<string>"))
