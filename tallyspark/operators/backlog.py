"""Work lists for tagging and embedding, and the write-back of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def untagged(items: DataFrame, tags: Column) -> DataFrame:
    """(item, category) pairs without tags: their questions joined by |, least id first."""
    open_rows = items.where(tags.isNull())
    return open_rows.groupBy("item_name", "category").agg(F.array_join(F.sort_array(F.collect_set("question")), "|").alias("questions"), F.min("id").alias("first_id"), F.max("n").alias("n"))


def updated(rows: DataFrame, results: DataFrame, key: str, *columns: str, clock: Column | None = None) -> DataFrame:
    """Rows with new values where results has them. Of several results of a key the last by its stamp
    counts as a whole; among equal stamps that of greater values, column by column. With a clock,
    ``updated_at`` says when a row got values (null: it did not)."""
    latest = results.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("stamp", *columns)).alias("new"))
    joined = rows.join(latest, key, "left")
    out = [F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns if c != "updated_at"]
    return joined.select(*out, *([F.when(F.col("new").isNotNull(), clock).alias("updated_at")] if clock is not None else []))


def in_vocabulary(tags: Column, vocabulary: list[str]) -> Column:
    """Tags of the vocabulary, in order and with repeats."""
    return F.filter(tags, lambda t: t.isin(*vocabulary))


def embedding_text(*parts: Column) -> Column:
    """Whole parts joined by " | ", null as empty with its separator kept; an embedder with a limit has to cut for itself."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(" | "), F.coalesce(part, F.lit(""))]
    return F.concat(*pieces[1:])


def tag_summary(tags: DataFrame, low: float = 0.5) -> DataFrame:
    return tags.groupBy("primary_topic").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < low).alias("low_confidence"), F.count_if("is_brand").alias("brands"))
