"""Schemas of the survey tables. Version 2 added ``short_label`` and the job diagnostics as
nullable columns; readers with ``mergeSchema`` see null there in older files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2

_text = T.StringType()
_texts = T.ArrayType(T.StringType())


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RACES = ("american_indian", "asian", "black", "hispanic", "middle_eastern", "pacific_islander", "white")

RESPONSES = _schema(
    id=T.LongType(), respondent_id=_text, question_id=T.IntegerType(), item_id=T.IntegerType(), item_name=_text, raw_value=_text,
    numeric_value=T.DecimalType(10, 2), joy_index=T.DecimalType(10, 2), is_selected=T.BooleanType(), fielding_id=_text, year_month=_text,
)
RESPONDENTS = _schema(
    respondent_id=_text, date_submitted=T.TimestampType(), age_band=_text, generation=_text, gender=_text, state=_text, region=_text,
    income=_text, parental_status=_text, employment=_text, marital_status=_text, is_hispanic=T.BooleanType(), **{f"race_{r}": T.BooleanType() for r in RACES},
)
ITEMS = _schema(item_id=T.IntegerType(), question_id=T.IntegerType(), item_name=_text, primary_topic=_text, subtags=_texts, is_brand=T.BooleanType(), is_location=T.BooleanType(), canonical_brand=_text, canonical_location=_text)
QUESTIONS = _schema(question_id=T.IntegerType(), question_text=_text, question_type=_text, primary_topic=_text, subtags=_texts, intent_tag=_text, n_items=T.IntegerType(), short_label=_text)
USAGE = _schema(respondent_id=_text, category=_text, usage_level=_text, source_question_id=T.IntegerType())
SCALE_LABELS = _schema(scale_family=_text, label=_text, display_order=T.IntegerType(), semantic_position=_text)
VERBATIMS = _schema(
    id=T.LongType(), respondent_id=_text, question_id=T.IntegerType(), text=_text, generation=_text, gender=_text, region=_text, is_quotable=T.BooleanType(), sentiment=_text,
    themes=_texts, joy_modes=_texts, tensions=_texts, occasions=_texts, functional_jobs=_texts, embedding=T.ArrayType(T.FloatType(), False),
)
JOBS = _schema(
    job_id=_text, status=_text, query_type=_text, prompt=_text, extra_context=_text, triage_brief=_text, scratch=T.ArrayType(_schema(query=_text, rationale=_text, result=_text, rowcount=T.LongType())),
    followup_chips=_texts, dispatch_status=T.IntegerType(), dispatch_error=_text, created_at=T.TimestampType(), completed_at=T.TimestampType(),
)

STATUSES = ("pending", "running", "complete", "error", "clarification_needed")


def commented(schema: T.StructType, **comments: str) -> T.StructType:
    """The schema with column comments as field metadata."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, **({"comment": comments[f.name]} if f.name in comments else {})}) for f in schema])


def checked(frame: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Fails the job that writes a value outside the domain."""
    value: Column = F.col(column)
    bad = value.isNotNull() & ~value.isin(*allowed)
    return frame.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit(f"{column} not allowed: "), value)).cast("string")).otherwise(value))


def read_all_versions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table whose files are of several versions: columns that a file does not have are null.
    With a schema also those that no file has."""
    found = spark.read.option("mergeSchema", True).parquet(path)
    if schema is None:
        return found
    return found.select(*[F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
