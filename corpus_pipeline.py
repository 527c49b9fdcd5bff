"""A training-data pipeline over ``documents``: each stage is one operator of tallyspark.llm.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of ``documents``. Null ids and repeated ids: a row is known by its id and text, so
repeated rows are one document in the near-duplicate stage and rows that only share an id
are judged each for itself. Null texts are empty texts. A null id is kept. Empty tables
give empty tables. Columns other than those of ``documents`` are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, decontaminate, language, neardup, suffixes
from tallyspark.llm.frames import LAST, documents, drop_stored, fold, identified, shared_folder, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of no language that the labelled documents show."""
    model = language.fit(docs.where(fold("doc_id", 3) != 1))
    found = language.predict(docs, model, COLUMNS)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= language.REJECT)
    return found.where(known | F.lit(not model.languages)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by id, of each group linked at a similarity of 0.8 on five-word shingles."""
    rows = identified(docs, "doc_id", "lang", "source", "n_chars")
    first = neardup.near_duplicates(docs, 5, 80).where("first").select(F.coalesce("doc_id", F.lit(LAST)).alias("did"), "uid").distinct()
    stay = rows.join(first.hint("shuffle_hash"), ["did", "uid"], "left_semi")
    again = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1)  # rows of equal id and text are one document
    return (stay.dropDuplicates(["did", "uid"]) if again else stay).select(*COLUMNS)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every 100-byte string that starts earlier too, in whole characters; drops documents of which nothing is left."""
    cut = suffixes.remove_repeats(docs, ("doc_id", "lang", "source"), whole_chars=True)
    text = F.col("kept").cast("string")
    left = cut.where("n_units = 0 or n_removed < n_units").withColumn("text", text)
    return left.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    found = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ("key",)).select("key").distinct()
    return rows.join(found, "key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and whether they decode to it."""
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("doc_id", "lang", "source"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "intact")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_strings),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is deleted once the next one's is written; the last one stays."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES:
        path = shared_folder(spark)
        docs = stored(stage(spark, docs, sf_dir), path)
        if before is not None:
            drop_stored(spark, before)
        before = path
    return docs
