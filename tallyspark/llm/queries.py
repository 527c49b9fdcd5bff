"""The operators as queries over the whole given tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, chat, codes, decontaminate, interactions, language, licences, mixing, neardup, spots, sql, substrings, suffixes, token_counts
from tallyspark.llm.frames import documents, fold

RANKS = "byte_bpe_50k.tiktoken"


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_sides(chat.continuations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.compare_with_next(documents(spark, sf_dir))


def spot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity join of op8's fingerprints: each document's class and how many other classes are alike."""
    return spots.classes(documents(spark, sf_dir), percent=80)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(fold("doc_id", 3) != 1))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=8, entries=16, rounds=6)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=1024)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = interactions.failures(F.coalesce("text", F.lit("")))
    return interactions.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), conditions, repeated="E")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_preference_format": op4_preference_format,
    "op5_licence_scan": op5_licence_scan,
    "op6_context_mixing": op6_context_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_spot_fingerprints": op8_spot_fingerprints,
    "spot_classes": spot_classes,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_counts": op12_token_counts,
    "op13_filter_interactions": op13_filter_interactions,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": sql.NEAR_DUPLICATES,
    "op3_substring_dedup": sql.SUBSTRINGS,
    "op4_preference_format": chat.SQL,
    "op5_licence_scan": licences.SQL,
    "op7_suffix_dedup": sql.SUFFIXES,
    "op11_vector_codes": codes.SQL,
    "op13_filter_interactions": interactions.SQL,
}
