"""Retrieval as SQL: table functions with named arguments and defaults over views of the session.

``register`` puts the given tables in place as views and defines the functions over them, as SQL functions,
which the optimiser inlines: a call is a plain query whose filters reach the scan, and what
surrounds the call is planned with it. A null argument asks for nothing. Array arguments match
rows that share a value. ``p_limit`` is the number of the best rows; ties go to the smaller id.

The views and the columns they need (others are ignored):

scores      id, item_name, question, category, joy_index, n, joy_modes, themes, occasions, functional_jobs, tensions, embedding
verbatims   id, response_text, category, generation, gender, is_quotable, joy_modes, themes, occasions, functional_jobs, tensions, embedding
demo_splits item_name, and any measures (n_overall, overall_ji, ji_male, ji_female, gender_gap are given)
laws        law_id, title, statement, evidence, implication, applies_to_categories, embedding
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TAGS = ("joy_modes", "themes", "occasions", "functional_jobs", "tensions")
VIEWS = ("scores", "verbatims", "demo_splits", "laws")

_ANY = "(p_{0} IS NULL OR coalesce(arrays_overlap({0}, p_{0}), false))"
_SHARED = " + ".join(f"coalesce(size(array_intersect({t}, p_{t})), 0)" for t in TAGS)
_TAG_ARGS = ", ".join(f"p_{t} ARRAY<STRING> DEFAULT NULL" for t in TAGS)
_ASKED = " AND ".join(_ANY.format(t) for t in TAGS)
_SCORES = "id BIGINT, item_name STRING, question STRING, category STRING, joy_index DOUBLE, n BIGINT, joy_modes ARRAY<STRING>"
_SCORES_OUT = "id, item_name, question, category, joy_index, n, joy_modes"
_VERBATIMS = "id BIGINT, response_text STRING, category STRING, generation STRING, gender STRING, is_quotable BOOLEAN"
_VERBATIMS_OUT = "id, response_text, category, generation, gender, is_quotable"
_LAWS = "law_id BIGINT, title STRING, statement STRING, evidence STRING, implication STRING, applies_to_categories ARRAY<STRING>"
_LAWS_OUT = "law_id, title, statement, evidence, implication, applies_to_categories"


def _best(columns: str, more: str, source: str, order: str, where: str) -> str:
    """The first p_limit rows of an order."""
    return f"SELECT {columns}, {more.rsplit(' AS ', 1)[-1]} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM (SELECT *, {more} FROM {source}) WHERE {where}) WHERE place <= p_limit"


def _words(text: str) -> str:
    """Words of an expression; a function of SQL can't be called inside a lambda."""
    return f"filter(split(regexp_replace(lower({text}), '[^a-z0-9]+', ' '), ' '), w -> w <> '')"


#: Functions of values, by which the table functions are written; they can be called too.
SCALAR = {
    "words_of": f"(p_text STRING) RETURNS ARRAY<STRING> RETURN {_words('p_text')}",
    "text_matches": f"(p_text STRING, p_query STRING) RETURNS BOOLEAN RETURN coalesce(exists(split(p_query, '\\\\s+OR\\\\s+'), a -> size({_words('a')}) > 0 AND size(array_except({_words('a')}, {_words('p_text')})) = 0), false)",
    "matched_terms": "(p_text STRING, p_query STRING) RETURNS INT RETURN coalesce(size(array_intersect(words_of(p_text), words_of(regexp_replace(p_query, '\\\\s+OR\\\\s+', ' ')))), 0)",
    "trigrams": "(p_text STRING) RETURNS ARRAY<STRING> RETURN array_distinct(transform(sequence(1, length(p_text) + 1), i -> substr('  ' || lower(p_text) || ' ', i, 3)))",
    "trigram_similarity": "(p_a STRING, p_b STRING) RETURNS DOUBLE RETURN CAST(size(array_intersect(trigrams(p_a), trigrams(p_b))) AS DOUBLE) / size(array_union(trigrams(p_a), trigrams(p_b)))",
    "dot_product": "(p_a ARRAY<DOUBLE>, p_b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(p_a, p_b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)",
    "cosine": "(p_a ARRAY<DOUBLE>, p_b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN dot_product(p_a, p_b) / nullif(sqrt(dot_product(p_a, p_a)) * sqrt(dot_product(p_b, p_b)), CAST(0 AS DOUBLE))",
}

TABLE = {
    "retrieve_items_by_tags": f"(p_category_keys ARRAY<STRING> DEFAULT NULL, {_TAG_ARGS}, p_min_n BIGINT DEFAULT 0, p_limit INT DEFAULT 20) RETURNS TABLE ({_SCORES}, overlap_score INT) RETURN "
    + _best(_SCORES_OUT, f"{_SHARED} AS overlap_score", "scores", "overlap_score DESC, joy_index DESC NULLS LAST, id", "overlap_score > 0 AND n >= p_min_n AND (p_category_keys IS NULL OR array_contains(p_category_keys, category))"),
    "retrieve_items_full_text": f"(p_query STRING, p_limit INT DEFAULT 50) RETURNS TABLE ({_SCORES}, rank INT) RETURN "
    + _best(_SCORES_OUT, "matched_terms(concat_ws(' ', item_name, question), p_query) AS rank", "scores", "rank DESC, id", "text_matches(concat_ws(' ', item_name, question), p_query)"),
    "retrieve_items_fuzzy": f"(p_name STRING, p_min_similarity DOUBLE DEFAULT 0.3, p_limit INT DEFAULT 20) RETURNS TABLE ({_SCORES}, similarity DOUBLE) RETURN "
    + _best(_SCORES_OUT, "trigram_similarity(item_name, p_name) AS similarity", "scores", "similarity DESC, id", "similarity >= p_min_similarity"),
    "retrieve_items_semantic": f"(p_query_embedding ARRAY<DOUBLE>, p_limit INT DEFAULT 10) RETURNS TABLE ({_SCORES}, similarity DOUBLE) RETURN "
    + _best(_SCORES_OUT, "round(cosine(embedding, p_query_embedding), 9) AS similarity", "scores", "similarity DESC, id", "similarity IS NOT NULL"),
    "retrieve_verbatims": f"({', '.join(f'p_{a} ARRAY<STRING> DEFAULT NULL' for a in ('joy_modes', 'themes', 'category_keys', 'tensions', 'occasions', 'functional_jobs'))}, p_generation STRING DEFAULT NULL, p_gender STRING DEFAULT NULL, p_query STRING DEFAULT NULL, p_require_quotable BOOLEAN DEFAULT true, p_limit INT DEFAULT 50) RETURNS TABLE ({_VERBATIMS}, rank INT) RETURN "
    + _best(_VERBATIMS_OUT, "matched_terms(response_text, p_query) AS rank", "verbatims", "rank DESC, length(response_text) DESC, id", f"{_ASKED} AND (p_category_keys IS NULL OR array_contains(p_category_keys, category)) AND (p_generation IS NULL OR generation = p_generation) AND (p_gender IS NULL OR gender = p_gender) AND (p_query IS NULL OR text_matches(response_text, p_query)) AND (NOT coalesce(p_require_quotable, false) OR is_quotable)"),
    "retrieve_verbatims_full_text": f"(p_entity_query STRING, p_joy_modes ARRAY<STRING> DEFAULT NULL, p_generation STRING DEFAULT NULL, p_gender STRING DEFAULT NULL, p_require_quotable BOOLEAN DEFAULT true, p_limit INT DEFAULT 50) RETURNS TABLE ({_VERBATIMS}, rank INT) RETURN "
    + _best(_VERBATIMS_OUT, "matched_terms(response_text, p_entity_query) AS rank", "verbatims", "rank DESC, id", f"text_matches(response_text, p_entity_query) AND {_ANY.format('joy_modes')} AND (p_generation IS NULL OR generation = p_generation) AND (p_gender IS NULL OR gender = p_gender) AND (NOT coalesce(p_require_quotable, false) OR is_quotable)"),
    "retrieve_verbatims_semantic": f"(p_query_embedding ARRAY<DOUBLE>, p_require_quotable BOOLEAN DEFAULT true, p_limit INT DEFAULT 10) RETURNS TABLE ({_VERBATIMS}, similarity DOUBLE) RETURN "
    + _best(_VERBATIMS_OUT, "round(cosine(embedding, p_query_embedding), 9) AS similarity", "verbatims", "similarity DESC, id", "similarity IS NOT NULL AND (NOT coalesce(p_require_quotable, false) OR is_quotable)"),
    "retrieve_demo_splits": "(p_item_name STRING, p_limit INT DEFAULT 50) RETURNS TABLE (item_name STRING, n_overall BIGINT, overall_ji DOUBLE, ji_male DOUBLE, ji_female DOUBLE, gender_gap DOUBLE, similarity INT) RETURN "
    + _best("item_name, n_overall, overall_ji, ji_male, ji_female, gender_gap", "CASE WHEN lower(item_name) = lower(p_item_name) THEN 2 ELSE 1 END AS similarity", "demo_splits", "similarity DESC, n_overall DESC NULLS LAST, item_name", "item_name ILIKE '%' || p_item_name || '%'"),
    "retrieve_laws": f"(p_categories ARRAY<STRING>, p_limit INT DEFAULT 50) RETURNS TABLE ({_LAWS}, overlap_score INT) RETURN "
    + _best(_LAWS_OUT, "coalesce(size(array_intersect(applies_to_categories, p_categories)), 0) AS overlap_score", "laws", "overlap_score DESC, law_id", "overlap_score > 0"),
    "retrieve_laws_semantic": f"(p_query_embedding ARRAY<DOUBLE>, p_limit INT DEFAULT 10) RETURNS TABLE ({_LAWS}, similarity DOUBLE) RETURN "
    + _best(_LAWS_OUT, "round(cosine(embedding, p_query_embedding), 9) AS similarity", "laws", "similarity DESC, law_id", "similarity IS NOT NULL"),
}

NAMES = {*SCALAR, *TABLE}


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Makes views of the tables (names of ``VIEWS``) and defines the functions over those that are given."""
    if unknown := set(tables) - set(VIEWS):
        raise ValueError(f"no such view: {', '.join(sorted(unknown))}")
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    for name, body in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
    for name, body in TABLE.items():
        if any(f"FROM {view})" in body for view in tables):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body}")
