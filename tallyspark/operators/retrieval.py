"""Finds items, texts and statements by tags, words, likeness of spelling and vectors."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def overlaps(tags: Column, want: list[str]) -> Column:
    """Whether any tag is wanted; false, not null, where nothing is known."""
    return F.coalesce(F.arrays_overlap(tags, strings(*want)), F.lit(False))


def holds(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def holds_all(tags: Column, want: list[str]) -> Column:
    return tags.isNotNull() & (F.size(F.array_except(strings(*want), tags)) == 0)


def array_length(tags: Column) -> Column:
    """Length of an array; null for an empty one, so that tagged-but-empty rows are not pulled again."""
    return F.nullif(F.size(tags), F.lit(0))


def overlap_score(tags: Column, want: list[str]) -> Column:
    return F.coalesce(F.size(F.array_intersect(tags, strings(*want))), F.lit(0))


def items_by_tags(items: DataFrame, wants: dict[str, list[str] | None], *order: Column, min_n: int = 0, limit: int = 20) -> DataFrame:
    """Items that share most tags with those wanted in each array column (None: not asked), with ``min_n`` answers (column n) at least."""
    score = F.lit(0)
    for column, want in wants.items():
        if want is not None:
            score = score + overlap_score(F.col(column), want)
    scored = items.withColumn("overlap_score", score).where("overlap_score > 0")
    scored = scored.where(F.col("n") >= min_n) if min_n else scored
    return scored.orderBy(F.desc("overlap_score"), *order).limit(limit)


def asked(rows: DataFrame, tags: dict[str, list[str] | None] | None = None, values: dict[str, str | list[str] | None] | None = None, quotable: bool | None = None) -> DataFrame:
    """Rows that meet all that is asked: an overlap for each tag array, one of the values for each
    column, and the quotable flag. None is no condition."""
    for column, want in (tags or {}).items():
        rows = rows if want is None else rows.where(overlaps(F.col(column), want))
    for column, want in (values or {}).items():
        rows = rows if want is None else rows.where(F.col(column).isin(want if isinstance(want, list) else [want]))
    return rows.where("is_quotable") if quotable else rows


def verbatims_by_tags(rows: DataFrame, tags: dict[str, list[str] | None], query: str | None = None, quotable: bool | None = True, limit: int = 50) -> DataFrame:
    """Texts by tag arrays and an optional query of words with OR, most matched words first, longest text first."""
    kept = asked(rows, tags, quotable=quotable)
    kept = full_text(kept, "text", query) if query else kept.withColumn("matched_terms", F.lit(0))
    return kept.orderBy(F.desc("matched_terms"), F.desc(F.length("text")), "doc_id").limit(limit)


def verbatims_full_text(rows: DataFrame, entity: str, joy_modes: list[str] | None = None, generation: str | None = None, gender: str | None = None, quotable: bool | None = True, limit: int = 50) -> DataFrame:
    """Texts that name an entity, in any category: what is said of a brand often stands under others."""
    kept = asked(full_text(rows, "text", entity), {"joy_modes": joy_modes} if joy_modes else None, {"generation": generation, "gender": gender}, quotable)
    return kept.orderBy(F.desc("matched_terms"), "doc_id").limit(limit)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def parse_terms(query: str) -> list[list[str]]:
    """A query of words as alternatives (OR) of conjunctions."""
    return [re.findall("[a-z0-9]+", part.lower()) for part in re.split(r"\s+OR\s+", query) if re.search("[A-Za-z0-9]", part)]


def text_match(text: Column, query: str) -> tuple[Column, Column]:
    """Whether a text satisfies the query, and how many of its distinct terms it has."""
    words, alternatives = words_of(text), parse_terms(query)
    hit = F.lit(False)
    for terms in alternatives:
        both = F.lit(True)
        for term in terms:
            both = both & F.array_contains(words, term)
        hit = hit | both
    terms = sorted({t for a in alternatives for t in a})
    return hit, F.size(F.array_intersect(words, strings(*terms)))


def full_text(rows: DataFrame, text: str, query: str, *filters: Column) -> DataFrame:
    """Rows that satisfy the query and the optional filters, with the number of matched terms."""
    hit, rank = text_match(F.col(text), query)
    rows = rows.where(hit)
    for condition in filters:
        rows = rows.where(condition)
    return rows.withColumn("matched_terms", rank)


# Words with irregular or related forms.
FORMS = {
    "run": "run|running|ran|runs",
    "buy": "buy|buying|bought|buys|purchased|purchasing|purchase",
    "fuck": "fuck|fucking|fucked|fucks",
    "shit": "shit|shits|shitty|bullshit|dipshit|horseshit",
}


def inflections(stem: str) -> str:
    """Pattern of a word and its inflections, at word bounds, ignoring case: those of FORMS, else the regular ones."""
    low, vowels = stem.lower(), "aeiou"
    base = re.escape(low)
    if low in FORMS:
        forms = FORMS[low]
    elif low.endswith("y") and low[-2:-1] not in vowels:
        forms = f"{re.escape(low[:-1])}(y|ies|ied|ying)"
    elif low.endswith("e"):
        forms = f"{re.escape(low[:-1])}(e|es|ed|ing|er|ers)"
    elif len(low) > 2 and low[-1] not in vowels + "wxy" and low[-2] in vowels and low[-3] not in vowels:
        forms = f"{base}(s|es|({low[-1]})?(ed|ing|er|ers))?"  # stop, stopped; visit, visited
    else:
        forms = f"{base}(s|es|ed|ing|er|ers)?"
    return rf"(?i)\b({forms})\b"


def word_pattern(*alternatives: str) -> str:
    return rf"(?i)\b({'|'.join(map(re.escape, alternatives))})\b"


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(trigrams(a), trigrams(b)))
    return shared.cast("double") / F.size(F.array_union(trigrams(a), trigrams(b)))


def fuzzy(items: DataFrame, name: str, wanted: str, min_similarity: float = 0.3) -> DataFrame:
    return items.withColumn("similarity", trigram_similarity(F.col(name), F.lit(wanted))).withColumn("distance", F.levenshtein(F.col(name), F.lit(wanted)).cast("long")).where(F.col("similarity") >= min_similarity)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors of equal length, in doubles; null if one is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def semantic_topk(rows: DataFrame, vector: str, key: str, query: list[float], limit: int = 10) -> DataFrame:
    """The rows nearest to a query vector by an exact scan; ties go to the smaller key."""
    return rows.withColumn("similarity", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))).orderBy(F.desc_nulls_last("similarity"), F.asc(key)).limit(limit)


#: Query vectors that go to the tasks at once (their bytes are at most this times eight times their length), and rows compared with them at once.
QUERY_BLOCK, SLICE = 8192, 1024


def nearest(rows: DataFrame, queries: DataFrame, vector: str, key: str, limit: int = 10) -> DataFrame:
    """(query, key, similarity, nth): for each query row the ``limit`` rows nearest by cosine to
    nine decimals, all rows compared exactly; ties go to the smaller key. Keys are long.

    Queries go to the tasks in blocks of ``QUERY_BLOCK``; each block is one pass over the rows,
    of which every task keeps the best few for each query before they are shuffled. Null
    vectors, those of length zero and those of another length are near to nothing.
    """
    spark = rows.sparkSession
    known = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v"))
    count = known.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        some = known.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow().sort_by("query")
        ids, matrix = _unit(some.column("query").to_numpy(), some.column("v").to_pylist())
        held = spark.sparkContext.broadcast((ids, matrix))

        def run(batches, held=held):
            ids, matrix = held.value
            best = None
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE) if len(ids) else ():
                    part = batch.slice(at, SLICE)
                    keys, vectors = _unit(part.column(0).to_numpy(), part.column(1).to_pylist(), matrix.shape[1])
                    if len(keys):
                        best = _better(best, np.rint(matrix @ vectors.T * 1e9).astype(np.int64), keys, limit)
            if best is not None:
                near, keys = best
                query = np.repeat(ids, near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(keys.ravel()), pa.array(near.ravel() / 1e9)], names=["query", "key", "similarity"])

        found = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "query long, key long, similarity double")
        out = found if out is None else out.unionByName(found)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    return out.withColumn("nth", nth).where(F.col("nth") <= limit).select("query", F.col("key").alias(key), "similarity", "nth")


def _unit(ids: np.ndarray, vectors: list, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of length one of the vectors that have a direction and the given number of places."""
    size = size or next((len(v) for v in vectors if v), 0)
    fits = [i for i, v in enumerate(vectors) if v is not None and len(v) == size and None not in v and any(v)]
    matrix = np.array([vectors[i] for i in fits], np.float64).reshape(len(fits), size)
    return np.asarray(ids)[fits], matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if len(fits) else matrix


def _better(best: tuple[np.ndarray, np.ndarray] | None, near: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The best similarities (whole numbers) and keys of each query, of those so far and a slice of at most SLICE rows."""
    order = np.argsort(keys)
    near, keys = near[:, order], keys[order]
    if len(keys) > limit:
        ranked = near * SLICE + np.arange(SLICE - 1, SLICE - 1 - len(keys), -1)  # of equal ones the smaller key is greater
        at = np.argpartition(ranked, len(keys) - limit, axis=1)[:, len(keys) - limit :]
        near, keys = np.take_along_axis(near, at, 1), keys[at]
    else:
        keys = np.tile(keys, (len(near), 1))
    if best is not None:
        near, keys = np.concatenate((best[0], near), axis=1), np.concatenate((best[1], keys), axis=1)
        at = np.lexsort((keys, -near), axis=1)[:, :limit]
        near, keys = np.take_along_axis(near, at, 1), np.take_along_axis(keys, at, 1)
    return near, keys


def fused(*ranked: DataFrame, key: str = "id", constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (key, rank) lists: each key's summed 1 / (constant + rank) and how many lists hold it."""
    union = ranked[0].select(key, "rank")
    for other in ranked[1:]:
        union = union.unionByName(other.select(key, "rank"))
    return union.groupBy(key).agg(F.sum(F.lit(1.0).cast("double") / (F.col("rank") + constant)).alias("score"), F.count("*").alias("lists"))


def ranked(rows: DataFrame, *order: Column, key: str = "id", limit: int = 20) -> DataFrame:
    """The first rows of an order with their ranks."""
    top = rows.orderBy(*order).limit(limit)
    return top.select(key, F.row_number().over(Window.orderBy(*order)).alias("rank"))
