"""How filters on documents interact: what each removes in every order, alone and on average.

Each document is one mask: the set of filters that it fails. Per part the counts of
masks are all that is needed. The removal polynomial of a part is the multilinear
extension of "documents removed by a set of filters": a document that fails the set m is
removed with probability 1 - prod(1 - x_i, i in m) if filter i is on with probability x_i.
Its value at a corner (every x 0 or 1) is the number removed by a set of filters, which
gives what survives each step of each order. The Shapley value of a filter is the integral
of its partial derivative along the diagonal, taken over exact rationals; times the number
of orders it is the sum of what the filter removes over all orders, a whole number.

Texts are read once, with SQL functions; from then on a row is an id, a part, a mask and a
digest of the text. Only counts of masks per part (32 at most for five filters) reach Python,
for a batch of parts at once.

Results for odd input: a null text is empty; it has no words, fails a least length and
nothing that counts something; a null part is the empty string, and one part with it. A
null id has no labels, is not a repeat and makes no other a repeat. Rows of equal id and
text don't repeat each other; of an id with different texts each row counts. Several label
rows of an id count together: one that says so is enough; null labels say nothing. An empty
table has no parts and gives no rows. A condition that is null is not failed. Texts of any
length are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.frames import drop_stored, shared_folder, stored

COUNTS = ("documents", "good", "toxic")
#: Parts whose rows are made at once; each has five rows for each of 120 orders.
PARTS = 64


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: too few words, too many repeated words, too many capitals, marks of markup."""
    found = words(text)
    count, distinct = F.size(found), F.size(F.array_distinct(found))
    return {
        "A": count < 50,
        "B": 100 * distinct.cast("long") < 65 * count.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def removal_polynomial(counts: np.ndarray) -> np.ndarray:
    """Coefficients of rows of mask counts; column S is the monomial of the filters in the bits of S.

    The product over a mask expands into its subsets with alternating signs, so the coefficient
    of S is, up to its sign, the number of documents that fail all of S.
    """
    out = counts.astype(np.int64)
    for bit in _bits(out.shape[1]):
        without = np.flatnonzero(np.arange(out.shape[1]) & bit == 0)
        out[:, without] += out[:, without | bit]
    out *= np.array([1 if s.bit_count() % 2 else -1 for s in range(out.shape[1])])
    out[:, 0] = 0
    return out


def at_corners(polynomial: np.ndarray) -> np.ndarray:
    """Values with the filters of each set on and all others off: the sum of the coefficients of its subsets."""
    out = polynomial.copy()
    for bit in _bits(out.shape[1]):
        having = np.flatnonzero(np.arange(out.shape[1]) & bit)
        out[:, having] += out[:, having ^ bit]
    return out


def diagonal_integral(polynomial: np.ndarray, bit: int) -> Fraction:
    """Integral from 0 to 1 of the partial derivative by one variable, all variables being t.

    The derivative of the monomial S with that variable is t ** (|S| - 1), whose integral is 1 / |S|.
    """
    by_degree: dict[int, int] = {}
    for s in range(len(polynomial)):
        if s & bit:
            by_degree[s.bit_count()] = by_degree.get(s.bit_count(), 0) + int(polynomial[s])
    return sum((Fraction(total, degree) for degree, total in by_degree.items()), Fraction(0))


def _bits(size: int) -> list[int]:
    return [1 << i for i in range(size.bit_length() - 1)]


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], repeated: str | None = None, text: str = "text", part: str = "source") -> DataFrame:
    """Rows (part, filter_order, step) for all orders of the filters, with counts of documents:
    kept after the step, removed by it, redundant (fail its filter, removed before), unique_fails
    (fail its filter only), good_lost and toxic_lost (removed, of labels quality or toxic 1), and
    shapley, what its filter removes, summed over all orders.

    ``conditions`` are on the columns of docs; ``repeated`` names one more filter, failed by
    texts that equal that of a smaller doc_id. Names are single letters.
    """
    names = [*conditions, *([repeated] if repeated else [])]
    paths = [shared_folder(docs.sparkSession)]
    mask = F.lit(0)
    for i, failed in enumerate(conditions.values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    seen = stored(seen, paths[0])
    known = seen.where("doc_id is not null")
    if repeated:
        first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
        again = F.when(F.col("first").isNull(), 1 << len(conditions)).otherwise(0)
        known = known.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + again)
    says = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    known = known.join(marks, "doc_id", "left").select("part", "mask", "good", "toxic")
    nameless = seen.where("doc_id is null").select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    count = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    masks = known.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("documents"), count("good"), count("toxic"))
    masks = stored(masks)
    drop_stored(docs.sparkSession, *paths)
    per_part = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))  # a row for each mask there is
    return per_part.mapInArrow(_rows(names), "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def _rows(names: list[str]):
    size, n = 1 << len(names), len(names)
    orders = list(permutations(range(n)))
    now = np.array([[1 << i for i in order] for order in orders]).ravel()
    after = np.array([[sum(1 << i for i in order[: k + 1]) for k in range(n)] for order in orders]).ravel()
    before, which = after ^ now, np.array(orders).ravel()
    spelled = pa.array(np.repeat(["".join(names[i] for i in order) for order in orders], n), pa.string())
    step = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))

    def of(parts: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros((len(COUNTS), parts.num_rows, size), np.int64)
        for row, masks in enumerate(parts.column(1).to_pylist()):
            for m in masks:
                counts[:, row, m["mask"]] = [m[c] for c in COUNTS]
        polynomials = [removal_polynomial(c) for c in counts]
        gone, good, toxic = map(at_corners, polynomials)
        total = counts[0].sum(axis=1, keepdims=True)
        removed = gone[:, after] - gone[:, before]
        unique = gone[:, [size - 1]] - gone[:, size - 1 - now]
        worth = [[int(factorial(n) * diagonal_integral(p, 1 << i)) for i in range(n)] for p in polynomials[0]]
        columns = [total - gone[:, after], removed, gone[:, now] - removed, unique, good[:, after] - good[:, before], toxic[:, after] - toxic[:, before], np.array(worth, np.int64)[:, which]]
        part = parts.column(0).take(pa.array(np.repeat(np.arange(parts.num_rows), len(now))))
        return pa.RecordBatch.from_arrays(
            [part, pa.concat_arrays([spelled] * parts.num_rows), pa.array(np.tile(step, parts.num_rows)), *(pa.array(c.ravel()) for c in columns)],
            names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                yield of(batch.slice(at, PARTS))

    return run


#: The definition, order by order and step by step, from the documents' masks.
SQL = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM words GROUP BY t),
failed AS (
  SELECT words.doc_id, part, (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 5 * length(words.t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN words.doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM words JOIN least ON least.t = words.t),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM failed LEFT JOIN said ON said.doc_id = failed.doc_id GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(list_slice(bits, 1, step - 1)), 0) AS INTEGER) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
