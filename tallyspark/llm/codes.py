"""Compresses vectors to codes: each part of a vector becomes the index of the nearest entry of a small codebook.

Vectors are whole numbers (a component times ``SCALE``, rounded down), written once; distances and
means are exact, so results don't depend on how rows are divided. Each round of training is
one pass: tasks assign their rows and add up the parts of each entry, and only these sums, one row for each entry
and task, are shuffled; what reaches the driver is one row for each entry.

The nearest entry is found by partial distances: a codebook's dimensions are taken in
descending order of its entries' variance, so that most of a distance is known early. Entries are tried in
order for all rows at once; a row gives an entry up as soon as what has been added up is
greater than its best complete distance so far. An equal distance does not replace the
entry before, so ties go to the lower index.

Results for odd input: rows whose vector is null, or has null or non-finite components, are
dropped; so are those whose length is no multiple of the number of parts, or differs from that of the kept row
with the smallest id. Components beyond ``FAR`` are cut to it, so that errors fit a long. A null id comes
after all others; equal ids are ordered by their vectors. With fewer rows than entries there are as many
entries as rows; an empty table gives no rows and no entries. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.frames import drop_stored, shared_folder, stored

SCALE, FAR = 4096, 1 << 15
#: Rows that are assigned at once.
ROWS = 16_384


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part: an array of (parts, entries, components of a part)."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each part of rows of vectors."""
        parts = vectors.reshape(len(vectors), len(self.entries), -1)
        found = [nearest(parts[:, p].T.astype(np.int64), self.entries[p]) for p in range(len(self.entries))]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def order_of(entries: np.ndarray) -> np.ndarray:
    """Dimensions in descending order of the entries' variance (times their number squared, exactly)."""
    exact = entries.astype(object)
    spread = len(exact) * (exact**2).sum(axis=0) - exact.sum(axis=0) ** 2
    return np.array(sorted(range(entries.shape[1]), key=lambda d: (-spread[d], d)), np.int64)


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each column of (components, rows), by partial distances."""
    order = order_of(entries)
    index = np.zeros(values.shape[1], np.int64)
    best = ((values - entries[0][:, None]) ** 2).sum(axis=0)
    for e in range(1, len(entries)):
        rows = None  # all
        far = np.zeros(values.shape[1], np.int64)
        for d in order:
            step = (values[d] if rows is None else values[d, rows]) - entries[e, d]
            far = far + step * step
            near = far <= (best if rows is None else best[rows])
            if not near.all():
                rows = np.flatnonzero(near) if rows is None else rows[near]
                far = far[near]
            if not len(far):
                break
        if rows is None:
            rows = np.arange(values.shape[1])
        closer = far < best[rows]
        index[rows[closer]], best[rows[closer]] = e, far[closer]
    return index, best


def whole_numbers(vector: Column) -> Column:
    """Components times SCALE, rounded down."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.greatest(F.least(x, F.lit(float(FAR))), F.lit(-float(FAR))) * SCALE).cast("int"))


def usable(vector: Column, parts: int) -> Column:
    finite = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite, F.lit(False))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in groups of about ROWS rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, size)


def sums(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each (part, entry) that is nearest to any part, their number and componentwise sum."""
    parts, entries, width = books.entries.shape

    def run(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for table in _grouped(batches):
            rows = _matrix(table.column(0), parts * width)
            index, _ = books.assign(rows)
            for p in range(parts):
                count[p] += np.bincount(index[:, p], minlength=entries)
                for e in range(entries):
                    total[p, e] += rows[index[:, p] == e, p * width : (p + 1) * width].sum(axis=0, dtype=np.int64)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    found = vectors.select("vector").mapInArrow(run, "part int, entry int, n long, total array<long>")
    added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    return {(r.part, r.entry): (r.n, r.total) for r in added.collect()}  # a row for each entry


def fit(vectors: DataFrame, size: int, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks from rows (id, vector of ``size`` whole numbers): they start as the vectors of the smallest ids."""
    first = [r.vector for r in vectors.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()]  # as many as entries
    books = Codebooks(np.array(first, np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        new = books.entries.copy()
        for (p, e), (n, total) in sums(vectors, books).items():
            new[p, e] = [t // n for t in total]
        books = Codebooks(new)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, code, error) and all other columns of rows (id, vector); the code has two hex digits for each part."""
    keep = [c for c in vectors.columns if c != "vector"]
    parts, _, width = books.entries.shape

    def run(batches):
        for table in _grouped(batches):
            index, far = books.assign(_matrix(table.column(len(keep)), parts * width))
            code = index.astype(np.uint8).tobytes().hex()
            code = [code[at : at + 2 * parts] for at in range(0, len(code), 2 * parts)]
            out = pa.table([*(table.column(c) for c in keep), pa.array(code, pa.string()), pa.array(far.sum(axis=1))], names=[*keep, "code", "error"])
            yield from out.combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    return vectors.select(*keep, "vector").mapInArrow(run, f"{schema}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``vector``, the entries that a code stands for, as the numbers that were scaled."""
    tables = [F.lit([e.tolist() for e in part]) for part in books.entries / SCALE]
    place = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.get(table, place(p)) for p, table in enumerate(tables)]))


def compress(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors of all rows of an equal label, nulls together), codebooks_sha256."""
    spark = rows.sparkSession
    path = shared_folder(spark)
    kept = rows.where(usable(F.col(vector), parts)).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), whole_numbers(F.col(vector)).alias("vector"))
    kept = stored(kept, path)
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(1).collect()
    size = len(first[0].vector) if first else parts
    kept = kept.where(F.size("vector") == size)
    books = fit(kept, size, parts, entries, rounds) if first else Codebooks(np.zeros((parts, 1, 1), np.int64))
    codes = stored(encode(kept, books))
    drop_stored(spark, path)
    per_label = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "equal"))
    joined = codes.join(per_label, F.col("label").eqNullSafe(F.col("equal")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    nearest = "assigned{0} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, far * 100 + entry) AS entry, min(far) AS far FROM (SELECT x.vec_id, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x)) AS far FROM components x JOIN book{0} b ON b.part = x.part AND b.place = x.place GROUP BY ALL) GROUP BY ALL)"
    mean = (
        "book{1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM book{0} b LEFT JOIN "
        "(SELECT x.part, a.entry, x.place, CAST(floor(CAST(sum(x.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM components x JOIN assigned{0} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL) m "
        "ON m.part = b.part AND m.entry = b.entry AND m.place = b.place)"
    )
    steps = ",\n".join(nearest.format(r) + ",\n" + mean.format(r, r + 1) for r in range(rounds))
    return f"""
WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS position, len(v) // {parts} AS width FROM kept),
components AS MATERIALIZED (SELECT vec_id, position // width AS part, position % width AS place, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM flat),
book0 AS MATERIALIZED (SELECT part, nth AS entry, place, x FROM components JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS nth FROM kept QUALIFY nth < {entries}) USING (vec_id)),
{steps},
{nearest.format(rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM assigned{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


#: The definition, round by round, with all distances.
SQL = _sql()
