"""Approximate search by vectors: rows in cells of like direction, short codes in place of vectors, exact re-ranking.

Vectors count by their direction (cosine). A k-means over a bounded sample gives the cells and, over what is left
of the sample once each vector's cell is taken off, a small codebook for each part of a vector. A row
is stored in the folder of its nearest cell with its code and its vector; a query asks its
nearest cells only (``probes``), compares codes there, and compares exactly the best of those.

Cells stand on shelves of at most about ``ROWS`` rows; a query is sent once to each shelf that has cells it asks. Both
meet in groups of at most about ``ROWS`` rows and ``PROBES`` queries: large cells are cut by a hash of the row, often asked
shelves by a hash of the query, so that no group grows with the data. No query vector comes to the driver; what
does are the centres of cells (``cells`` vectors), codebooks, and how many rows and queries each cell has.

Each row also keeps how far its code is from its vector. With that the similarity has a lower and an
upper bound, and where no number of candidates is given, all rows whose upper bound reaches the
``limit``-th best lower bound of their group are compared there by their vectors in single precision, and what may
then be among the ``limit`` best of all groups is compared exactly: the result is exact over the
cells asked, and over all rows if all cells are.

Batches are added as segments of a versioned table (see ``sources.versions``), with the
cells and codebooks as they are. Null vectors, those of another length or direction zero, and those
with null or non-finite components are near to nothing and not stored; rows of a null key
are not stored either. Ties go to the smaller key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.sources.versions import Versions, new_folder

#: Rows of a shelf, and queries that ask it, which meet in one group at most (about: they are cut by hash).
ROWS, PROBES = 65_536, 4_096
#: Shelves are smaller where there would be fewer than so many, down to so many rows.
SHELVES, LEAST = 64, 1_024
#: Rows of the sample for k-means; cells at most; rounds of each k-means.
SAMPLE, MOST_CELLS, ROUNDS = 100_000, 4_096, 8
#: Sums of coordinates are added as whole numbers, so that centres don't depend on the order of rows.
GRID = 1 << 24
#: What rounding to single precision may add to a similarity.
SLACK = 1e-5


def _batches_of(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _units(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _nearest(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The index of the centre nearest to each row."""
    return (matrix @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def usable(vector: Column, size: int) -> Column:
    """Vectors of the given length with a direction, without null and non-finite components."""
    known = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == size) & known & F.exists(vector, lambda x: x != 0), F.lit(False))


class Quantiser:
    """Centres of cells, and a codebook for each part of what a vector has besides its cell's centre."""

    def __init__(self, centres: np.ndarray, codebooks: np.ndarray):
        self.centres, self.codebooks = centres, codebooks

    def padded(self, matrix: np.ndarray) -> np.ndarray:
        """Rows with zeros at the end, so that they can be cut into parts of equal length, as (rows, parts, width)."""
        parts, _, width = self.codebooks.shape
        return np.pad(matrix, ((0, 0), (0, parts * width - matrix.shape[1]))).reshape(len(matrix), parts, width)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and distance between what they stand for and the vector."""
        cell = _nearest(units, self.centres)
        rest = self.padded(units - self.centres[cell])
        code = np.stack([_nearest(rest[:, p], self.codebooks[p]) for p in range(rest.shape[1])], axis=1)
        left = rest - self.codebooks[np.arange(rest.shape[1]), code]
        return cell, code.astype(np.uint8), np.sqrt((left**2).sum(axis=(1, 2)))

    def probes(self, units: np.ndarray, n: int) -> np.ndarray:
        near = -(units @ self.centres.T - (self.centres**2).sum(axis=1) / 2)
        return np.argsort(near, axis=1, kind="stable")[:, :n]

    def similarities(self, cell: int, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of queries and rows of one cell, from a table of each part's entries."""
        table = np.einsum("qpw,pew->pqe", self.padded(queries), self.codebooks).astype(np.float32)
        out = np.repeat((queries @ self.centres[cell]).astype(np.float32)[:, None], len(codes), axis=1)
        for p in range(len(table)):
            out += table[p][:, codes[:, p]]
        return out


def _k_means(sample: DataFrame, start: np.ndarray, offset: np.ndarray | None = None) -> np.ndarray:
    """Centres of (parts, k, width) after ROUNDS passes over a sample of unit vectors; of what is left
    besides the nearest of ``offset``, if given. A centre that no row is nearest to stays."""
    parts, k, width = start.shape
    size = len(offset[0]) if offset is not None else parts * width
    centres = start
    for _ in range(ROUNDS):

        def run(batches, centres=centres):
            total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
            for batch in _batches_of(batches):
                rows = _matrix(batch.column(0), size)
                if offset is not None:
                    rows = rows - offset[_nearest(rows, offset)]
                rows = np.pad(rows, ((0, 0), (0, parts * width - size))).reshape(-1, parts, width)
                for p in range(parts):
                    near = _nearest(rows[:, p], centres[p])
                    count[p] += np.bincount(near, minlength=k)
                    np.add.at(total[p], near, np.rint(rows[:, p] * GRID).astype(np.int64))
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

        found = sample.select("unit").mapInArrow(run, "part int, entry int, n long, total array<long>")
        sums = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
        centres = centres.copy()
        for r in sums.collect():  # a row for each centre
            centres[r.part, r.entry] = np.array(r.total, np.float64) / GRID / r.n
    return centres


class VectorIndex:
    """Rows (key long, vector array<float>) of a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        self.state = self.versions.read()[1]
        saved = spark.read.parquet(f"{self.path}/centres").collect()  # bounded by cells and entries
        of = lambda kind: np.array([r["values"] for r in sorted((r for r in saved if r.kind == kind), key=lambda r: (r.part, r.entry))])
        books = of("code")
        self.quantiser = Quantiser(of("cell"), books.reshape(self.state["parts"], -1, books.shape[1]))

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, vector: str, size: int, cells: int | None = None, parts: int = 8, entries: int = 256) -> VectorIndex:
        """An index of vectors of ``size`` components. By default there are as many cells as the square root of the rows, MOST_CELLS at most."""
        spark = rows.sparkSession
        path = path.rstrip("/")
        known = cls._known(rows, key, vector, size)
        count = known.count()
        rate = min(1.0, SAMPLE / max(count, 1))
        order = F.xxhash64("key", F.lit(1))
        chosen = known.where(F.pmod(order, F.lit(1 << 20)) < int(rate * (1 << 20))).select("key", order.alias("order"), _unit_column())
        chosen.write.parquet(f"{path}/sample")
        sample = spark.read.parquet(f"{path}/sample")
        k = max(1, min(cells or round(count**0.5), MOST_CELLS, count))
        first = [r.unit for r in sample.orderBy("order", "key").limit(max(k, entries)).collect()] or [[0.0] * size]  # as many as cells or entries
        start = np.array(first, np.float64)
        centres = _k_means(sample, start[None, :k])[0]
        width = -(-size // parts)
        rest = start[:entries] - centres[_nearest(start[:entries], centres)]
        rest = np.pad(rest, ((0, 0), (0, parts * width - size))).reshape(-1, parts, width).transpose(1, 0, 2)
        books = _k_means(sample, rest, centres)
        saved = [("cell", 0, i, c.tolist()) for i, c in enumerate(centres)] + [("code", p, i, c.tolist()) for p, book in enumerate(books) for i, c in enumerate(book)]
        spark.createDataFrame(saved, "kind string, part int, entry int, values array<double>").coalesce(1).write.parquet(f"{path}/centres")
        versions = Versions(spark, path)
        versions.store.delete("sample")
        versions.commit(0, {"size": size, "parts": parts, "segments": {}})
        index = cls(spark, path)
        index.add(rows, key, vector)
        return index

    @staticmethod
    def _known(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
        cast = F.col(vector).cast("array<double>")
        return rows.where(F.col(key).isNotNull() & usable(cast, size)).select(F.col(key).cast("long").alias("key"), cast.alias("vector"))

    def add(self, rows: DataFrame, key: str, vector: str) -> None:
        """Stores a batch as one more segment. Its keys have to be new."""
        size, quantiser = self.state["size"], self.quantiser

        def run(batches):
            for batch in _batches_of(batches):
                cell, code, apart = quantiser.encode(_units(_matrix(batch.column(1), size)))
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(apart), pa.array(cell, pa.int32())], names=["key", "vector", "code", "apart", "cell"])

        coded = self._known(rows, key, vector, size).mapInArrow(run, "key long, vector array<double>, code binary, apart double, cell int")
        segment = uuid.uuid4().hex
        folder = f"{self.path}/data/{segment}"
        coded.hint("rebalance", "cell").sortWithinPartitions("cell", "key").write.partitionBy("cell").parquet(folder)
        if not any(n.startswith("cell=") for n in self.versions.store.names(f"data/{segment}")):
            return  # nothing to store
        sizes = self.spark.read.parquet(folder).groupBy("cell").count().collect()  # a row for each cell
        own = {segment: {str(r.cell): r["count"] for r in sizes}}
        self.state = self.versions.change(lambda state: {**state, "segments": {**state["segments"], **own}})

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """key, vector, code, apart, cell of all cells or some; only folders of those are read."""
        schema = "key long, vector array<double>, code binary, apart double, cell int"
        wanted = None if cells is None else set(map(str, cells))
        folders = [f"{self.path}/data/{s}/cell={c}" for s, sizes in self.state["segments"].items() for c in sizes if wanted is None or c in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders) if len(self.state["segments"]) == 1 else self._many(schema, wanted)

    def _many(self, schema: str, wanted: set[str] | None) -> DataFrame:
        out = None
        for segment, sizes in self.state["segments"].items():
            folders = [f"{self.path}/data/{segment}/cell={c}" for c in sizes if wanted is None or c in wanted]
            if folders:
                part = self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{segment}").parquet(*folders)
                out = part if out is None else out.unionByName(part)
        return out

    def _layout(self) -> list[tuple[int, int, int]]:
        """Cell, its shelf and how many shelves it has: small cells share one, rows of a large one are dealt to several of its own."""
        held: dict[int, int] = {}
        for sizes in self.state["segments"].values():
            for cell, n in sizes.items():
                held[int(cell)] = held.get(int(cell), 0) + n
        room = min(ROWS, max(LEAST, -(-sum(held.values()) // SHELVES)))
        out, shelf, used = [], 0, 0
        for cell in sorted(held):
            shards = -(-held[cell] // room)
            if used and used + held[cell] > room:
                shelf, used = shelf + 1, 0
            out.append((cell, shelf, shards))
            shelf, used = (shelf, used + held[cell]) if shards == 1 else (shelf + shards, 0)
        return out

    def search(self, queries: DataFrame, key: str, vector: str, limit: int = 10, probes: int = 8, candidates: int | None = None) -> DataFrame:
        """(query, key, similarity, nth): the ``limit`` rows nearest to each query, by cosine to nine decimals, among
        those of its ``probes`` nearest cells: the ``candidates`` best by code compared exactly, or as many as may be among the nearest."""
        size, quantiser = self.state["size"], self.quantiser
        probes = min(probes, len(quantiser.centres))
        asked = self._known(queries, key, vector, size)

        layout = self._layout()
        first, shards = (np.zeros(len(quantiser.centres), np.int64) for _ in range(2))
        for cell, shelf, n in layout:
            first[cell], shards[cell] = shelf, n

        def ask(batches):
            for batch in _batches_of(batches, 64):
                near = quantiser.probes(_units(_matrix(batch.column(1), size)), probes)
                times = shards[near.ravel()]
                row, cell = np.repeat(np.repeat(np.arange(len(near)), near.shape[1]), times), np.repeat(near.ravel(), times)
                shelf = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((cell, shelf, row))
                row, cell, shelf = row[order], cell[order], shelf[order]
                starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(shelf, prepend=-1) != 0))
                cells = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(cell, pa.int32()))
                rows = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(shelf[starts], pa.int32()), cells], names=["query", "asked", "shelf", "cells"])

        folder = new_folder(self.spark)
        asked.select(F.col("key").alias("query"), F.col("vector").alias("asked")).write.parquet(folder)
        asks = self.spark.read.parquet(folder)
        sent = asks.mapInArrow(ask, "query long, asked array<double>, shelf int, cells array<int>")
        told = sent.select("shelf", F.explode(F.array_append("cells", F.lit(-1))).alias("cell")).groupBy("shelf", "cell").count().collect()  # a row for each cell and shelf
        wanted = {r.cell for r in told}
        cut = F.broadcast(self.spark.createDataFrame([x for x in layout if x[0] in wanted], "cell int, first int, shards int"))  # a row for each cell
        often = F.broadcast(self.spark.createDataFrame([(r.shelf, -(-r["count"] // PROBES)) for r in told if r.cell < 0], "shelf int, blocks int"))  # a row for each shelf
        left = sent.join(often, "shelf").select("shelf", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int").alias("block"), "query", "asked", "cells")
        stored = self.rows(sorted(wanted - {-1}))
        shelf = (F.col("first") + F.pmod(F.xxhash64("key"), F.col("shards"))).cast("int").alias("shelf")
        unit = _unit_column() if candidates is None else F.lit(None).alias("unit")
        right = stored.join(cut, "cell").select(shelf, "cell", "key", "code", "apart", unit.cast("array<float>").alias("unit")).join(often, "shelf")
        right = right.select("shelf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cell", "key", "code", "apart", "unit")

        def compare(asks: pa.Table, rows: pa.Table) -> pa.Table:
            return _best(quantiser, size, asks.combine_chunks(), rows.combine_chunks(), limit, candidates)

        groups = ["shelf", "block"]
        near = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(compare, "cell int, query long, key long, low double, high double")
        order = Window.partitionBy("query").orderBy(F.desc("low"), "key")
        if candidates is None:
            every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            near = near.withColumn("least", F.nth_value("low", limit).over(every)).where(F.col("high") >= F.coalesce("least", F.lit(-2.0))).select("cell", "query", "key")
        else:
            near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= candidates).select("cell", "query", "key")
        vectors = asks.dropDuplicates(["query"]).select("query", "asked")
        exact = near.join(stored.select("cell", "key", "vector"), ["cell", "key"]).join(vectors, "query").select("query", "key", "asked", "vector").mapInArrow(_cosines(size), "query long, key long, similarity double")
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
        return exact.withColumn("nth", nth).where(F.col("nth") <= limit)


def _unit_column() -> Column:
    # the norm is a variable of the last step, so it is summed once for a row and not once for each component
    return F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x, lambda n: F.transform("vector", lambda x: x / F.sqrt(n))).alias("unit")


def _best(quantiser: Quantiser, size: int, asks: pa.Table, rows: pa.Table, limit: int, candidates: int | None) -> pa.Table:
    """Bounds of the similarity of the queries and rows of one group, for those that may be among the nearest. Without a number
    of candidates, what the codes leave is compared by its vectors in single precision, so that little more than ``limit`` rows are left."""
    found: list[tuple[np.ndarray, ...]] = []
    if asks.num_rows and rows.num_rows:
        rows = rows.sort_by("cell").combine_chunks()
        query, key, cell = asks.column("query").to_numpy(), rows.column("key").to_numpy(), rows.column("cell").to_numpy()
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(key), -1)
        apart = rows.column("apart").to_numpy().astype(np.float32) + np.float32(SLACK)
        units = rows.column("unit").combine_chunks().flatten().to_numpy().reshape(-1, size) if candidates is None else None
        cells, starts = np.unique(cell, return_index=True)
        ends = np.append(starts[1:], len(key))
        step = max(1, (1 << 22) // len(key))
        for at in range(0, len(query), step):
            some = asks.slice(at, step)
            own = _units(_matrix(some.column("asked").combine_chunks(), size))
            near = np.full((len(own), len(key)), -np.inf, np.float32)
            lists = some.column("cells").combine_chunks()
            who, what = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
            for c, a, b in zip(cells, starts, ends):
                asking = who[what == c]
                if len(asking):
                    near[asking, a:b] = quantiser.similarities(c, own[asking], codes[a:b])
            kth = len(key) - min(candidates or limit, len(key))
            if candidates is None:
                q, k = np.nonzero((near + apart >= np.partition(near - apart, kth, axis=1)[:, kth, None]) & (near > -np.inf))
                exact = _products(own.astype(np.float32), units, q, k)
                if len(key) > limit:
                    near[:] = -np.inf
                    near[q, k] = exact
                    keep = exact >= np.partition(near, kth, axis=1)[q, kth] - np.float32(2 * SLACK)
                    q, k, exact = q[keep], k[keep], exact[keep]
                low, high = exact - np.float32(SLACK), exact + np.float32(SLACK)
            else:
                k = np.argpartition(near, kth, axis=1)[:, kth:]
                q, k = np.repeat(np.arange(len(own)), k.shape[1]), k.ravel()
                q, k = (x[near[q, k] > -np.inf] for x in (q, k))
                low = high = near[q, k]
            found.append((cell[k], query[at + q], key[k], low.astype(np.float64), high.astype(np.float64)))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 2, *[np.zeros(0)] * 2]
    return pa.table([*map(pa.array, columns)], names=["cell", "query", "key", "low", "high"])


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of a and j of b: of all rows, where a good part of them is wanted."""
    if len(i) * 20 > len(a) * len(b):
        return (a @ b.T)[i, j]
    steps = range(0, len(i), 1 << 16)
    return np.concatenate([np.einsum("nw,nw->n", a[i[at : at + (1 << 16)]], b[j[at : at + (1 << 16)]]) for at in steps]) if len(i) else np.zeros(0, np.float32)


def _cosines(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches_of(batches, 2048):
            a, b = (_matrix(batch.column(c), size) for c in (2, 3))
            cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.rint(cosine * 1e9) / 1e9)], names=["query", "key", "similarity"])

    return run
