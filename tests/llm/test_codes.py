"""Vector codes against a plain brute-force training, whatever the rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyspark.llm import codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("id", "vector", "code", "error", "part")]])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, parts=8, k=16, rounds=6):
    """All distances, in Python's whole numbers."""
    kept = sorted(((i, [math.floor(4096 * float(x)) for x in v], lab) for i, v, lab in rows if v and None not in v and all(map(math.isfinite, v))), key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:k]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assigned = lambda: [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [c[p] for c, f in zip(cut, found) if f[p][1] == j]
                if mine:
                    books[p][j] = [sum(xs) // len(mine) for xs in zip(*mine)]
    out = [(i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), lab) for (i, _, lab), f in zip(kept, assigned())]
    per = {}
    for *_, e, lab in out:
        per[lab] = per.get(lab, 0) + e
    import hashlib

    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, per[lab], digest) for i, c, e, lab in out), key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_brute_force(spark):
    """Ties, repeated vectors and ids, null labels, null and broken vectors, extra columns of clashing names."""
    draw = random.Random(1)
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(draw.gauss(0, 0.2)) for _ in range(16)], draw.choice([None, 0, 1])) for i in range(3, 150)]
    rows += [(i, [f(draw.choice([-0.25, 0.0, 0.25])) for _ in range(16)], 5) for i in range(200, 300)]  # many ties
    rows += [(i, rows[0][1], 1) for i in range(300, 340)] + [(200, rows[1][1], 2), (None, rows[2][1], None), (None, rows[3][1], 7)]
    bad = [(0, None, 1), (1, [f(0.5)] * 15 + [None], 1), (2, [math.nan] * 16, 1), (301, [math.inf] + [0.0] * 15, 1), (302, [0.0] * 15 + [-math.inf], None)]
    assert rows_of(codes.compress(table(spark, rows + bad))) == brute(rows)


def test_other_lengths(spark):
    """Vectors that can't be cut in equal parts, and those unlike the first, are dropped; so are empty ones."""
    draw = random.Random(2)
    rows = [(i, [float(draw.randrange(-4, 4)) for _ in range(8)], 0) for i in range(40)]
    odd = [(-1, [], 0), (-2, [1.0] * 7, 0), (-3, [1.0] * 9, 0), (50, [1.0] * 16, 0)]
    assert rows_of(codes.compress(table(spark, rows + odd))) == brute(rows)


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_rows_than_entries(spark, n):
    rows = [(i, [float(i)] * 8, None) for i in range(n)]
    assert rows_of(codes.compress(table(spark, rows))) == brute(rows)


def test_empty(spark):
    assert codes.compress(table(spark, [])).collect() == []
    assert codes.compress(table(spark, [(1, None, 1)])).collect() == []


def test_far_components(spark):
    """Components that no long could hold are cut."""
    out = codes.compress(table(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [40000.0] * 8, 1)])).collect()
    assert {r.vec_id: r.error for r in out} == {1: 0, 2: 0, 3: 0}


def test_partial_distances_find_the_nearest():
    draw = np.random.default_rng(3)
    for width in (1, 3, 8):
        for spread in (2, 1000, 1 << 27):
            values, entries = draw.integers(-spread, spread, (width, 500)), draw.integers(-spread, spread, (16, width))
            far = ((values.T[:, None, :] - entries[None]) ** 2).sum(axis=2)
            index, best = codes.nearest(values, entries)
            assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_order_is_by_variance():
    assert codes.order_of(np.array([[0, 5, -9, 1], [0, 6, 9, 1], [0, 5, 0, 3]])).tolist() == [2, 3, 1, 0]


def test_decode(spark):
    """Codes stand for the nearest entries: what is decoded is as far from the vectors as the error says."""
    draw = random.Random(4)
    rows = table(spark, [(i, [draw.randrange(-8192, 8192) / 4096 for _ in range(16)], 0) for i in range(60)])
    kept = rows.select("vec_id", codes.whole_numbers(rows.embedding).alias("vector")).withColumnRenamed("vec_id", "id")
    books = codes.fit(kept, 16)
    vectors = {r.id: r.vector for r in kept.collect()}
    for r in codes.decode(codes.encode(kept, books), books).collect():
        assert r.error == sum((round(a * 4096) - b) ** 2 for a, b in zip(r.vector, vectors[r.id]))
