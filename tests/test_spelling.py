"""Nearest names against all distances."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def some_names(n, seed, longest=14, letters="abcé"):
    draw = random.Random(seed)
    out = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, longest))) for _ in range(n)]
    for name in out[: n // 2]:  # and some close ones
        chars = list(name)
        for _ in range(draw.randrange(1, 4)):
            at = draw.randrange(len(chars) + 1)
            chars[at : at + draw.randrange(2)] = draw.choice([[], ["a"], ["x"]])
        out.append("".join(chars))
    return out


def frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 9])
def test_within(spark, radius):
    """Any radius, short and empty names, letters of two bytes: no pair is lost."""
    names, asked = set(some_names(150, radius)), set(some_names(40, radius + 100) + ["", "a"])
    got = {(r.query, r.name, r.distance) for r in spelling.within(frame(spark, names), frame(spark, asked).withColumnRenamed("name", "query"), "name", radius).collect()}
    assert got == {(q, n, distance(q, n)) for q in asked for n in names if distance(q, n) <= radius}


def brute(names, asked, limit):
    return {(q, n, d, k) for q in asked for k, (d, n) in enumerate(sorted((distance(q, n), n) for n in names if n != q)[:limit], 1)}


@pytest.mark.parametrize("limit", [1, 5])
def test_nearest(spark, limit, monkeypatch):
    names = set(some_names(120, 7, 24) + ["far from " + "z" * 40])
    asked = set(some_names(20, 8, 24) + ["y" * 50, *list(names)[:10]])
    for widest in (16, 2):  # by pieces, and mostly against all
        monkeypatch.setattr(spelling, "WIDEST", widest)
        monkeypatch.setattr(spelling, "TOGETHER", 7)
        got = spelling.nearest_spellings(frame(spark, [*names, *names, None]), frame(spark, [*asked, None]), "name", limit)
        assert {tuple(r) for r in got.collect()} == brute(names, asked, limit)


def test_fewer_names_than_asked(spark):
    got = spelling.nearest_spellings(frame(spark, ["ab", "b"]), frame(spark, ["ab", "q"]), "name", 5)
    assert {tuple(r) for r in got.collect()} == brute(["ab", "b"], ["ab", "q"], 5)


def test_empty(spark):
    none = frame(spark, [])
    assert spelling.nearest_spellings(none, frame(spark, ["a"]), "name").collect() == []
    assert spelling.nearest_spellings(frame(spark, ["a"]), none, "name").collect() == []


def test_no_nested_loop(spark, capsys):
    """The plan joins by equal pieces."""
    spelling.within(frame(spark, some_names(50, 1)), frame(spark, ["abc"]).select(F.col("name").alias("query")), "name", 2).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "HashJoin" in plan + "HashJoin" * ("SortMergeJoin" in plan)


def test_names_that_share_pieces(spark):
    """Numbers of one width with the same word: a query meets names that are near it, not all that have its word or leading zeros."""
    names = [f"{331 * i:09d} BUILDING" for i in range(3000)]
    asked = names[::300]
    short = spelling.variants(frame(spark, names), "name", 2).withColumnRenamed("name", "near")
    met = spelling.variants(frame(spark, asked), "name", 2).join(short, "form").select("name", "near").distinct().count()
    assert met < len(asked) * len(names) / 20
    got = {tuple(r) for r in spelling.within(frame(spark, names), frame(spark, asked).withColumnRenamed("name", "query"), "name", 2).collect()}
    assert got == {(q, n, d) for q in asked for n in names if (d := distance(q, n)) <= 2}


def test_short_and_long_names(spark, monkeypatch):
    """Names on both sides of the length up to which forms are used; no pair is lost or twice."""
    monkeypatch.setattr(spelling, "VARIANTS", 40)
    assert spelling.longest_varied(2) == 8
    names, asked = set(some_names(150, 21)), set(some_names(40, 22) + [""])
    got = sorted(tuple(r) for r in spelling.within(frame(spark, names), frame(spark, asked).withColumnRenamed("name", "query"), "name", 2).collect())
    assert got == sorted((q, n, distance(q, n)) for q in asked for n in names if distance(q, n) <= 2)
