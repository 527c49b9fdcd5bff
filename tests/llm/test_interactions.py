"""Filter interactions against the definition: every order applied, document by document."""

import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import prose
from tallyspark.llm import interactions

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(n, T.StringType()) for n in ("part", "mask", "digest", "first", "good", "toxic", "documents")]])
LABELS = "doc_id long, quality int, toxic int, good string, mask string"


def audit(spark, docs, labels, **more):
    conditions = interactions.failures(F.coalesce("text", F.lit("")))
    frame = interactions.audit(spark.createDataFrame([(*d, *["x"] * 7) for d in docs], DOCS), spark.createDataFrame([(*x, "x", "x") for x in labels], LABELS), conditions, repeated="E", **more)
    return sorted(map(tuple, frame.collect()))


def brute(docs, labels):
    def fails(doc_id, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A"} if len(words) < 50 else set()
        out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        return out | ({"E"} if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs) else set())

    parts = {}
    for i, t, s in docs:
        mark = [any(x[0] == i and i is not None and x[k] == 1 for x in labels) for k in (1, 2)]
        parts.setdefault(s or "", []).append((fails(i, t or ""), *mark))
    out = []
    for part, rows in parts.items():
        mine, worth = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left_after = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                failing = [r for r in rows if f in r[0]]
                worth[f] += len(gone)
                mine.append((part, "".join(order), step, len(left_after), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
                left = left_after
        out += [(*m[:-1], worth[m[-1]]) for m in mine]
    return sorted(out)


def corpus():
    draw = random.Random(7)
    docs = []
    for i in range(160):
        text = prose(i, draw.choice([0, 1, 49, 50, 51, 120]), draw.choice([20, 5000]))
        text = text.upper() if draw.random() < 0.2 else text
        text += draw.choice(["", "", " a|b", " 100 %", "\n#", "\x0b\x0c \r"])
        docs.append((i, text, draw.choice(["a", "b", "b", "", None, "é"])))
    docs += [(200 + i, draw.choice(docs[:20])[1], draw.choice(["a", "c", None])) for i in range(60)]  # copies
    docs += [(300, None, "a"), (301, "", "b"), (302, None, None), (None, docs[3][1], "a"), (None, docs[3][1], "a"), (None, None, None), (5, docs[5][1], "b"), (5, "other", "b"), (2, docs[2][1], docs[2][2])]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    return docs, labels


def test_brute_force(spark):
    docs, labels = corpus()
    assert audit(spark, docs, labels) == brute(docs, labels)


def test_edges(spark):
    """Exactly 50 words, 65 %, 5 % pass; one less or more fails."""
    docs = [(1, " ".join(f"w{i}" for i in range(50)), "s"), (2, " ".join(f"w{i}" for i in range(49)), "s"), (3, " ".join(f"v{i % 65}" for i in range(100)), "s"), (4, " ".join(f"v{i % 64}" for i in range(100)), "s"), (5, "A" + "a" * 19, "t"), (6, "A" + "a" * 18, "t"), (7, "É" + "😀" * 18 + "A", "t"), (8, "x" * 100_000 + "|", "t")]
    assert audit(spark, docs, []) == brute(docs, [])


def test_empty(spark):
    assert audit(spark, [], [(1, 1, 1)]) == []


def test_equal_texts_in_many_parts(spark):
    """One text on most rows: only the smallest id passes."""
    docs = [(i, "same", f"s{i % 40}") for i in range(3000)] + [(i, f"other {i}", "s1") for i in range(3000, 3100)]
    out = audit(spark, docs, [])
    first = [r for r in out if r[1] == "EABCD" and r[2] == 1]
    assert sum(r[3] for r in first) == 101 and sum(r[4] for r in first) == 2999 and len(out) == 40 * 600


def test_many_parts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(interactions, "PARTS", 3)
    docs = [(i, prose(i, 60), f"s{i}") for i in range(20)]
    assert audit(spark, docs, []) == brute(docs, [])


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_polynomial(n):
    """Corners are counts of removed documents; integrals are the averages over all orders."""
    counts = np.random.default_rng(n).integers(0, 50, (3, 1 << n))
    polynomial = interactions.removal_polynomial(counts)
    corners = interactions.at_corners(polynomial)
    masks = range(1 << n)
    assert corners.tolist() == [[int(sum(row[m] for m in masks if m & s)) for s in masks] for row in counts]
    if n > 5:
        return
    for row, p in zip(counts, polynomial):
        for i in range(n):
            total = 0
            orders = list(permutations(range(n)))
            for order in orders:
                before = sum(1 << j for j in order[: order.index(i)])
                total += sum(int(row[m]) for m in masks if m >> i & 1 and not m & before)
            assert interactions.diagonal_integral(p, 1 << i) == Fraction(total, len(orders))
