"""Near-duplicate groups against brute force, and odd input."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from helpers import prose, table
from tallyspark.llm import neardup
from tallyspark.llm.text import text_slices


def shingle_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(words[j : j + size]) for j in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        sets[i] = sets.get(i, frozenset()) | shingle_set(t, size)
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if b < a and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(words, draw, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"x{draw.randrange(9999)}"
    return " ".join(words)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_groups(spark, odd, size, percent):
    draw = random.Random(size)
    rows = [r for r in dict(odd).items() if r[0] is not None]
    for group in range(6):
        base = prose(50 + group, 150).split()
        rows += [(100 + 20 * group + k, edited(base, draw, draw.randrange(6))) for k in range(15)]
    want = brute(rows, size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, rows), size, percent).collect()}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in neardup.near_duplicates(table(spark, rows), size, percent).collect())


def test_every_row_has_its_row(spark):
    """Rows without an id, rows that share one, ids at both ends of 64 bits: each row is judged by its own text."""
    low, high = -(1 << 63), (1 << 63) - 1
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = " ".join(a.split()[:-1])
    rows = [(None, a), (None, b), (None, b), (None, "x y z"), (high, c), (low, near), (5, "a b c"), (5, "x y z w"), (5, "a b c"), (7, c + " end"), (high, "other words here")]
    got = neardup.near_duplicates(table(spark, rows), 3, 85).collect()
    want = {(None, 58, low, False), (None, 58, None, True), (None, 1, None, True), (high, 58, 7, False), (low, 57, low, True), (5, 1, 5, True), (5, 2, 5, True), (7, 59, 7, True), (high, 1, high, True)}
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert sum(r.first for r in got if r.n_shingles == 58 and r.component_id is None) == 2  # equal rows are one document


def test_long_words_that_differ_in_structure(spark):
    """Strings on which polynomial hashes modulo 2**64 collide are different words."""
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(spark, [(1, one), (2, two)]), 3, 85).collect()}
    assert got == {1: 1, 2: 2}


def test_groups_without_links_are_cheap():
    """Texts of a common form in one block: few are compared, none is linked."""
    texts = [f"order number w{i} shipped w{i * 7} thanks for your shopping with us today" for i in range(3000)]
    ((_, _, data, offsets),) = text_slices(pa.array(texts), 1 << 30)
    found, cuts = neardup.shingles(data, offsets, 3)
    began = time.perf_counter()
    assert neardup.verified_links(np.arange(3000), found, cuts, neardup.registers(found, cuts), 85) == []
    assert time.perf_counter() - began < 2


def forms(n, own, seed=0, apart=False):
    """Texts of one form of 120 words with so many words of their own, in one stretch or each alone."""
    draw = random.Random(seed)
    base = [f"t{i}" for i in range(120)]
    out = []
    for i in range(n):
        text = list(base)
        if apart:
            for k in draw.sample(range(120), own):
                text[k] = f"o{i}x{k}"
        else:
            at = draw.randrange(3, 117 - own)
            text[at : at + own] = [f"o{i}x{k}" for k in range(own)]
        out.append(" ".join(text))
    return out


def sets_of(texts):
    ((_, _, data, offsets),) = text_slices(pa.array(texts), 1 << 30)
    found, cuts = neardup.shingles(data, offsets, 3)
    return found, cuts, neardup.registers(found, cuts)


@pytest.mark.parametrize("apart", [False, True])
def test_time_of_forms_just_below_the_threshold(apart):
    """Four times the texts take in proportion, also if all are a little less similar than is asked."""
    took = []
    for n in (1000, 4000, 16000):
        found, cuts, sketch = sets_of(forms(n, 5 if apart else 9, apart=apart))
        began = time.perf_counter()
        assert neardup.verified_links(np.arange(n), found, cuts, sketch, 85) == []
        took.append(time.perf_counter() - began)
    assert took[2] < 30 * took[0] + 0.5 and took[2] < 10


@pytest.mark.parametrize("own, apart, percent", [(7, False, 85), (8, False, 85), (9, False, 80), (2, True, 85), (3, True, 85), (4, True, 80), (12, False, 80)])
def test_forms_near_the_threshold(own, apart, percent):
    """Forms on both sides of the threshold, with words of their own or shared by a few or by many: the parts are those of all pairs."""
    texts = forms(60, own, own, apart) + [t.replace("o", "p") for t in forms(20, own + 1, 5, apart)] + [" ".join(t.split()[:110]) for t in forms(20, 2, 6)] + [t.replace("x1 ", "y ").replace("t50", "z") for t in forms(30, own, 7)]
    draw = random.Random(own)
    texts += [" ".join(f"s{draw.randrange(4)}" if draw.random() < 0.05 else w for w in forms(1, 0)[0].split()) for _ in range(60)]
    found, cuts, sketch = sets_of(texts)
    sets = [set(found[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[max(top(i), top(j))] = min(top(i), top(j))
    got = dict(neardup.verified_links(np.arange(len(texts)), found, cuts, sketch, percent))
    assert {i: got.get(i, i) for i in range(len(texts))} == {i: top(i) for i in range(len(texts))}


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 1500)
    draw = random.Random(8)
    base = prose(70, 150).split()
    rows = [(k, edited(base, draw, draw.randrange(1, 5))) for k in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("own, percent", [(4, 85), (9, 85), (9, 80)])
def test_several_blocks_of_a_form(spark, monkeypatch, own, percent):
    """A group of a form that takes many blocks: near copies in different blocks are found, whether they share rare words or common ones only."""
    monkeypatch.setattr(neardup, "BLOCK", 3000)
    monkeypatch.setattr(neardup, "COMMON", 8)
    texts = forms(120, own)
    draw = random.Random(own)
    texts += [edited(texts[draw.randrange(120)].split(), draw, 2) for _ in range(40)] + forms(20, 2, 4, apart=True)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, rows), 3, percent).collect()}
    assert got == brute(rows, 3, percent)


def test_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in neardup.near_duplicates(table(spark, odd), 5, 80).collect()}
    assert [rows[i].n_shingles for i in (4, 5, 6, 7)] == [0, 0, 0, 1]
    assert [rows[i].component_id for i in (1, 2, 3, 4, 5, 7, 8, 20)] == [1, 1, 1, 4, 5, 7, 7, 1]
    assert rows[None].component_id is None
    assert neardup.near_duplicates(table(spark, []), 5, 80).collect() == []


def test_likelihood():
    draw = random.Random(1)
    base = prose(90, 400).split()
    texts = [" ".join(base), *[edited(base, draw, e) for e in (5, 20, 60, 150)]]
    ((_, _, data, offsets),) = text_slices(pa.array(texts), 1 << 30)
    found, cuts = neardup.shingles(data, offsets, 3)
    sketch, sizes = neardup.registers(found, cuts), np.diff(cuts)
    guess = neardup.likely_similarity(sketch[0], sizes[0], sketch[1:], sizes[1:])
    sets = [set(found[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
    true = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert np.abs(guess - true).max() < 0.2
    assert neardup.may_be_similar(sketch[0], sizes[0], sketch[1:], sizes[1:], 0.5)[0].tolist() == [g > 0.5 for g in guess]


def test_sketches_merge():
    parts = [prose(1, 100), prose(2, 100)]
    ((_, _, data, offsets),) = text_slices(pa.array([*parts, parts[0] + "\n" + parts[1]]), 1 << 30)
    one = neardup.registers(*neardup.shingles(data, offsets, 1))
    assert (np.maximum(one[0], one[1]) == one[2]).all()
