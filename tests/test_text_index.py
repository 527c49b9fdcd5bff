"""The text index against the scan and against the definition of phrases and scores."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import retrieval, text_index
from tallyspark.operators.text_index import Part, TextIndex, parse
from tallyspark.sources.versions import Conflict, new_folder

WORDS = ["red", "blue", "green", "small", "large", "shoe", "hat", "the", "of", "rare1", "rare2"]


def texts(n=400, seed=1):
    draw = random.Random(seed)
    weights = [5, 4, 3, 3, 2, 2, 2, 30, 20, 0.05, 0.05]
    out = [(i, " ".join(draw.choices(WORDS, weights, k=draw.randrange(0, 30)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "Red-BLUE, red! (small)"), (None, "red blue"), (n + 3, "é red ünd blue")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(texts(), "id long, text string").cache()


@pytest.fixture(scope="module")
def index(spark, rows):
    return TextIndex.build(rows, new_folder(spark), "id", "text", shelves=8, block=32)


QUERIES = ["red", "red blue", "red OR blue", "red small OR blue hat", "nothing", "the nothing OR rare1", "rare1 rare2", "THE of", "", "OR"]


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_the_scan(rows, index, query):
    got = sorted((r.id, r.text, r.matched_terms) for r in index.full_text(rows, "id", query).collect())
    want = [] if not retrieval.parse_terms(query) else sorted((r.id, r.text, r.matched_terms) for r in retrieval.full_text(rows.where("id is not null"), "text", query).collect())
    assert got == want


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def stands(words, part):
    def ends(at, rest):
        return [at] if not rest else [e for j in range(at + 1, len(words)) if words[j] == rest[0] for e in ends(j, rest[1:])]

    return any(e - i <= len(part.words) - 1 + part.slack for i, w in enumerate(words) if w == part.words[0] for e in ends(i, part.words[1:]))


def meets(text, query):
    return any(all(stands(tokens(text), p) for p in parts) for parts in parse(query))


@pytest.mark.parametrize("query", ['"red blue"', '"the red"~2', '"red red"', '"red blue small"~3 OR "hat shoe"', '"blue" red', '"of the red" the', '"red OR blue"'])
def test_phrases(rows, index, query):
    want = sorted(i for i, t in texts() if i is not None and meets(t, query))
    assert sorted(r.key for r in index.match(query).collect()) == want and (want or "OR" in query)


def test_parse():
    assert parse('red "New York"~2 OR x-ray') == [[Part(("red",)), Part(("new", "york"), 2)], [Part(("x",)), Part(("ray",))]]
    assert parse('"a OR b"') == [[Part(("a", "or", "b"))]] and parse(" ") == []


def bm25(rows, query, limit, among=None):
    docs = {i: tokens(t) for i, t in rows if i is not None}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    words = sorted({w for parts in parse(query) for p in parts for w in p.words})
    df = {w: sum(w in d for d in docs.values()) for w in words}
    score = {}
    for i, t in rows:
        if i is not None and meets(t, query) and (among is None or i in among):
            d = docs[i]
            score[i] = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / average)) for w in words if w in d)
    return sorted(((-round(s, 9), i) for i, s in score.items()))[:limit]


@pytest.mark.parametrize("query", ["red blue OR hat", "the", '"red blue"', "rare1 OR rare2", "red nothing OR of", "nothing"])
@pytest.mark.parametrize("limit", [3, 25])
def test_top(index, monkeypatch, query, limit):
    for first in (1, 64):
        monkeypatch.setattr(text_index, "FIRST", first)
        got = [(-round(r.score, 9), r.key) for r in index.top(query, limit).orderBy("nth").collect()]
        assert got == bm25(texts(), query, limit)


def test_top_among(spark, rows, index):
    got = [(-round(r.score, 9), r.key) for r in index.top("red OR blue", 10, rows.where("id % 3 = 0").select(F.col("id").alias("key"))).orderBy("nth").collect()]
    assert got == bm25(texts(), "red OR blue", 10, set(range(0, 500, 3)))


def test_blocks_are_left(spark, monkeypatch):
    """Once some rows score high, blocks that can't reach them are not unpacked."""
    monkeypatch.setattr(text_index, "FIRST", 2)
    rows = [(i, "word " + "filler " * 60) for i in range(2000)] + [(i, "word word word") for i in range(2000, 2010)]
    index = TextIndex.build(spark.createDataFrame(rows, "id long, text string"), new_folder(spark), "id", "text", block=16)
    seen, of_blocks = [], TextIndex._rows

    def noted(self, alternatives, blocks, among=None):
        seen.append(blocks.count())
        return of_blocks(self, alternatives, blocks, among)

    monkeypatch.setattr(TextIndex, "_rows", noted)
    got = [r.key for r in index.top("word", 3).orderBy("nth").collect()]
    assert got == [2000, 2001, 2002] and seen[0] == 2 and seen[1] < 20 < 100 <= index.postings("word").count()


def test_batches_and_merge(spark, rows):
    """The same rows and scores whether all texts came at once, in batches, or in batches that were merged."""
    path = new_folder(spark)
    index = TextIndex.build(rows.where("id < 100"), path, "id", "text", shelves=4, block=16)
    index.add(rows.where("id between 100 and 250"), "id", "text")
    index.add(rows.where("id > 250"), "id", "text")
    index.add(rows.where("id > 9999"), "id", "text")
    for step in range(2):
        again = TextIndex(spark, path)
        assert len(again.state["segments"]) == (3, 1)[step]
        assert [(-round(r.score, 9), r.key) for r in again.top('"red blue" OR hat', 20).orderBy("nth").collect()] == bm25(texts(), '"red blue" OR hat', 20)
        assert sorted(r.key for r in again.match("red blue").collect()) == sorted(i for i, t in texts() if i is not None and meets(t, "red blue"))
        again.merge()
    assert index.versions.clear({*TextIndex(spark, path).state["segments"]}, older_than=0.0)
    assert sorted(r.key for r in TextIndex(spark, path).match("red").collect()) == sorted(i for i, t in texts() if i is not None and "red" in tokens(t))


def test_merge_against_another_merge(spark, rows):
    """Of two merges of the same segments the second is refused and leaves the first as it is."""
    path = new_folder(spark)
    one = TextIndex.build(rows.where("id < 50"), path, "id", "text")
    one.add(rows.where("id between 50 and 99"), "id", "text")
    other = TextIndex(spark, path)
    one.merge()
    with pytest.raises(ValueError):
        other.merge()
    assert TextIndex(spark, path).match("the").count() == sum("the" in tokens(t) for i, t in texts() if i is not None and i < 100)


def test_empty(spark):
    index = TextIndex.build(spark.createDataFrame([], "id long, text string"), new_folder(spark), "id", "text")
    assert index.match("red").collect() == [] and index.top("red").collect() == []
    with pytest.raises(Conflict):
        TextIndex.build(spark.createDataFrame([], "id long, text string"), index.path, "id", "text")


def test_rare_words_read_less(spark):
    """Bytes that a query's scan reads fall with the word's rarity."""
    draw = random.Random(5)
    rows = [(i, " ".join(["common", *(f"w{draw.randrange(3000)}" for _ in range(30)), *(["single"] if i == 7 else [])])) for i in range(5000)]
    index = TextIndex.build(spark.createDataFrame(rows, "id long, text string"), new_folder(spark), "id", "text")

    def read(word):
        group = f"read {word}"
        spark.sparkContext.setJobGroup(group, group)
        index.postings(word).select(F.sum(F.size("entries"))).collect()
        store, tracker = spark._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
        stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
        spark.sparkContext.setJobGroup("", "")
        return sum(store.lastStageAttempt(s).inputBytes() for s in stages)

    files = sum(index.versions.store._store.getFileStatus(index.versions.store._fs.Path(f)).getLen() for f in index._read(None).inputFiles())
    assert 0 < read("single") < read("common") < files / 2


def test_block_is_one_row_for_a_word(spark, rows, index, monkeypatch):
    """Texts are inverted within their block: no row for each word of each text is shuffled. Parts of a block, where texts are long, give the same rows."""
    stored = index.postings("red", "the").collect()
    assert len(stored) == len({(r.term, r.block) for r in stored})
    plan = index._inverted(rows.where("id is not null").selectExpr("id AS key", "split(text, ' ') AS words", "id % 4 AS block"))._jdf.queryExecution().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 0
    inverted = text_index._postings

    def small(held):
        assert sum(len(w) for b in held for w in b.column(1).to_pylist()) <= 40 or sum(b.num_rows for b in held) == 1
        return inverted(held)

    monkeypatch.setattr(text_index, "TOKENS", 40)
    monkeypatch.setattr(text_index, "_postings", small)
    cut = TextIndex.build(rows, new_folder(spark), "id", "text", shelves=2, block=200)
    entries = lambda i: sorted((r.term, e.key, e.size, tuple(e.positions)) for r in i.postings(*WORDS).collect() for e in r.entries)
    assert entries(cut) == entries(index)
    for query in ("red blue OR hat", "the"):
        assert [(-round(r.score, 9), r.key) for r in cut.top(query, 25).orderBy("nth").collect()] == bm25(texts(), query, 25)
