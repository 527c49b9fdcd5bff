"""Many words at once against a pattern for each."""

import random
import time

from pyspark.sql import functions as F

from tallyspark.operators import retrieval, words


def texts():
    draw = random.Random(1)
    parts = ["red", "Red", "RED", "reds", "a", "a b", "a b a b a", "café", "caf", "fé", "x_y", "x", "mix-up", "mix", "up", "ünd", "und", ".", "c++", "é", "1", "12", "\n", "Ⅷ"]
    return [("".join(draw.choice(parts) + draw.choice([" ", " ", "", "-"]) for _ in range(draw.randrange(0, 30)))) for _ in range(300)] + ["", "a", "c++ c++", "RED"]


WANTED = ["red", "A", "a b a", "caf", "café", "x_y", "x", "mix", "mix-up", "und", "1", "b", "Up", "nothing"]


def test_same_as_patterns(spark):
    """Each word's count is that of a pattern with word bounds, without case."""
    rows = spark.createDataFrame([*enumerate(texts()), (-1, None)], "id long, text string")
    got = {(r.id, r.word): r.times for r in words.occurrences(rows, "id", "text", spark.createDataFrame([(w,) for w in [*WANTED, "", None]], "word string")).collect()}
    counted = rows.select("id", *[F.regexp_count("text", F.lit(retrieval.word_pattern(w))).alias(w) for w in WANTED]).collect()
    assert got == {(r["id"], w.lower()): r[w] for r in counted for w in WANTED if r[w]}


def test_groups(spark, monkeypatch):
    """More words than go into one automaton: the same counts."""
    rows = spark.createDataFrame(list(enumerate(texts())), "id long, text string")
    wanted = spark.createDataFrame([(w,) for w in WANTED], "word string")
    whole = sorted(map(tuple, words.occurrences(rows, "id", "text", wanted).collect()))
    monkeypatch.setattr(words, "AT_ONCE", 4)
    assert sorted(map(tuple, words.occurrences(rows, "id", "text", wanted).collect())) == whole


def test_no_words(spark):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    assert words.occurrences(rows, "id", "text", spark.createDataFrame([], "word string")).collect() == []


def test_time_is_flat_in_the_number_of_words():
    draw = random.Random(2)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(60_000))
    few = tuple(sorted({"".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(10)}))
    many = tuple(sorted({"".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)} | set(few)))

    def seconds(wanted):
        words.occurrences_in("", wanted)  # builds it
        began = time.perf_counter()
        words.occurrences_in(text, wanted)
        return time.perf_counter() - began

    assert min(seconds(many) for _ in range(3)) < 20 * min(seconds(few) for _ in range(3))  # 2,000 times the words
