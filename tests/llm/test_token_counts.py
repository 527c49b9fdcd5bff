"""Token counts against the library."""

import os
import random

import public_tokenizers
import pytest

from helpers import prose, table
from tallyspark.llm import token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, rows):
    texts = [r[1] or "" for r in rows]
    found = library.encode_batch(texts, add_special_tokens=False)
    return sorted(((r[0], len(t.encode()), len(e.ids), len(e.ids) > 1024) for r, t, e in zip(rows, texts, found)), key=str)


def counted(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def odd_texts():
    draw = random.Random(5)
    characters = [chr(c) for c in (*range(9, 14), 32, 39, 133, 160, 0x2003, 0x558, 0x88F, 0xA7CE, 0x1F600, 0x301, 0x4E00, 0x3042, 0x660, 0xBD, 0xFFFD, 0)] + list("abcst'd.,!1290  \n")
    return ["".join(draw.choice(characters) for _ in range(draw.randrange(1, 60))) for _ in range(400)]


def test_same_as_the_library(spark, library, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(odd_texts())]
    assert counted(token_counts.count_tokens(table(spark, rows), PATH, PATTERN)) == expected(library, rows)


def test_special_tokens(spark, library):
    """Their content inside a text is one token and parts what stands around it."""
    end = "<|endoftext|>"
    texts = [end, end * 3, f"a {end}b", f"a{end} b", f"  {end}  ", "<|endoftext|", f"x'{end}s", f"{prose(1, 200)}{end}\n{prose(2, 200)}"]
    rows = list(enumerate(texts))
    assert counted(token_counts.count_tokens(table(spark, rows), PATH, PATTERN)) == expected(library, rows)


def test_many_stretches(spark, library, monkeypatch):
    """Any division into stretches and packs gives the same; words of all stretches meet."""
    monkeypatch.setattr(token_counts, "PACK", 100)
    monkeypatch.setattr(token_counts, "STRETCH", 3000)
    monkeypatch.setattr(token_counts, "LIST", 40)
    rows = [(i, prose(i % 7, 150 + i) + " zzyzxqq same") for i in range(120)]
    assert counted(token_counts.count_tokens(table(spark, rows), PATH, PATTERN)) == expected(library, rows)


def test_words_of_many_stretches(spark, library):
    """Equal words come together across Arrow batches; every stretch that has one gets its count."""
    rows = [(f"word{i % 50}zz", stretch, i % 50) for stretch in range(400) for i in range(50)]
    words = spark.createDataFrame([(w, s << token_counts.PLACE_BITS | p) for w, s, p in rows], "word string, at long")
    found = {(r.stretch, place): r.pieces for r in token_counts.pieces(words, PATH, PATTERN).collect() for place in r.places}
    assert found == {(s, p): len(library.encode(w).ids) for w, s, p in rows[:50] for s in range(400)}


def test_empty_and_extra_columns(spark):
    assert token_counts.count_tokens(table(spark, []), PATH, PATTERN).collect() == []
    assert counted(token_counts.count_tokens(table(spark, [(1, None), (None, ""), (1, None)]), PATH, PATTERN)) == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 0, 0, False)], key=str)


def test_long_text(spark, library):
    rows = [(1, "".join(chr(97 + i * i % 26) for i in range(300_000))), (2, prose(8, 200_000))]
    assert counted(token_counts.count_tokens(table(spark, rows), PATH, PATTERN)) == expected(library, rows)


def test_nothing_is_left(spark):
    token_counts.count_tokens(table(spark, [(1, "some text zzyq")]), PATH, PATTERN).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("frequencies_")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert counted(token_counts.count_tokens(docs, PATH, PATTERN)) == expected(library, rows)
