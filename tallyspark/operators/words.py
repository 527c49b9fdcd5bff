"""Counts thousands of words and phrases in texts, in one pass over each text whatever their number.

An automaton (Aho-Corasick) of the wanted words is built once in each worker. It finds every
place where one ends; those that don't begin and end at a word's bound are left out. Case is
ignored for A to Z, and matches of the same word that overlap count once, from the left, as a
pattern with word bounds would count them.

Words go to the workers in groups of at most ``AT_ONCE``, one pass over the texts for each
group, so what is sent has a bound whatever their number.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wanted words in one automaton.
AT_ONCE = 100_000
_UPPER = {c: c + 32 for c in range(65, 91)}
_built: dict[str, object] = {}


def _in_word(c: str) -> bool:
    return c == "_" or (c.isascii() and c.isalnum()) or (not c.isascii() and unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"))


def _automaton(words: tuple[str, ...]):
    name = hashlib.sha256("\0".join(words).encode()).hexdigest()
    if name not in _built:
        import ahocorasick

        found = ahocorasick.Automaton()
        for word in words:
            found.add_word(word, word)
        found.make_automaton()
        _built.clear()  # a worker keeps the last one
        _built[name] = found
    return _built[name]


def occurrences_in(text: str, words: tuple[str, ...]) -> dict[str, int]:
    """How often a text has each of the words (lower-cased, not empty) that it has."""
    low = text.translate(_UPPER)
    last: dict[str, int] = {}
    counts: dict[str, int] = {}
    for end, word in _automaton(words).iter(low):
        start = end + 1 - len(word)
        before, after = low[start - 1] if start else "", low[end + 1] if end + 1 < len(low) else ""
        if start >= last.get(word, 0) and _bound(before, word[0]) and _bound(word[-1], after):
            last[word] = end + 1
            counts[word] = counts.get(word, 0) + 1
    return counts


def _bound(left: str, right: str) -> bool:
    """Whether there is a word's bound between two characters, or one and an end of the text."""
    return (left != "" and _in_word(left)) != (right != "" and _in_word(right))


def occurrences(rows: DataFrame, key: str, text: str, wanted: DataFrame, word: str = "word") -> DataFrame:
    """(key, word, times): how often each text has each wanted word that it has, words in lower case. Null texts have none; null and empty words are not wanted."""
    names = wanted.select(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word")).where("word <> ''").distinct()
    groups = max(1, -(-names.count() // AT_ONCE))
    kind = rows.schema[key].dataType.simpleString()
    out = None
    for group in range(groups):
        some = names if groups == 1 else names.where(F.pmod(F.xxhash64("word"), F.lit(groups)) == group)
        words = tuple(sorted(r.word for r in some.collect()))  # about AT_ONCE

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, found, times = [], [], []
                for i, content in enumerate(batch.column(1).to_pylist()):
                    if content and words:
                        for name, n in occurrences_in(content, words).items():
                            at.append(i)
                            found.append(name)
                            times.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=[key, "word", "times"])

        part = rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, word string, times long")
        out = part if out is None else out.unionByName(part)
    return out
