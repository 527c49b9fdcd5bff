"""Token counts of texts without their ids.

One pass over the texts cuts them into pre-tokens and keeps how often each document has
each: a *stretch* of documents (about ``STRETCH`` characters, one document at least) has one
list of its distinct pre-tokens, and its documents refer to places in that list. Then each distinct
pre-token of the whole table is counted once, by the library, where all stretches that
have it meet; the counts go back to the stretches, are joined to the documents' frequencies
and summed. Rows that are shuffled are one for each distinct pre-token of a stretch, and
their counts, packed: far fewer than the documents' pre-tokens. The frequencies stay where
they were written, in a table bucketed by stretch.

Pre-tokens that are entries of the vocabulary, whose number is fixed by its file, are counted
when a worker starts and added up at once.

The library's pre-tokenizer and Python's ``regex`` know different versions of Unicode. A
character is tried with both when a worker first meets it; a text with one on which they differ is cut by
the library, all others by the faster ``regex``.

Results for odd input: a null or empty text has no bytes and no tokens; ids may be null or
repeated, every row has its own result; the content of a special token inside a text is one token, as
the library has it, and parts what stands around it; an empty table gives no rows; other columns are
ignored. A text of any length is cut whole by one task, which holds its distinct pre-tokens. A
pre-token that every document has is one row from each stretch.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.frames import drop_stored, in_small_batches, shared_folder, stored

#: Characters of text after which a stretch ends.
STRETCH = 24_000_000
#: Pre-tokens of a stretch in one row at most.
LIST = 16_384
#: Counted pre-tokens that a task packs into rows at once.
PACK = 500_000
#: Bits of a place in a stretch (no text has more words), and of a stretch's number within its task; 22 are left for the task's.
PLACE_BITS, STRETCH_BITS = 29, 12

_FREQUENCIES = "stretch long, doc_id long, n_bytes long, n_tokens long, places array<int>, times array<int>, first int, words array<string>"


class Counts:
    """Cuts texts into pre-tokens and counts the tokens of a pre-token, as the library does with the file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        cut = form.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or form.get("normalizer"):
            raise ValueError("token counts need a byte-level pre-tokenizer without prefix space and without normalizer")
        added = form.get("added_tokens") or []
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("token counts need special tokens that stand for exactly their content")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pattern = regex.compile(pattern)
        longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.tried: set[str] = set(map(chr, range(128)))
        self.differ: set[str] = set()
        entries = [w for w in self.library.decode_batch([[i] for i in form["model"]["vocab"].values()], skip_special_tokens=False) if "�" not in w]
        entries = [w for w in set(entries) if w and self.cut(w) == [w]]
        self.entries = dict(zip(entries, self.count(entries)))

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if not text.isascii() and self._differs(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def _differs(self, text: str) -> bool:
        here = set(text)
        for c in here - self.tried:
            probe = f"a{c}1{c}!{c} {c} x"
            if [probe[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(probe)] != self.pattern.findall(probe):
                self.differ.add(c)
            self.tried.add(c)
        return not self.differ.isdisjoint(here)

    def pre_tokens(self, text: str) -> tuple[dict[str, int], int]:
        """How often a text has each pre-token, and how many special tokens it has."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        found = Counter(self.cut(parts[0]))
        for part in parts[1:]:
            found.update(self.cut(part))
        return found, len(parts) - 1

    def count(self, words: Sequence[str]) -> list[int]:
        """Numbers of tokens of pre-tokens."""
        return list(map(len, self.library.encode_batch_fast(list(words), add_special_tokens=False)))


_loaded: dict[tuple[str, str], Counts] = {}


def counts(path: str, pattern: str) -> Counts:
    """The counts of a tokenizer file; read once in each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Counts(path, pattern)
    return _loaded[path, pattern]


def frequencies(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Documents with how often they have each pre-token that is no entry of the vocabulary: places in the list
    of their stretch, which is in further rows: ``words`` from place ``first`` on (doc_id and n_bytes null). n_tokens
    counts the entries and special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts(path, pattern)
        entries = own.entries.get
        schema = pa.schema([("stretch", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("first", pa.int32()), ("words", pa.list_(pa.string()))])
        stretch, size = TaskContext.get().partitionId() << STRETCH_BITS, 0
        words: dict[str, int] = {}

        def words_of_stretch() -> Iterator[pa.RecordBatch]:
            every = list(words)
            for at in range(0, len(every), LIST):
                yield pa.RecordBatch.from_pylist([{"stretch": stretch, "first": at, "words": every[at : at + LIST]}], schema)

        for batch in batches:
            rows: list[dict] = []
            for doc_id, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = whole or ""
                found, n_tokens = own.pre_tokens(whole)
                places, times = [], []
                for word, n in found.items():
                    known = entries(word)
                    if known is not None:
                        n_tokens += n * known
                    else:
                        places.append(words.setdefault(word, len(words)))
                        times.append(n)
                rows.append({"stretch": stretch, "doc_id": doc_id, "n_bytes": len(whole.encode()), "n_tokens": n_tokens, "places": places, "times": times})
                size += len(whole)
                if size >= STRETCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    yield from words_of_stretch()
                    stretch, size, words, rows = stretch + 1, 0, {}, []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        yield from words_of_stretch()

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _FREQUENCIES)


def pieces(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(stretch, pieces, places): the places of a stretch's words that have so many tokens, from rows (word, at);
    ``at`` is the stretch and the place in its list as one number.

    Equal words come to one task one after the other, and are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts(path, pattern)
        last, last_count = None, 0
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            at, n = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((at, n, at >> PLACE_BITS))
            stretch, place, n = at[order] >> PLACE_BITS, (at[order] & ((1 << PLACE_BITS) - 1)).astype(np.int32), n[order]
            starts = np.flatnonzero(np.concatenate(([True], (stretch[1:] != stretch[:-1]) | (n[1:] != n[:-1]))))
            bounds = pa.array(np.append(starts, len(stretch)), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(stretch[starts]), pa.array(n[starts]), pa.ListArray.from_arrays(bounds, pa.array(place))], names=["stretch", "pieces", "places"])

        for batch in batches:
            if not batch.num_rows:
                continue
            encoded = batch.column(0).dictionary_encode()
            some = encoded.dictionary.to_pylist()
            new = [w for w in some if w != last]
            known = dict(zip(new, own.count(new)))
            if last is not None:
                known[last] = last_count
            n = np.array([known[w] for w in some], np.int32)[encoded.indices.to_numpy()]
            last = batch.column(0)[-1].as_py()
            last_count = known[last]
            held.append((batch.column(1).to_numpy(), n))
            size += len(n)
            if size >= PACK:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    together = words.repartition("word").sortWithinPartitions("word").select("word", "at")
    return together.mapInArrow(run, "stretch long, pieces int, places array<int>")


def _summed(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums the tokens of one stretch's documents."""
    documents = documents.filter(documents.column("n_bytes").is_valid()).combine_chunks()
    answers = answers.combine_chunks()
    places = answers.column("places").combine_chunks()
    per_word = np.zeros(len(places.flatten()), np.int64)
    per_word[places.flatten().to_numpy()] = np.repeat(answers.column("pieces").to_numpy(), places.value_lengths().to_numpy().astype(np.int64)) if answers.num_rows else []
    ends = np.cumsum(documents.column("places").combine_chunks().value_lengths().to_numpy().astype(np.int64))
    at, times = (documents.column(c).combine_chunks().flatten().to_numpy() for c in ("places", "times"))
    sums = np.concatenate(([0], np.cumsum(per_word[at] * times)))
    total = documents.column("n_tokens").to_numpy() + sums[ends] - sums[np.concatenate(([0], ends[:-1]))]
    return pa.table({"doc_id": documents.column("doc_id"), "n_bytes": documents.column("n_bytes"), "n_tokens": pa.array(total)})


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of each row of docs."""
    spark = docs.sparkSession
    name, folder = f"frequencies_{uuid.uuid4().hex}", shared_folder(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequencies(docs, path, pattern).write.bucketBy(buckets, "stretch").option("path", folder).option("compression", "zstd").format("parquet").saveAsTable(name)
    found = spark.table(name)
    words = found.where("words is not null").select(F.posexplode("words").alias("place", "word"), "stretch", "first").select("word", (F.shiftleft("stretch", PLACE_BITS) + F.col("first") + F.col("place")).alias("at"))
    answers = pieces(words, path, pattern)
    own = found.where("n_bytes is not null").select("stretch", "doc_id", "n_bytes", "n_tokens", "places", "times")
    joined = own.groupBy("stretch").cogroup(answers.groupBy("stretch")).applyInArrow(lambda d, a: _summed(d, a), "doc_id long, n_bytes long, n_tokens long")
    result = stored(joined)
    spark.sql(f"DROP TABLE {name}")
    drop_stored(spark, folder)
    return result.withColumn("over_limit", F.col("n_tokens") > limit)
