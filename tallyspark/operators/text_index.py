"""An inverted index over texts: which rows have a word, how often, and where.

A posting row holds a word's entries in one block of rows: keys, lengths of their texts and the word's
positions there, with the block's greatest frequency and least length beside them. Rows are dealt
to blocks of about ``BLOCK`` rows by a hash of their key, so an entry list has a bound
however common the word is. Postings are stored by shelf (a hash of the word) and sorted by word: a
query opens the shelves of its words, and there the pages that can hold them.

Words, queries and results are those of the scan (``retrieval.full_text``): the index gives the same
rows and numbers of matched words. Beyond these a query can hold phrases, ``"blue suede"``, and words that
stand in this order with at most so many others between, ``"blue shoes"~2``. Blocks that lack a word
which every alternative needs are left before their entries are unpacked. ``top`` ranks by
BM25 and leaves blocks whose best possible score is below what is already found.

Batches are added as segments of a versioned table (``sources.versions``) and merged into one by ``merge``;
keys of a batch have to be new. Rows of a null key are not stored; a null text has no words.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators.retrieval import words_of
from tallyspark.sources.versions import Versions

#: Rows of a block, about; folders of postings; blocks that a ranked search looks at first.
BLOCK, SHELVES, FIRST = 1024, 64, 64
#: Words that are inverted at once, about.
TOKENS = 1 << 21
#: The usual weights of BM25.
K1, B = 1.2, 0.75

_POSTINGS = "term string, block long, n int, most long, least int, entries array<struct<key: long, size: int, positions: array<int>>>, shelf int"


@dataclass(frozen=True)
class Part:
    """A word, or several in this order with at most ``slack`` others between."""

    words: tuple[str, ...]
    slack: int = 0


def parse(query: str) -> list[list[Part]]:
    """Alternatives (OR) of parts that must all be there. Quotes hold a phrase, ~n after them allows n words between."""
    out = []
    for alternative in re.split(r'\s+OR\s+(?=(?:[^"]*"[^"]*")*[^"]*$)', query):
        parts = []
        for quoted, slack, plain in re.findall(r'"([^"]*)"(?:~(\d+))?|([^"\s]+)', alternative):
            found = re.findall("[a-z0-9]+", (quoted or plain).lower())
            if quoted and len(found) > 1:
                parts.append(Part(tuple(found), int(slack or 0)))
            else:
                parts += [Part((w,)) for w in found]
        if parts:
            out.append(parts)
    return out


def shelf_of(word: str, shelves: int) -> int:
    return zlib.crc32(word.encode()) % shelves


def together(positions: list[Column], slack: int) -> Column:
    """Whether words stand in order with at most ``slack`` others between: from each place of the first, the next place of each other."""

    def end(start: Column) -> Column:
        return reduce(lambda last, places: F.array_min(F.filter(places, lambda x: x > last)), positions[1:], start)

    return F.exists(positions[0], lambda start: F.coalesce(end(start) - start <= len(positions) - 1 + slack, F.lit(False)))


def _postings(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each word of (key, words, block) of one block: entries by key, with positions in order."""
    table = pa.Table.from_batches(held)
    keys, block = table.column("key").to_numpy(), table.column("block")[0].as_py()
    words = table.column("words").combine_chunks()
    sizes = words.value_lengths().to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(keys)), sizes)
    position = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(code, kind="stable")  # rows come by key
    code, row, position = code[order], row[order], position[order]
    entry = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    of, times = row[entry], np.diff(np.append(entry, len(row)))
    term = np.flatnonzero(np.diff(code[entry], prepend=-1) != 0)
    n = np.diff(np.append(term, len(entry)))
    positions = pa.ListArray.from_arrays(pa.array(np.append(entry, len(row)), pa.int32()), pa.array(position, pa.int32()))
    entries = pa.StructArray.from_arrays([pa.array(keys[of]), pa.array(sizes[of], pa.int32()), positions], ["key", "size", "positions"])
    most = np.maximum.reduceat(times, term) if len(term) else times
    least = np.minimum.reduceat(sizes[of], term) if len(term) else times
    columns = [coded.dictionary.take(pa.array(code[entry][term])), pa.array(np.full(len(term), block, np.int64)), pa.array(n, pa.int32()), pa.array(most, pa.int64()), pa.array(least, pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.append(term, len(entry)), pa.int32()), entries)], names=["term", "block", "n", "most", "least", "entries"])


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        self.state = self.versions.read()[1]

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, text: str, shelves: int = SHELVES, block: int = BLOCK) -> TextIndex:
        index = cls(rows.sparkSession, path)
        index.versions.commit(0, {"shelves": shelves, "block": block, "segments": {}})
        index.state = index.versions.read()[1]
        index.add(rows, key, text)
        return index

    def add(self, rows: DataFrame, key: str, text: str) -> None:
        """Stores a batch as one more segment."""
        known = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), words_of(F.coalesce(F.col(text), F.lit(""))).alias("words"))
        docs, total = known.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
        self._store(self._inverted(known.withColumn("block", self._block(docs))), docs, total, [])

    def _inverted(self, rows: DataFrame) -> DataFrame:
        """Postings of (key, words, block). Rows of a block follow each other in one task, which inverts them by parts of at most
        ``TOKENS`` words or of one longer text; a block of very long texts has several rows for a word."""
        spark = self.spark
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        dealt = rows.repartition(tasks, "block").sortWithinPartitions("block", "key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            block, tokens = None, 0
            for batch in batches:
                number = batch.column(2).to_numpy()
                sizes = batch.column(1).value_lengths().to_numpy()
                at = 0
                for end in [*(np.flatnonzero(np.diff(number)) + 1), len(number)]:
                    if number[at] != block:
                        if held:
                            yield _postings(held)
                        held, block, tokens = [], number[at], 0
                    while at < end:
                        fits = int(np.searchsorted(np.cumsum(sizes[at:end]), TOKENS - tokens, "right")) or int(not held)
                        if fits:
                            held.append(batch.slice(at, fits))
                            tokens += int(sizes[at : at + fits].sum())
                            at += fits
                        if at < end:
                            yield _postings(held)
                            held, tokens = [], 0
            if held:
                yield _postings(held)

        found = dealt.select("key", "words", "block").mapInArrow(run, _POSTINGS.removesuffix(", shelf int"))
        return found.withColumn("shelf", F.pmod(F.crc32("term"), F.lit(self.state["shelves"])).cast("int"))

    def _block(self, docs: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(max(1, -(-docs // self.state["block"]))))

    def _put(self, tokens: DataFrame, docs: int, total: int, replaced: list[str]) -> None:
        """Stores (term, block, key, size, position) as a segment in place of others."""
        per_row = tokens.repartition("term", "block").groupBy("term", "block", "key").agg(F.max("size").alias("size"), F.sort_array(F.collect_list("position")).alias("positions"))
        entries = F.sort_array(F.collect_list(F.struct("key", "size", "positions"))).alias("entries")  # a block has a bound
        found = per_row.groupBy("term", "block").agg(F.count("*").cast("int").alias("n"), F.max(F.size("positions").cast("long")).alias("most"), F.min("size").alias("least"), entries)
        shelf = F.pmod(F.crc32("term"), F.lit(self.state["shelves"])).cast("int")
        self._store(found.withColumn("shelf", shelf), docs, total, replaced)

    def _store(self, found: DataFrame, docs: int, total: int, replaced: list[str]) -> None:
        """Writes postings as a segment and takes it over in place of others."""
        segment = uuid.uuid4().hex
        sorted_rows = found.hint("rebalance", "shelf").sortWithinPartitions("shelf", "term", "block")
        sorted_rows.write.partitionBy("shelf").option("parquet.page.size", 1 << 16).option("parquet.page.row.count.limit", 512).parquet(f"{self.path}/data/{segment}")
        own = {segment: {"docs": docs, "words": total}} if docs else {}

        def changed(state: dict) -> dict:
            if not set(replaced) <= set(state["segments"]):
                raise ValueError("a segment that was merged is no longer there")
            return {**state, "segments": {**{s: v for s, v in state["segments"].items() if s not in replaced}, **own}}

        self.state = self.versions.change(changed)

    def merge(self) -> None:
        """Makes one segment of all there are, with blocks for all their rows."""
        merged = dict(self.state["segments"])
        if len(merged) < 2:
            return
        docs, total = (sum(s[c] for s in merged.values()) for c in ("docs", "words"))
        entry = self._read(None).select("term", F.explode("entries").alias("e")).select("term", "e.*")
        tokens = entry.select("term", "key", "size", F.explode("positions").alias("position"))
        self._put(tokens.withColumn("block", self._block(docs)), docs, total, list(merged))

    def _read(self, words: list[str] | None) -> DataFrame:
        """Postings of some words or of all, with their segment."""
        out = self.spark.createDataFrame([], _POSTINGS + ", segment string")
        for segment in self.state["segments"]:
            frame = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/data/{segment}")
            if words is not None:
                frame = frame.where(F.col("shelf").isin([shelf_of(w, self.state["shelves"]) for w in words]) & F.col("term").isin(words))
            frame = frame.withColumn("segment", F.lit(segment))
            out = frame if len(self.state["segments"]) == 1 else out.unionByName(frame)
        return out

    def postings(self, *words: str) -> DataFrame:
        return self._read(sorted(set(words)))

    def _blocks(self, alternatives: list[list[Part]], weight: dict[str, float] | None = None) -> DataFrame:
        """(segment, block, bound): blocks in which an alternative can be met, and the best score there can be."""
        words = sorted({w for parts in alternatives for p in parts for w in p.words})
        bound = F.lit(0.0)
        if weight is not None:
            bound = reduce(lambda c, w: F.when(F.col("term") == w[0], self._part(F.col("most"), F.col("least"), w[1])).otherwise(c), weight.items(), F.lit(0.0))
        has = [F.max(F.when(F.col("term") == w, True)).alias(f"has_{i}") for i, w in enumerate(words)]
        there = self.postings(*words).groupBy("segment", "block").agg(F.sum(bound).alias("bound"), *has)
        place = {w: i for i, w in enumerate(words)}
        possible = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.coalesce(F.col(f"has_{place[w]}"), F.lit(False)) for p in parts for w in p.words]) for parts in alternatives])
        return there.where(possible).select("segment", "block", (F.col("bound") * (1 + 1e-9)).alias("bound"))

    def _rows(self, alternatives: list[list[Part]], blocks: DataFrame, among: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        """Rows that meet an alternative: key, size and the frequency of each word (tf_0, tf_1, ...), and the words."""
        words = sorted({w for parts in alternatives for p in parts for w in p.words})
        placed = sorted({w for parts in alternatives for p in parts if len(p.words) > 1 for w in p.words})
        kept = self.postings(*words).join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        entry = kept.select("term", F.explode("entries").alias("e")).select("term", "e.key", "e.size", F.size("e.positions").alias("tf"), *(["e.positions"] if placed else []))
        if among is not None:
            entry = entry.join(among, "key", "left_semi")
        of = lambda column, w: F.max(F.when(F.col("term") == w, F.col(column)))
        rows = entry.groupBy("key").agg(F.max("size").alias("size"), *[of("tf", w).alias(f"tf_{i}") for i, w in enumerate(words)], *[of("positions", w).alias(f"at_{w}") for w in placed])
        place = {w: i for i, w in enumerate(words)}

        def met(part: Part) -> Column:
            there = reduce(lambda a, b: a & b, [F.col(f"tf_{place[w]}").isNotNull() for w in part.words])
            return there & together([F.col(f"at_{w}") for w in part.words], part.slack) if len(part.words) > 1 else there

        hit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(met, parts)) for parts in alternatives])
        return rows.where(F.coalesce(hit, F.lit(False))).select("key", "size", *[f"tf_{i}" for i in range(len(words))]), words

    def match(self, query: str) -> DataFrame:
        """(key, matched_terms): rows that satisfy the query, and how many of its words they have."""
        alternatives = parse(query)
        if not alternatives:
            return self.spark.createDataFrame([], "key long, matched_terms int")
        rows, words = self._rows(alternatives, self._blocks(alternatives))
        return rows.select("key", reduce(lambda a, b: a + b, [F.col(f"tf_{i}").isNotNull().cast("int") for i in range(len(words))]).alias("matched_terms"))

    def full_text(self, rows: DataFrame, key: str, query: str) -> DataFrame:
        """Rows that satisfy the query, with the number of matched terms, as ``retrieval.full_text`` gives them."""
        return rows.join(self.match(query).withColumnRenamed("key", "_key"), F.col(key).cast("long") == F.col("_key")).drop("_key")

    def _part(self, tf: Column, size: Column, weight: float) -> Column:
        """What a word adds to the score of a row."""
        docs, total = (sum(s[c] for s in self.state["segments"].values()) for c in ("docs", "words"))
        average = total / docs if total else 1.0
        tf = tf.cast("double")
        return F.lit(weight) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size.cast("double") / average))

    def weights(self, words: list[str]) -> dict[str, float]:
        """The weight of each word there is, by the number of rows that have it."""
        docs = sum(s["docs"] for s in self.state["segments"].values())
        having = self.postings(*words).groupBy("term").agg(F.sum("n").alias("n"))
        weighed = having.select("term", F.log(1 + (F.lit(docs) - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("weight"))
        return {r.term: r.weight for r in weighed.orderBy("term").collect()}  # the words of a query

    def top(self, query: str, limit: int = 10, among: DataFrame | None = None, decimals: int = 9) -> DataFrame:
        """(key, score, nth): the best rows by BM25 over all words of the query, of those that satisfy it (and are ``among`` rows
        with a column key); ties, at so many decimals, go to the smaller key. Rows of the most promising blocks are scored first;
        of the others only blocks that can still reach the score of the last place."""
        alternatives = parse(query)
        if not alternatives or not self.state["segments"]:
            return self.spark.createDataFrame([], "key long, score double, nth int")
        weight = self.weights(sorted({w for parts in alternatives for p in parts for w in p.words}))
        blocks = self._blocks(alternatives, weight)
        first = blocks.orderBy(F.desc("bound"), "segment", "block").limit(FIRST)
        best = self._scored(alternatives, first, weight, among, limit, decimals).collect()  # at most limit rows
        least = best[-1].score if len(best) == limit else -1.0
        return self._scored(alternatives, blocks.where(F.round("bound", decimals) >= least), weight, among, limit, decimals)

    def _scored(self, alternatives: list[list[Part]], blocks: DataFrame, weight: dict[str, float], among: DataFrame | None, limit: int, decimals: int) -> DataFrame:
        rows, words = self._rows(alternatives, blocks, among)
        score = reduce(lambda a, b: a + b, [F.coalesce(self._part(F.col(f"tf_{i}"), F.col("size"), weight.get(w, 0.0)), F.lit(0.0)) for i, w in enumerate(words)])
        top = rows.select("key", F.round(score, decimals).alias("score")).orderBy(F.desc("score"), "key").limit(limit)
        return top.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("score"), "key")))  # limit rows
