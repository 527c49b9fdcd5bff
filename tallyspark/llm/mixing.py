"""Scores texts by online logistic mixing of hashed-context bit predictors.

Tokens are words (A-Z in lower case) and one end for each text. A token is coded as 14 bits:
five for its frequency class (0: not in the training texts; else one more than the whole part
of log2 of its count; the last class is the end) and nine of the word's hash; then as itself
among the words of its class and hash bits, in proportion to count + 0.1. As in the base score,
all unknown words are one type. Each bit is predicted in several contexts: nothing (the exact
counts), the classes of the two words before, what came lately (sentence end, unknown words,
place), the word before (hashed; class bits) and the two words before (hashed; all bits). The
predictions are mixed in the logistic domain by weights that the bit and the evidence at hand
gate; a last stage refines the mixed probability by what came of such probabilities in training
texts. Bits that no word has otherwise cost nothing; hash bits of which no hashed context knows
anything are coded by the counts.

What is learned from where: all counts are those of all training texts. Weights and the refining
table (1,032 numbers) are learned online, bit by bit, on all training texts: each piece of ``SEGMENT`` tokens starts from the same
weights, and what the pieces end with is averaged, weighted by use. All texts are scored with
those. So a held-out text teaches nothing, equal texts have equal scores, and it makes no
difference how texts are dealt into batches. For a held-out text the probabilities of all
continuations sum to one. A training text is scored as if its token at hand were not in the counts.

How it is spread: texts are packed into batches of about ``BATCH_BYTES``, one row each, in a table
bucketed by batch, so that later joins don't move it. A batch asks the owners of the word hashes
(ranges of hashes) for the counts of its distinct words, then the owners of the context slots for
the counts along the code of each of its distinct (context, code) pairs; answers come back in the
order of the questions. Questions and answers are sorted arrays, packed; a pair that many texts
hold is asked once for each batch. Small contexts and the learned numbers have a fixed number of
cells, which are summed by group-bys. Contexts are known by slots whose number grows with the input.

Results for odd input: a null or empty text is one end; without training texts N and V are 0
and all words are unknown; a null id is not held out; repeated rows are scored alike; an empty
table gives an empty table; extra columns are ignored. A text of any length is scored whole, in the batch of one task.
"""

from __future__ import annotations

import math
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.frames import drop_stored, fold, in_small_batches, release, shared_folder, stored
from tallyspark.llm.text import LOWER, mix, text_slices, word_hash, words

BATCH_BYTES, LARGEST_BATCH = 8 << 20, 32 << 20
SEGMENT = 2048
#: Tokens of training texts that are learned from side by side.
LANES = 1 << 17
#: Tokens that are scored at once.
CHUNK = 1 << 15
#: Share of the training texts from which weights and the refining table are learned: all of them.
FIT_SHARE = 1.0
BITS, CLASS_BITS = 14, 5
HASH_BITS = BITS - CLASS_BITS
END_CLASS = (1 << CLASS_BITS) - 1
#: Bits that the word before predicts, and the two words before.
DEPTHS = {1: CLASS_BITS, 2: BITS}
RATE = 0.02
INPUTS, BIAS = 6, 0.3
#: Kinds of evidence that gate the weights of each bit.
KINDS = 6
LEVELS = np.linspace(-8, 8, 33)
#: The hash that stands for the end of a text.
END = np.uint64(0xE0D)
END_CODE = END_CLASS << HASH_BITS
#: Cells of the small contexts: two classes, and (sentence end, class, unknown words lately, place).
SMALL = (32 * 32 * 32, 2 * 32 * 5 * 4 * 32)

# Along a code, counts up to MOST are told exactly and what is more as MANY; a bit of many by its log ratio
# in steps of RATIO, the same for both of its sides but for the sign, and by the count of the side taken.
MOST, MANY, RATIO, FARTHEST = 8, 9, 1.0, 9
SMOOTH = 0.15
_CODEC = pa.Codec("zstd", compression_level=3)

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of 0 or more as bytes: the planes of as many bytes as the largest needs, compressed."""
    values = np.ascontiguousarray(values.astype(np.uint64))
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(values).to_bytes(6, "little") + bytes([width]) + (_CODEC.compress(planes, asbytes=True) if len(values) else b"")


def unpacked(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:6], "little"), raw[6]
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(_CODEC.decompress(raw[7:], decompressed_size=n * width), np.uint8)
        out[:, :width] = planes.reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


def ascending(values: np.ndarray) -> bytes:
    """``packed`` differences of sorted values."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def told_bit(above: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """What is told of a bit: the count of the side taken (or MANY), and ten times its ratio, counted from 0, if there are many above it."""
    out = np.minimum(taken, MANY)
    many = np.flatnonzero(above > MOST)
    ratio = np.log(taken[many] + SMOOTH) - np.log(above[many] - taken[many] + SMOOTH)
    out[many] += 10 * (np.clip(np.rint(ratio / RATIO), -FARTHEST, FARTHEST).astype(np.int64) + FARTHEST)
    return out.astype(np.uint8)


def _told_logits() -> np.ndarray:
    """(2 * 10 * 256): logit of the side taken by the count above (or MANY) and what is told of the bit; second, without one
    occurrence of the side taken."""
    own, above, told = np.meshgrid(np.arange(2), np.arange(10), np.arange(256), indexing="ij")
    taken = told % 10
    exact = np.log(np.maximum(taken - own, 0) + SMOOTH) - np.log(np.maximum(above - taken, 0) + SMOOTH)
    less = np.where(taken <= MOST, np.log(np.maximum(taken - own, 0) + SMOOTH) - np.log(taken + SMOOTH), 0.0)
    many = (told // 10 - FARTHEST) * RATIO + less
    return np.where(above <= MOST, exact, many).ravel().astype(np.float32)


_TOLD_LOGITS = _told_logits()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all rows with an end after each, each token's row, and twice its length plus whether it closes a sentence."""
    rows = len(offsets) - 1
    low = LOWER[data]
    starts, ends, row = words(low, offsets)
    place = np.arange(len(row)) + row
    out = np.full(len(row) + rows, END, np.uint64)
    about = np.ones(len(out), np.int64)
    out[place] = word_hash(low, starts, ends)
    about[place] = 2 * (ends - starts) + (np.isin(low[ends - 1], np.frombuffer(b".!?:;,", np.uint8)) if len(ends) else 0)
    return out, np.repeat(np.arange(rows), np.bincount(row, minlength=rows) + 1), about


_PACKED = "fit boolean, ids array<long>, held array<boolean>, sizes array<int>, bytes array<long>, hashes binary, about binary, times binary, stream binary"


def _pack(docs: DataFrame, size: int, rate: float) -> DataFrame:
    """Texts as rows of batches, those to fit (a share ``rate`` of the training texts, by hash) apart: ids, which are held out, tokens and bytes of each; the distinct words, sorted
    by hash; and the words of all texts as ranks by their number in the batch."""

    def batch(fit, parts):
        ids, held, sizes, lengths, hashes, about = zip(*parts)
        hashes, about = np.concatenate(hashes), np.concatenate(about)
        known, first, which, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(known))
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([fit]), one(sum(ids, []), pa.int64()), one(sum(held, []), pa.bool_()), one(np.concatenate(sizes), pa.int32()), one(np.concatenate(lengths), pa.int64()), pa.array([ascending(known)], pa.binary()), pa.array([packed(about[first])], pa.binary()), pa.array([packed(times)], pa.binary()), pa.array([packed(rank[which])], pa.binary())],
            names=["fit", "ids", "held", "sizes", "bytes", "hashes", "about", "times", "stream"],
        )

    def run(batches):
        parts, have = {False: [], True: []}, {False: 0, True: 0}
        for b in batches:
            fits = np.asarray(b.column(0).to_numpy(zero_copy_only=False), bool)
            for fit in (False, True):
                some = b.filter(pa.array(fits == fit))
                ids, held = some.column(1).to_pylist(), some.column(2).to_pylist()
                for first, end, data, offsets in text_slices(some.column(3)):
                    hashes, row, about = tokens(data, offsets)
                    parts[fit].append((ids[first:end], held[first:end], np.bincount(row, minlength=end - first), np.diff(offsets), hashes, about))
                    have[fit] += len(data) + 8 * (end - first)
                    if have[fit] >= size:
                        yield batch(fit, parts[fit])
                        parts[fit], have[fit] = [], 0
        for fit in (False, True):
            if parts[fit]:
                yield batch(fit, parts[fit])

    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    text = F.coalesce("text", F.lit(""))
    chosen = ~held & (F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20))))
    rows = in_small_batches(docs).select(chosen.alias("fit"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), text.alias("text"))
    return rows.mapInArrow(run, _PACKED).withColumn("batch", F.monotonically_increasing_id())


class Tables:
    """Tables bucketed by batch: joins and groups by batch read them where they are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def put(self, frame: DataFrame, *more: DataFrame) -> DataFrame:
        """Frames written one after the other as one table."""
        name, path = f"mixing_{uuid.uuid4().hex}", shared_folder(self.spark)
        self.made.append((name, path))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        frame.write.bucketBy(buckets, "batch").sortBy("batch").option("path", path).format("parquet").saveAsTable(name)
        for other in more:
            release(self.spark)
            other.write.mode("append").bucketBy(buckets, "batch").sortBy("batch").format("parquet").saveAsTable(name)
        release(self.spark)
        return self.spark.table(name)

    def drop(self) -> None:
        for name, path in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_stored(self.spark, path)


class Batch:
    """A batch as arrays: its distinct words and the tokens of its texts."""

    def __init__(self, row: dict):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.sizes, self.bytes = np.array(row["sizes"], np.int64), np.array(row["bytes"], np.int64)
        self.hashes = np.cumsum(unpacked(row["hashes"]))
        self.about = unpacked(row["about"]).astype(np.int64)
        order = np.argsort(-unpacked(row["times"]).astype(np.int64), kind="stable")
        self.word = order.astype(np.int32)[unpacked(row["stream"]).astype(np.int32)]
        self.row = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.trains = ~self.held[self.row]

    def counted(self) -> np.ndarray:
        """How often each distinct word occurs in training texts of the batch."""
        return np.bincount(self.word, self.trains, len(self.hashes)).astype(np.int64)

    def code(self, counts: np.ndarray) -> None:
        """Codes of the words by their counts in all training texts, and the classes that contexts are made of."""
        self.counts = counts
        kind = np.where(counts > 0, np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))), END_CLASS - 1), 0).astype(np.int64)
        codes = np.where(kind > 0, kind << HASH_BITS | (self.hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64), 0)
        codes[self.hashes == END] = END_CODE
        self.codes = codes.astype(np.int32)
        self.kind = (self.codes >> HASH_BITS)[self.word]
        self.place = np.arange(len(self.word), dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)

    def back(self, values: np.ndarray, k: int, none) -> np.ndarray:
        """Each token's value ``k`` tokens before it in its text."""
        out = np.full(len(values), none, values.dtype)
        out[k:] = np.where(self.place[k:] >= k, values[:-k] if k < len(values) else values[:0], none)
        return out

    def small(self) -> list[np.ndarray]:
        """The small contexts of each token, numbered, times 32 (room for a class)."""
        one, two = self.back(self.kind, 1, END_CLASS), self.back(self.kind, 2, END_CLASS)
        unknown = np.concatenate((np.zeros(1, np.int32), np.cumsum(self.kind == 0, dtype=np.int32)))
        at = np.arange(len(self.kind), dtype=np.int32)
        lately = unknown[at] - unknown[at - np.minimum(self.place, 16)]
        steps = np.searchsorted(np.array([1, 2, 4, 8], np.int32), lately, "right").astype(np.int32)
        stop = self.back((self.about & 1).astype(np.int32)[self.word], 1, 1)
        return [(one * 32 + two) * 32, (((stop * 32 + one) * 5 + steps) * 4 + np.minimum(self.place, 3)) * 32]

    def pairs(self, order: int, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (slot of the hashed context, code) of the words before, sorted, and each token's number among them."""
        # by the number of the word before, or one more than the last of them, so that each word is hashed once
        before, none = self.back(self.word, 1, np.int32(len(self.hashes))), np.uint64(1)
        context = mix(np.append(self.hashes, none) + np.uint64(order))
        code = self.codes[self.word] >> (BITS - DEPTHS[order])
        if order == 1:  # few pairs, so they are told apart by number first
            cell = (before.astype(np.int64) << DEPTHS[1]) + code
            met = np.zeros(len(context) << DEPTHS[1], bool)
            met[cell] = True
            cells = np.flatnonzero(met)
            before, code = cells >> DEPTHS[1], cells & ((1 << DEPTHS[1]) - 1)
        context = context[before]
        if order == 2:
            context = mix(context ^ np.append(self.hashes, np.uint64(2))[self.back(self.word, 2, np.int32(len(self.hashes)))])
        known, at = np.unique(context >> np.uint64(64 - slot_bits) << np.uint64(BITS) | code.astype(np.uint64), return_inverse=True)
        at = at.astype(np.int32)
        if order == 1:
            number = np.empty(len(met), np.int32)
            number[cells] = at
            at = number[cell]
        return known, at


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def _ask_words(packs: DataFrame, parts: int) -> DataFrame:
    """(part, batch, words, times): each batch's distinct words by owner, with their training occurrences in it."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for row in _rows(table):
            batch = Batch(row)
            times = batch.counted()
            cuts = np.searchsorted(batch.hashes, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts))
            for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(times)])):
                if b > a:
                    out.append((p, row["batch"], ascending(batch.hashes[a:b]), packed(times[a:b])))
        return pa.table(dict(zip(("part", "batch", "words", "times"), map(list, zip(*out)))), pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("words", pa.binary()), ("times", pa.binary())]))

    return packs.groupBy("batch").applyInArrow(run, "part int, batch long, words binary, times binary")


_ANSWER = "batch long, kind int, part int, answer binary, cells array<struct<cell: int, n: long, types: long>>"


def _answer(rows: list[tuple], cells: list[tuple] | None = None) -> pa.Table:
    """Answers (batch, kind, part, bytes), and one row of cells if any."""
    struct = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64()), ("types", pa.int64())]))
    rows = [(*r, None) for r in rows] + ([(None, -1, 0, None, [{"cell": c, "n": n, "types": t} for c, n, t in cells])] if cells else [])
    columns = list(zip(*rows)) or [()] * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("batch", "kind", "part", "answer", "cells"), columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), struct))})


def _tell_words(table: pa.Table) -> pa.Table:
    """Counts over all training texts of the words of one owner, in the order of each batch's question; and of its
    words the sums by code, with the number of words of each."""
    asked = _rows(table)
    words_of = [np.cumsum(unpacked(r["words"])) for r in asked]
    known, which = np.unique(np.concatenate(words_of), return_inverse=True)
    total = np.bincount(which, np.concatenate([unpacked(r["times"]) for r in asked]).astype(np.float64)).astype(np.int64)
    ends = np.cumsum([len(w) for w in words_of])
    out = [(r["batch"], 0, r["part"], packed(total[which[e - len(w) : e]])) for r, w, e in zip(asked, words_of, ends)]
    has = np.flatnonzero(total > 0)
    kind = np.minimum(1 + np.floor(np.log2(np.maximum(total[has], 1))), END_CLASS - 1).astype(np.int64)
    code = np.where(known[has] == END, END_CODE, kind << HASH_BITS | (known[has] >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    leaves, at = np.unique(code, return_inverse=True)
    return _answer(out, list(zip(leaves.tolist(), np.bincount(at, total[has].astype(np.float64)).astype(np.int64).tolist(), np.bincount(at).tolist())))


def _counts(told: list[dict]) -> np.ndarray:
    """A batch's word counts from its answers."""
    return np.concatenate([unpacked(r["answer"]) for r in sorted((r for r in told if r["kind"] == 0), key=lambda r: r["part"])]).astype(np.int64)


def _ask_contexts(packs: DataFrame, told: DataFrame, parts: int, slot_bits: int, kind: int) -> DataFrame:
    """(part, batch, kind, slots, runs, codes, times): each batch's distinct pairs of a kind by owner; with the first
    kind, with part below zero, also its counts in the cells of the small contexts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in _rows(left):
            batch = Batch(row)
            batch.code(_counts(_rows(right)))
            keys, at = batch.pairs(kind, slot_bits)
            times = np.bincount(at, batch.trains, len(keys)).astype(np.int64)
            slots = keys >> np.uint64(BITS)
            owner = (slots * np.uint64(parts) >> np.uint64(slot_bits)).astype(np.int64)
            for a, b in zip(*runs_by(owner)):
                own, runs = np.unique(slots[a:b], return_counts=True)
                out.append((int(owner[a]), row["batch"], kind, ascending(own), packed(runs), packed(keys[a:b] & np.uint64((1 << BITS) - 1)), packed(times[a:b])))
            if kind == min(DEPTHS):
                cells = np.concatenate([np.bincount((c + batch.kind)[batch.trains], minlength=n) for c, n in zip(batch.small(), SMALL)])
                out.append((-1 - row["batch"] % max(1, parts // 16), row["batch"], 0, b"", b"", b"", packed(cells)))
        names = ("part", "batch", "kind", "slots", "runs", "codes", "times")
        kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out) if out else [()] * 7, kinds)})

    return packs.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(run, "part int, batch long, kind int, slots binary, runs binary, codes binary, times binary")


def runs_by(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return [0, *cuts.tolist()][: len(cuts) + bool(len(values))], [*cuts.tolist(), len(values)][: len(cuts) + bool(len(values))]


def _tell_contexts(table: pa.Table) -> pa.Table:
    """Counts over all training texts along the codes of the pairs of one owner: for each pair that of its context, then what ``told_bit`` tells of each bit."""
    asked = _rows(table)
    cells = None
    for r in asked:
        if r["part"] < 0:
            own = unpacked(r["times"]).astype(np.int64)
            cells = own if cells is None else cells + own
    out = []
    for kind, depth in DEPTHS.items():
        some = [r for r in asked if r["kind"] == kind]
        if not some:
            continue
        keys = [np.repeat(np.cumsum(unpacked(r["slots"])), unpacked(r["runs"]).astype(np.int64)) << np.uint64(BITS) | unpacked(r["codes"]) for r in some]
        known, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, np.concatenate([unpacked(r["times"]) for r in some]).astype(np.float64)).astype(np.int64)
        path, above = np.empty((depth + 1, len(known)), np.uint8), None
        for bit in range(depth + 1):
            prefix = known >> np.uint64(depth - bit) if bit else known >> np.uint64(BITS)
            starts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            count = np.repeat(np.add.reduceat(total, starts), np.diff(np.append(starts, len(known))))
            path[bit] = told_bit(above, count) if bit else np.minimum(count, MANY)
            above = count
        for bit in range(depth, 0, -1):  # less the count above: 0 where nothing turns off
            path[bit] -= path[bit - 1] % 10
        end = 0
        for r, k in zip(some, keys):
            at = which[end : end + len(k)]
            end += len(k)
            out.append((r["batch"], kind, r["part"], packed_path(path[:, at])))
    return _answer(out, None if cells is None else [(c, n, 0) for c, n in enumerate(cells.tolist()) if n])


def packed_path(path: np.ndarray) -> bytes:
    return path.shape[1].to_bytes(6, "little") + _CODEC.compress(np.ascontiguousarray(path).tobytes(), asbytes=True)


def _paths(told: list[dict], kind: int) -> np.ndarray:
    """(depth, pairs): 256 times the count above each bit (or MANY) of a batch's pairs, and what is told of the bit."""
    depth, parts = DEPTHS[kind], []
    for r in sorted((r for r in told if r["kind"] == kind), key=lambda r: r["part"]):
        n = int.from_bytes(r["answer"][:6], "little")
        raw = _CODEC.decompress(r["answer"][6:], decompressed_size=n * (depth + 1))
        parts.append(np.frombuffer(raw, np.uint8).reshape(depth + 1, n))
    path = np.concatenate(parts, axis=1)
    out = np.empty((depth, path.shape[1]), np.uint16)
    for bit in range(depth):
        above = path[bit] % 10
        path[bit + 1] += above
        out[bit] = above
        out[bit] <<= 8
        out[bit] |= path[bit + 1]
    return out


class Model:
    """What is known of the whole corpus: counts by code, of the small contexts, weights and the refining table."""

    def __init__(self, leaves: dict[int, tuple[int, int]], small: np.ndarray | None = None):
        self.leaf_tokens, self.leaf_mass = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for code, (n, types) in leaves.items():
            self.leaf_tokens[code], self.leaf_mass[code] = n, n + 0.1 * types
        self.total = int(self.leaf_tokens.sum())
        self.types = sum(types for _, types in leaves.values())
        mass = self.leaf_mass.copy()
        mass[0] += 0.1  # the unknown words
        mass[END_CODE] = max(mass[END_CODE], 0.1)
        self.sums = np.concatenate(([0.0], np.cumsum(mass)))
        cells = np.zeros(sum(SMALL)) if small is None else small
        self.small = [_node_logits(c) for c in np.split(cells, np.cumsum(SMALL)[:-1])]
        self.weights = np.full((BITS * KINDS, INPUTS), 0.3, np.float32)
        self.refined = np.tile(1 / (1 + np.exp(-LEVELS)), (BITS, 1))

    @cached_property
    def code_logits(self) -> tuple[np.ndarray, np.ndarray]:
        """(2, BITS, codes): the logits of the bits of each code by the counts alone; second, without one occurrence
        of it. And (BITS, codes): which bits are sure, as no word there is has the other one."""
        codes = np.arange(1 << BITS)
        out, sure = np.empty((2, BITS, len(codes)), np.float32), np.empty((BITS, len(codes)), bool)
        for bit in range(BITS):
            width = 1 << (BITS - bit)
            low = codes // width * width
            zero = self.sums[low + width // 2] - self.sums[low]
            one = self.sums[low + width] - self.sums[low + width // 2]
            value = codes // (width // 2) % 2
            sure[bit] = np.where(value == 1, zero, one) < 0.05
            for mode in (0, 1):
                out[mode, bit] = np.log(np.maximum(one - mode * value, 0.05)) - np.log(np.maximum(zero - mode * (1 - value), 0.05))
        return np.clip(out, -12, 12), sure

    @cached_property
    def code_rest(self) -> np.ndarray:
        """(2, BITS, codes): what the code after each bit costs by the counts alone, in bits; second, without one occurrence of it."""
        codes = np.arange(1 << BITS)
        out = np.empty((2, BITS, len(codes)), np.float32)
        leaf = self.leaf_mass[codes]
        for bit in range(BITS):
            width = 1 << (BITS - bit)
            low = codes // width * width
            mass = self.sums[low + width] - self.sums[low]
            for mode in (0, 1):
                out[mode, bit] = np.log2(np.maximum(mass - mode, 0.1)) - np.log2(np.maximum(leaf - mode, 0.1))
        return np.maximum(out, 0)

    def learned(self, sums: dict[int, int]) -> None:
        """Takes over the averages of what the pieces of training texts ended with."""
        size = BITS * KINDS * INPUTS
        get = np.vectorize(lambda c: sums.get(int(c), 0), otypes=[np.float64])
        uses = get(np.arange(size, size + BITS * KINDS))
        moved = get(np.arange(size)).reshape(-1, INPUTS) / _FIXED
        self.weights = (self.weights + moved / np.maximum(uses, 1)[:, None]).astype(np.float32)
        first = size + BITS * KINDS
        heard, ones = (get(np.arange(a, a + BITS * len(LEVELS))).reshape(BITS, -1) for a in (first, first + BITS * len(LEVELS)))
        self.refined = (self.refined * 20 + ones) / (20 + heard)


#: Sums of weights are whole numbers of this part of one, so that they don't depend on the order.
_FIXED = 1 << 24


def _node_logits(cells: np.ndarray) -> np.ndarray:
    """(3 * contexts * 32): logits of the class bits at each node of each context: as counted, and without one occurrence of a zero or a one."""
    counts = cells.reshape(-1, 1 << CLASS_BITS)
    nodes = np.zeros((len(counts), 2 << CLASS_BITS))
    nodes[:, 1 << CLASS_BITS :] = counts
    for node in range((1 << CLASS_BITS) - 1, 0, -1):
        nodes[:, node] = nodes[:, 2 * node] + nodes[:, 2 * node + 1]
    zero, one = nodes[:, 0::2], nodes[:, 1::2]
    zero[:, 0] = one[:, 0] = 0
    log = lambda x: np.log(np.maximum(x, 0) + 0.3)
    return np.stack([log(one) - log(zero), log(one) - log(zero - 1), log(one - 1) - log(zero)]).ravel().astype(np.float32)


class Evidence:
    """What the contexts of a batch's tokens say of the bits of their codes."""

    def __init__(self, batch: Batch, told: list[dict], model: Model, slot_bits: int):
        self.batch, self.model = batch, model
        by_code, self.sure = model.code_logits
        self.by_code = by_code.ravel()
        self.small = batch.small()
        self.paths = {kind: _paths(told, kind) for kind in DEPTHS}
        self.pair = {kind: batch.pairs(kind, slot_bits)[1] for kind in DEPTHS}
        self.code = batch.codes[batch.word]


class Some:
    """The evidence for some tokens, bit by bit."""

    def __init__(self, e: Evidence, tokens: np.ndarray | slice):
        self.e = e
        self.code, self.train = e.code[tokens], e.batch.trains[tokens].astype(np.int32)
        self.kind = self.code >> HASH_BITS
        self.whole = (self.kind > 0) & (self.kind < END_CLASS)
        self.pair = {k: pair[tokens] for k, pair in e.pair.items()}
        self.small = [context[tokens] for context in e.small]

    def value(self, bit: int, some: np.ndarray | slice) -> np.ndarray:
        return self.code[some] >> (BITS - 1 - bit) & 1

    def sure(self, bit: int, some: np.ndarray | slice) -> np.ndarray:
        return self.e.sure[bit].take(self.code[some])

    def known(self, bit: int, some: np.ndarray) -> np.ndarray:
        """Those of some tokens of which a hashed context knows something of the bit."""
        out = self.e.paths[2][bit].take(self.pair[2][some]) >> 8 > self.train[some]
        if bit < DEPTHS[1]:
            out |= self.e.paths[1][bit].take(self.pair[1][some]) >> 8 > self.train[some]
        return some[out]

    def inputs(self, bit: int, value: np.ndarray, some: np.ndarray | slice) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """The mixer's inputs for a bit of some tokens, and the gates of their weights."""
        train = self.train[some]
        out = [(0, self.e.by_code.take(((train * BITS + bit) << BITS) + self.code[some]))]
        if bit < CLASS_BITS:
            node = (1 << bit) + (self.kind[some] >> (CLASS_BITS - bit))
            mode = (1 + value) * train
            out += [(1 + k, self.e.model.small[k].take(mode * SMALL[k] + context[some] + node)) for k, context in enumerate(self.small)]
        sign = (2 * value - 1).astype(np.float32)
        gate = np.full(len(train), bit * KINDS, np.int32)
        own = train * 2560
        for k, depth in DEPTHS.items():
            if bit < depth:
                told = self.e.paths[k][bit].take(self.pair[k][some]).astype(np.int32)
                out.append((2 + k, _TOLD_LOGITS.take(own + told) * sign))
                seen = (told >> 8) - train
                gate += np.clip(seen, 0, 2) if k == 2 else np.where(seen > 0, 3, 0)
        return out, gate


def _rounded(dot: np.ndarray) -> np.ndarray:
    return ((np.clip(dot, -8, 8) + np.float32(8.25)) * 2).astype(np.int32)


def learned_sums(evidence: Evidence) -> np.ndarray:
    """Sums of what the pieces of the training texts of a batch end with, learning online from the same weights:
    how far each weight moved times its uses, the uses, and for the refining table how often a probability was met and a one came of it.

    What is known of a bit doesn't depend on the weights, and a gate's weights move only where the gate is used. So each
    gate of each piece is a sequence of its own, and the sequences of ``LANES`` tokens take their steps side by side."""
    batch = evidence.batch
    pieces = -(-batch.sizes // SEGMENT)
    owner = np.repeat(np.arange(len(pieces)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(batch.sizes) - batch.sizes)[owner] + number * SEGMENT
    size = np.minimum(SEGMENT, batch.sizes[owner] - number * SEGMENT)
    start, size = start[batch.trains[start]], size[batch.trains[start]]
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    gates, cells = BITS * KINDS, BITS * len(LEVELS)
    moved, used = np.zeros((gates, INPUTS), np.int64), np.zeros(gates, np.int64)
    heard, ones = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for a, b in zip(*runs_by((np.cumsum(size) - size) // LANES)):
        for found in _learned_side_by_side(evidence, start[a:b], size[a:b]):
            for total, some in zip((moved, used, heard, ones), found):
                total += some
    return np.concatenate((moved.ravel(), used, heard, ones))


def _learned_side_by_side(evidence: Evidence, start: np.ndarray, size: np.ndarray):
    """The four sums of ``learned_sums`` for some pieces: what the class bits teach, then what the hash bits do."""
    lanes, gates = len(size) * KINDS, BITS * KINDS
    lane = np.repeat(np.arange(0, lanes, KINDS, dtype=np.int32), size)
    tokens = Some(evidence, np.arange(len(lane)) + np.repeat(start - (np.cumsum(size) - size), size))
    some = np.arange(len(lane))
    for bits, names in ((range(CLASS_BITS), [*range(INPUTS)]), (range(CLASS_BITS, BITS), [0, 4, INPUTS - 1])):
        uses, told = [], []
        for bit in bits:
            if bit >= CLASS_BITS:
                some = tokens.known(bit, some[tokens.whole[some]] if bit == CLASS_BITS else some)
            open_ = some[~tokens.sure(bit, some)]
            value = tokens.value(bit, open_)
            columns, gate = tokens.inputs(bit, value, open_)
            key = lane[open_] + (gate - bit * KINDS)
            order = np.argsort(key.astype(np.uint16) if lanes <= 1 << 16 else key, kind="stable")
            uses.append(np.bincount(key, minlength=lanes))
            told.append((order, 2 * bit + value, [(names.index(k), column) for k, column in columns]))
        # a sequence for each bit, piece and kind, the longest first: those that take a step are the first live of them, side by side in the steps' columns
        lengths = np.concatenate(uses)
        longest = np.argsort(-lengths, kind="stable")[: np.count_nonzero(lengths)]
        place = np.zeros(len(lengths), np.int64)
        place[longest] = np.arange(len(longest))
        live = len(longest) - np.cumsum(np.bincount(lengths[longest], minlength=1))[:-1]
        begin = np.concatenate(([0], np.cumsum(live)))
        x, what = np.zeros((len(names), begin[-1]), np.float32), np.empty(begin[-1], np.int32)
        x[-1] = BIAS
        for own, at, (order, coded, columns) in zip(uses, np.split(place, len(uses)), told):
            step = np.arange(len(coded)) - np.repeat(np.cumsum(own) - own, own)
            to = np.empty_like(step)
            to[order] = begin[step] + np.repeat(at, own)
            what[to] = coded
            for k, column in columns:
                x[k, to] = column
        gate = (longest // lanes + bits[0]) * KINDS + longest % KINDS
        first = np.ascontiguousarray(evidence.model.weights[gate][:, names].T)
        weights, value, dots = first.copy(), (what & 1).astype(np.float32), np.empty(begin[-1], np.float32)
        for a, n in zip(begin[:-1].tolist(), live.tolist()):
            seen, w = x[:, a : a + n], weights[:, :n]
            dot = np.einsum("ij,ij->j", w, seen, out=dots[a : a + n])
            np.maximum(np.minimum(dot, 12, out=dot), -12, out=dot)
            p = np.exp(-dot)
            p += 1
            p = np.subtract(value[a : a + n], np.reciprocal(p, out=p), out=p)
            p *= RATE
            w += p * seen
        times = lengths[longest]
        far = np.rint((weights - first).astype(np.float64) * times * _FIXED)
        moved = np.zeros((gates, INPUTS), np.int64)
        for k, one in zip(names, far):
            moved[:, k] = np.bincount(gate, one, gates)
        met = np.bincount(what * len(LEVELS) + _rounded(dots), minlength=2 * BITS * len(LEVELS)).reshape(BITS, 2, -1)
        yield moved, np.bincount(gate, times, gates).astype(np.int64), met.sum(axis=1).ravel(), met[:, 1].ravel()


def code_bits(evidence: Evidence) -> np.ndarray:
    """The bits that the code of each token takes under the mixed model."""
    batch, model = evidence.batch, evidence.model
    rest = model.code_rest
    cost = np.zeros(len(batch.word), np.float32)
    weights, refined = np.ascontiguousarray(model.weights.T), model.refined.astype(np.float32)
    for first in range(0, len(cost), CHUNK):
        own = cost[first : first + CHUNK]
        tokens = Some(evidence, slice(first, first + CHUNK))
        some: np.ndarray | slice = slice(None)
        for bit in range(BITS):
            if bit >= CLASS_BITS:  # what is known of a code's bits falls along it
                before = np.flatnonzero(tokens.whole) if bit == CLASS_BITS else some
                some = tokens.known(bit, before)
                ends = np.ones(len(own), bool)
                ends[some] = False
                left = before[ends[before]]
                own[left] += rest[tokens.train[left], bit, tokens.code[left]]
                if not len(some):
                    break
            value = tokens.value(bit, some)
            columns, gate = tokens.inputs(bit, value, some)
            dot = weights[INPUTS - 1].take(gate) * np.float32(BIAS)
            for k, column in columns:
                dot += weights[k].take(gate) * column
            dot = np.clip(dot, -12, 12)
            one = 0.5 / (1 + np.exp(-dot)) + 0.5 * refined[bit].take(_rounded(dot))
            own[some] -= np.log2(np.clip(np.where(value == 1, one, 1 - one), 1e-6, 1)) * ~tokens.sure(bit, some)
    return cost.astype(np.float64)


def _scored(batch: Batch, told: list[dict], model: Model, slot_bits: int) -> pa.Table:
    rows, n, v = len(batch.sizes), model.total, model.types
    c, code = batch.counts[batch.word].astype(np.float64), batch.codes[batch.word]
    per_text = lambda x: np.bincount(batch.row, x, rows)
    known = (code >> HASH_BITS > 0) & (code != END_CODE)
    left_out = batch.trains & known
    within = np.where(known, np.log10(np.maximum(c - left_out + 0.1, 0.1)) - np.log10(np.maximum(model.leaf_mass[code] - left_out, 0.1)), 0.0)
    score = per_text(within) - per_text(code_bits(Evidence(batch, told, model, slot_bits))) * math.log10(2)
    spelled = per_text(np.where((c == 0) & (code != END_CODE), 8.0 * (batch.about[batch.word] // 2 + 1), 0.0))
    return pa.table(
        {
            "doc_id": pa.array(batch.ids, pa.int64()),
            "held_out": pa.array(batch.held),
            "n_tokens": batch.sizes,
            "n_known": per_text(c > 0).astype(np.int64),
            "train_tokens": np.full(rows, n, np.int64),
            "base_score": per_text(np.log10((c + 0.1) / (n + 0.1 * (v + 1)))),
            "score": score,
            "bits_per_byte": (-score / math.log10(2) + spelled) / np.maximum(batch.bytes, 1),
        }
    )


def _summed(told: DataFrame, *columns: str) -> dict[int, tuple[int, ...]]:
    """The cells of all answers, summed: a fixed number of them."""
    rows = told.where("cells is not null").select(F.inline("cells")).groupBy("cell").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    return {r["cell"]: tuple(int(r[c]) for c in columns) for r in rows}


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each text;
    learns from the texts that are not held out (crc32 of the id as text, modulo 10, is not 0).

    score is the log10 probability of the text's tokens. bits_per_byte are its bits for each byte of
    the text, unknown words spelled at eight bits a byte; case and the kind of white space are not coded.
    """
    spark: SparkSession = docs.sparkSession
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    total = docs.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], RESULT)
    size = min(LARGEST_BATCH, max(BATCH_BYTES, total >> 18))
    parts = min(1 << 20, max(12, -(-total // (12 << 20))))
    slot_bits = min(48, max(24, total.bit_length() + 1))
    tables, words_path = Tables(spark), shared_folder(spark)
    packs = tables.put(_pack(docs, size, FIT_SHARE))
    words_told = stored(_ask_words(packs, parts).groupBy("part").applyInArrow(_tell_words, _ANSWER), words_path)
    release(spark)
    leaves = _summed(words_told, "n", "types")
    counts = words_told.where("batch is not null")

    def told_of(kind: int) -> DataFrame:
        found = _ask_contexts(packs, counts, parts, slot_bits, kind).groupBy("part").applyInArrow(_tell_contexts, _ANSWER)
        return (found.unionByName(counts) if kind == min(DEPTHS) else found).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch")

    told = tables.put(*map(told_of, DEPTHS))
    drop_stored(spark, words_path)
    small = np.zeros(sum(SMALL))
    for cell, (n,) in _summed(told, "n").items():
        small[cell] = n
    model = Model(leaves, small)
    answers = told.where("batch is not null").select("batch", "kind", "part", "answer")
    def opened(left: pa.Table, right: pa.Table):
        told = _rows(right)
        for row in _rows(left):
            batch = Batch(row)
            batch.code(_counts(told))
            yield batch, told

    def learn(left: pa.Table, right: pa.Table) -> pa.Table:
        sums = np.asarray(sum(learned_sums(Evidence(batch, told, model, slot_bits)) for batch, told in opened(left, right)))
        at = np.flatnonzero(sums) if sums.ndim else np.zeros(0, np.int64)
        return pa.table({"cell": pa.array(at, pa.int32()), "n": pa.array(sums[at] if sums.ndim else at, pa.int64())})

    fits = packs.where("fit")
    sums = fits.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(learn, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    trained = Model(leaves, small)
    trained.learned({r["cell"]: int(r["n"]) for r in sums})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([_scored(batch, told, trained, slot_bits) for batch, told in opened(left, right)])

    scored = stored(packs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, RESULT))
    tables.drop()
    return scored
