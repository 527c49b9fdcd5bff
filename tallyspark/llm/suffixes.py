"""Removes repeated byte strings by a run-length index of the repeated text.

1. Content-chosen anchors (``anchors``) find, over the whole corpus, the contexts that
   occur more than once. Equal contexts are one dictionary phrase: all occurrences but
   the first are repeats in full.
2. The phrases that share an anchor but differ go to blocks of about ``BLOCK`` bytes. In
   each block a Burrows-Wheeler transform of the phrases is built and run-compressed: what
   is kept is a sample for each run end (``RunIndex``): the two suffixes that meet there and
   the length of their match, compared byte by byte. Matching statistics are streamed from
   the samples over the text in order. A place whose match reaches the wanted length is
   linked with the place that it matches; the windows of one chain are equal, and all but
   the first in document order are repeats.
3. Spans of repeats are joined to their documents and cut.

A context is divided at its anchor into windows that reach far to the left and those
that reach far to the right, so that phrases meet only if they share ``width + size``
halves: a short line that many documents hold does not gather them in one group. If
more than ``HOT`` bytes still share one half, their windows are settled by a group-by on
128-bit window hashes instead, which Spark spreads over all tasks.

Results for odd input: null texts are empty and lose nothing; texts shorter than the
width lose nothing; repeated rows (same id and text) are one document and do not remove
each other; texts that share an id, and texts without one, count in the order of a hash of
the text, those without an id after all others; an empty table gives an empty table; extra columns are ignored unless kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.anchors import anchors_of, cut_spans, listed, ragged
from tallyspark.llm.frames import drop_stored, identified, release, shared_folder, stored
from tallyspark.llm.text import BYTE_VALUES, OTHER_BYTE_VALUES, mix, prefix_hash, runs_of, span_hash, text_slices

WIDTH = 100
SIZE = 40
BLOCK = 1 << 19
HOT = 2 << 20
#: Places of a block whose matching statistics are streamed at once.
STREAM = 1 << 16


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of each suffix by prefix doubling; the last symbol of every phrase occurs once."""
    n = len(symbols)
    bits = int(symbols.max()).bit_length()
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] |= symbols[k:]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank_of = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = rank_of
        if rank_of[-1] == n - 1:
            return rank
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        step *= 2


@dataclass
class RunIndex:
    """Samples at the run heads of a transform, in text order: where the suffix at a head begins,
    where the one sorted before it begins, and how long the two match.

    Within a run both suffixes have the same symbol before them, so a step to the left by either
    leads to neighbours again: from a sample on, the neighbour moves with the text and the match
    gets one shorter with each place. The samples alone hold all matching statistics; the index
    has a row for each run, not for each place.
    """

    head: np.ndarray
    before: np.ndarray
    match: np.ndarray

    @classmethod
    def build(cls, symbols: np.ndarray) -> RunIndex:
        """The last symbol of every phrase occurs once."""
        rank = suffix_ranks(symbols)
        suffixes = np.empty(len(rank), np.int64)
        suffixes[rank] = np.arange(len(rank))
        transform = symbols[suffixes - 1]
        heads = np.flatnonzero(transform[1:] != transform[:-1]) + 1
        at, other = suffixes[heads], suffixes[heads - 1]
        match = np.zeros(len(at), np.int64)
        length, live = 0, np.arange(len(at))
        while len(live):  # ends: no two suffixes share the end mark of a phrase
            same = symbols[at[live] + length] == symbols[other[live] + length]
            match[live[~same]] = length
            live = live[same]
            length += 1
        # the least suffix has none before it
        at, other, match = (np.append(x, y) for x, y in ((at, suffixes[0]), (other, suffixes[0]), (match, 0)))
        order = np.argsort(at)
        return cls(at[order], other[order], match[order])

    def stream(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For the places from first to end, in order: the place whose suffix is sorted before, and the length of the match."""
        places = np.arange(first, end)
        sample = np.searchsorted(self.head, places, "right") - 1
        past = places - self.head[sample]
        return self.before[sample] + past, np.maximum(self.match[sample] - past, 0)


def repeats(phrases: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Marks the phrase bytes at which a window starts that also starts earlier; phrases come in document order."""
    m = len(sizes)
    ends = np.cumsum(sizes + 1)
    symbols = np.empty(int(ends[-1]), np.int64)
    symbols[ends - 1] = np.arange(m)
    body = ragged(ends - sizes - 1, sizes)
    symbols[body] = phrases.astype(np.int64) + m
    index = RunIndex.build(symbols)
    chain = np.arange(len(symbols))  # leads to a place with an equal window
    for first in range(0, len(symbols), STREAM):
        before, match = index.stream(first, min(first + STREAM, len(symbols)))
        long = np.flatnonzero(match >= width)
        chain[first + long] = before[long]
    linked = np.flatnonzero(chain != np.arange(len(symbols)))
    steps = linked
    while len(steps):  # to the end of each chain, twice as far each time
        further = chain[chain[steps]]
        moved = further != chain[steps]
        chain[steps] = further
        steps = steps[moved]
    group = np.union1d(linked, chain[linked])
    _, first, which = np.unique(chain[group], return_index=True, return_inverse=True)
    marked = np.zeros(len(symbols), bool)
    marked[group] = first[which] != np.arange(len(group))
    return marked[body]


def _phrases(docs: DataFrame, width: int, size: int) -> DataFrame:
    """Bytes of the candidate contexts, in a row for each half: (half, did, uid, pos, phrase)."""
    half = (width - size) // 2

    def run(batches):
        for batch in batches:
            did, uid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            owner, entries = listed(batch.column(3))
            fields = {f: np.asarray(entries.field(f)).astype(np.int64) for f in ("key", "pos", "windows", "off")}
            for first, end, data, offsets in text_slices(batch.column(2)):
                a, b = np.searchsorted(owner, (first, end))
                if a == b:
                    continue
                row = owner[a:b] - first
                prefix = prefix_hash(BYTE_VALUES[data])
                start = offsets[row] + fields["pos"][a:b]
                stop, anchor = start + fields["windows"][a:b], start + fields["off"][a:b]
                key = fields["key"][a:b].view(np.uint64)
                turn = np.clip(anchor - half + 1, start, stop)
                for side, (begin, until, x, y) in enumerate(((start, turn, anchor - half, anchor + size), (turn, stop, anchor, anchor + width - half + 1))):
                    has = np.flatnonzero(until > begin)
                    if not len(has):
                        continue
                    group = mix(key[has] ^ span_hash(prefix, x[has], y[has], 17 + side))
                    lengths = until[has] - begin[has] - 1 + width
                    flat = data[ragged(begin[has], lengths)]
                    bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group.view(np.int64)), pa.array(did[first:end][row[has]]), pa.array(uid[first:end][row[has]]), pa.array((begin[has] - offsets[row[has]]).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat))])],
                        names=["half", "did", "uid", "pos", "phrase"],
                    )

    return docs.mapInArrow(run, "half long, did long, uid long, pos int, phrase binary")


def _settle(phrases: DataFrame, width: int) -> DataFrame:
    """Repeats among phrases of equal halves: (did, uid, pos, windows), and for windows of oversized halves also their hash."""

    def emit(did, uid, pos, windows, w1=None, w2=None):
        n = len(did)
        random = mix(did.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64))
        w1 = random if w1 is None else w1
        w2 = np.zeros(n, np.uint64) if w2 is None else w2 | np.uint64(1)
        return pa.RecordBatch.from_arrays([pa.array(did.astype(np.int64)), pa.array(uid.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names=["did", "uid", "pos", "windows", "w1", "w2"])

    def index(group, did, uid, pos, flat, sizes):
        """Marks of one block of whole groups."""
        order = np.lexsort((pos, uid, did))
        twin = np.zeros(len(order), bool)
        o = order
        twin[1:] = (did[o[1:]] == did[o[:-1]]) & (uid[o[1:]] == uid[o[:-1]]) & (pos[o[1:]] == pos[o[:-1]])
        order = order[~twin]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        texts = span_hash(prefix_hash(BYTE_VALUES[flat]), starts, starts + sizes, 5) ^ mix(span_hash(prefix_hash(OTHER_BYTE_VALUES[flat], 1), starts, starts + sizes, 5, 1))
        _, which, times = np.unique(group[order], return_inverse=True, return_counts=True)
        order = order[times[which] > 1]
        if not len(order):
            return None
        _, lead, which = np.unique(mix(group[order].view(np.uint64)) ^ texts[order], return_index=True, return_inverse=True)
        copies = lead[which] != np.arange(len(order))  # order is by document, so the first of equal phrases leads
        own = order[~copies]
        marked = repeats(flat[ragged(starts[own], sizes[own])], sizes[own], width)
        cuts = np.concatenate(([0], np.cumsum(sizes[own])))
        begin, until = runs_of(np.concatenate((marked, [False])))
        # a run of marks never passes a phrase's end: its last width - 1 bytes start no window
        at = np.searchsorted(cuts, begin, "right") - 1
        same = order[copies]
        return emit(np.concatenate((did[own[at]], did[same])), np.concatenate((uid[own[at]], uid[same])), np.concatenate((pos[own[at]] + begin - cuts[at], pos[same])), np.concatenate((until - begin, sizes[same] - width + 1)))

    def run(batches):
        held: list[tuple] = []
        size, hot = 0, None

        def join(parts):
            return tuple(np.concatenate(x) for x in zip(*parts))

        def by_window(group, did, uid, pos, flat, sizes):
            prefix = prefix_hash(BYTE_VALUES[flat])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            n = sizes - width + 1
            at, of = ragged(starts, n), np.repeat(np.arange(len(n)), n)
            return emit(did[of], uid[of], pos[of] + at - starts[of], np.ones(len(of), np.int64), span_hash(prefix, at, at + width, 23), span_hash(prefix_hash(OTHER_BYTE_VALUES[flat], 1), at, at + width, 29, 1))

        for batch in batches:
            column = batch.column(4)
            for first, end, data, offsets in text_slices(column, BLOCK):
                part = (batch.column(0).to_numpy()[first:end], *(batch.column(i).to_numpy()[first:end] for i in (1, 2, 3)), data, np.diff(offsets))
                if hot is not None:
                    still = int((part[0] == hot).sum())
                    if still:
                        cut = int(part[5][:still].sum())
                        yield by_window(*(x[:still] for x in part[:4]), part[4][:cut], part[5][:still])
                        part = (*(x[still:] for x in part[:4]), part[4][cut:], part[5][still:])
                    if not len(part[0]):
                        continue
                    hot = None
                held.append(part)
                size += len(part[4])
                if size < BLOCK:
                    continue
                block = join(held)
                last = int(np.searchsorted(block[0], block[0][-1]))  # sorted: the last group may go on
                cut = int(block[5][:last].sum())
                if last:
                    found = index(*(x[:last] for x in block[:4]), block[4][:cut], block[5][:last])
                    if found is not None:
                        yield found
                rest = (*(x[last:] for x in block[:4]), block[4][cut:], block[5][last:])
                if len(rest[4]) > HOT:
                    hot = rest[0][0]
                    yield by_window(*rest)
                    held, size = [], 0
                else:
                    held, size = [rest], 0 if last else len(rest[4]) - BLOCK
        if held:
            found = index(*join(held))
            if found is not None:
                yield found

    parted = phrases.repartition("half").sortWithinPartitions("half")
    marked = parted.mapInArrow(run, "did long, uid long, pos int, windows int, w1 long, w2 long")
    first = Window.partitionBy("w1", "w2").orderBy("did", "uid", "pos")
    return marked.select("did", "uid", "pos", "windows", "w2", F.rank().over(first).alias("nth")).where("w2 = 0 or nth > 1").select("did", "uid", "pos", "windows")


def repeated_spans(docs: DataFrame, width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """All windows that start earlier too, as (did, uid, pos, windows), from ``identified`` rows."""
    found = anchors_of(docs, "byte", width, size, same_document=True).repartition("key").sortWithinPartitions("key", "context", "did", "uid", "pos")
    group = Window.partitionBy("key")
    same = Window.partitionBy("key", "context").orderBy("did", "uid", "pos")
    level = found.select("*", (F.min("context").over(group) != F.max("context").over(group)).alias("partly"), F.rank().over(same).alias("nth"))
    path = shared_folder(docs.sparkSession)
    level = stored(level.where("local or nth > 1 or partly").select("key", "did", "uid", "pos", "windows", "off", (F.col("local") | (F.col("nth") > 1)).alias("whole")), path)
    del found
    release(docs.sparkSession)
    whole = level.where("whole").select("did", "uid", "pos", "windows")
    candidates = level.where("not whole").groupBy("did", "uid").agg(F.collect_set(F.struct("key", "pos", "windows", "off")).alias("found"))
    texts = docs.select("did", "uid", "text").join(candidates.hint("shuffle_hash"), ["did", "uid"]).select("did", "uid", "text", "found")
    spans = stored(whole.unionByName(_settle(_phrases(texts, width, size), width)))
    del level, whole, candidates, texts
    drop_stored(docs.sparkSession, path)
    release(docs.sparkSession)
    return spans


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, size: int = SIZE, whole_chars: bool = False) -> DataFrame:
    """Cuts from each text the bytes covered by a ``width``-byte string that starts earlier.

    Returns the kept columns, kept (binary), n_units (bytes), n_removed and n_spans.
    """
    rows = identified(docs, *keep)
    return cut_spans(rows, repeated_spans(rows, width, size), "byte", width, keep, whole_chars)
