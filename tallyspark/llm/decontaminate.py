"""Finds benchmark items in documents: CGK embedding, bit-sampling LSH, exact edit distance.

A text is its sequence of words (runs of letters and digits, A-Z in lower case); an item
of n words is in a document if some stretch of it is within ``floor(n / 5)`` word edits.

1. Windows. A stretch within k edits shares at least n - q + 1 - k q of the item's q-grams
   (q at most 3) on neighbouring diagonals. Places that do give item-sized windows; this
   is a lossless filter, not a sample.
2. LSH. The CGK walk copies a window's words to up to 3 n steps; at each step a random bit of
   (step, word) says whether to move on. Words that were inserted or deleted make two walks
   differ only until they meet again, so edit distance becomes Hamming distance. Each of
   ``REPEATS`` walks samples one to three steps by the item's length (``SAMPLED``); windows and
   items with equal samples in any repeat are the first candidates.
3. Verification. Each candidate's exact edit distance to the best stretch nearby decides.
   Then it decides for all other windows of step 1 too, so none is lost whose samples differ;
   ``by_walk`` tells for each match whether equal samples led to it or only this exact way.

Items go to the tasks in blocks of at most ``BLOCK_BYTES``: a checked size. Each block is
one pass over the documents.

Results for odd input: null texts and items, and items without words, match nothing; items
of equal text each match, and so do items without an id or of a shared one, each with the id
it has; repeated rows of an item are one; repeated documents each match; an empty table on
either side gives an empty table; extra columns are ignored. An item found several times in
a document is reported once, at its least distance, then first place. An item of one or two
words is found in all documents that hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.frames import in_small_batches
from tallyspark.llm.text import LOWER, SLICE, SPACE, mix, prefix_hash, span_hash, text_slices, word_hash, words

GRAM = 3
#: Walks of each window, and steps that each samples for items up to so many words (one step beyond): longer
#: items have more edits, after which walks meet more seldom. Measured with all edits an item may have, items of
#: 20 to 800 words share the samples of some walk with a recall of 0.95 or more.
REPEATS, SAMPLED = 64, ((80, 3), (250, 2))
#: Walks are sampled before this many steps for each word; near two they reach the end of most windows and all agree.
STEPS = 1.7
BLOCK_BYTES = 32 << 20

_GAPS = SPACE.copy()
_GAPS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
_END = np.uint64(0xE5D)


def budget(n: int) -> int:
    """Word edits allowed in an item of n words."""
    return n // 5


def gram_of(n: int) -> int:
    """Length of the longest stretch of unedited words that is sure to be left, three at most."""
    k = budget(n)
    return max(1, min(GRAM, -(-(n - k) // (k + 1))))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, row = words(low, offsets, _GAPS)
    return word_hash(low, starts, ends), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1)))).astype(np.int64)


_SEEDS = mix(np.arange(1, 1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_DRAWN = np.random.default_rng(7).random((REPEATS, SAMPLED[0][1]))


def samples_of(sizes: np.ndarray) -> np.ndarray:
    """Steps that a walk of an item of so many words samples."""
    return np.select([sizes <= n for n, _ in SAMPLED], [k for _, k in SAMPLED], 1)


def walks(symbols: np.ndarray, start: np.ndarray, limit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of what each repeat samples of the CGK walk of each window (one row for each
    window); places outside [limit) are end marks."""
    n = len(start)
    sampled = np.floor(_DRAWN[None] * (STEPS * sizes)[:, None, None]).astype(np.int64)
    used = np.arange(sampled.shape[2]) < samples_of(sizes)[:, None, None]
    sampled = np.where(used, sampled, -1)
    key = np.broadcast_to(np.arange(REPEATS, dtype=np.uint64) * np.uint64(1_000_003) + sizes.astype(np.uint64)[:, None], (n, REPEATS)).copy()
    at = np.zeros((n, REPEATS), np.int64)
    row, last = start[:, None], sizes[:, None]
    low, high = limit[:, :1], np.minimum(limit[:, 1:], start[:, None] + last)
    repeat = np.arange(REPEATS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for step in range(int(sampled.max()) + 1 if n else 0):
        place = row + at
        symbol = np.where((place >= low) & (place < high), symbols[np.clip(place, 0, len(symbols) - 1)], _END)
        for k in range(sampled.shape[2]):
            hit = sampled[:, :, k] == step
            key[hit] = mix(key[hit] ^ symbol[hit])
        moves = mix(symbol ^ (_SEEDS[step % len(_SEEDS)] + repeat)) >> np.uint64(63)
        at = np.minimum(at + moves.astype(np.int64), last)
    return key


def edit_distance(item: np.ndarray, near: np.ndarray) -> tuple[int, int]:
    """Least word edit distance of an item to any stretch of ``near``, and the end of the first such stretch."""
    steps = np.arange(len(near) + 1)
    row = np.zeros(len(near) + 1, np.int64)
    for i, word in enumerate(item):
        below = np.empty_like(row)
        below[0] = i + 1
        below[1:] = np.minimum(row[:-1] + (near != word), row[1:] + 1)
        row = np.minimum.accumulate(below - steps) + steps
    return int(row.min()), int(row.argmin())


class Index:
    """A block of items: their words, the q-grams to look for, and the sampled walks."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        data_offsets = [(i, t) for i, t in items if t]
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        raw = [t.encode() for _, t in data_offsets]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        symbols, cuts = hashed_words(data, offsets)
        for k, (item, _) in enumerate(data_offsets):
            if cuts[k + 1] > cuts[k]:
                self.ids.append(item)
                self.words.append(symbols[cuts[k] : cuts[k + 1]])
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([budget(n) for n in self.sizes], np.int64)
        self.grams = np.array([gram_of(n) for n in self.sizes], np.int64)
        self.needed = np.maximum(1, self.sizes - self.grams + 1 - self.edits * self.grams)
        self.tables = {}
        for q in sorted(set(self.grams.tolist())):
            keys, owner, place = [], [], []
            for k in np.flatnonzero(self.grams == q):
                at = np.arange(self.sizes[k] - q + 1)
                keys.append(span_hash(prefix_hash(self.words[k]), at, at + q, 81))
                owner.append(np.full(len(at), k))
                place.append(at)
            keys, owner, place = map(np.concatenate, (keys, owner, place))
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[keys >> np.uint64(44)] = True
            self.tables[q] = keys[order], owner[order], place[order], seen
        flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        start = np.cumsum(self.sizes) - self.sizes
        keys = walks(flat, start, np.stack([start, start + self.sizes], axis=1), self.sizes).ravel()
        order = np.argsort(keys, kind="stable")
        self.samples, self.sampled_by = keys[order], order // REPEATS

    def windows(self, symbols: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and start of the item-sized windows that hold enough of the item's q-grams."""
        found = []
        for q, (keys, owner, place, seen) in self.tables.items():
            at = np.arange(max(0, len(symbols) - q + 1))
            grams = span_hash(prefix_hash(symbols), at, at + q, 81)
            at = at[seen[grams >> np.uint64(44)]]
            row = np.searchsorted(cuts, at, "right") - 1
            same = at + q <= cuts[row + 1]
            at, row = at[same], row[same]
            low, high = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
            times = high - low
            ends = np.cumsum(times)
            posting = np.repeat(low - (ends - times), times) + np.arange(int(ends[-1]) if len(ends) else 0)
            found.append((np.repeat(row, times), owner[posting], np.repeat(at, times) - place[posting]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        row, item, start = map(np.concatenate, zip(*found))
        wide = np.int64(1) << 40
        group = row * len(self.ids) + item
        order = np.lexsort((start, group))
        row, item, start, group = row[order], item[order], start[order], group[order]
        # all hits of a stretch lie on diagonals at most 2 k apart
        _, group = np.unique(group, return_inverse=True)
        rank = group * (wide >> 10) + start + (np.int64(1) << 28)
        reach = np.searchsorted(rank, rank + 2 * self.edits[item], "right")
        enough = reach - np.arange(len(rank)) >= self.needed[item]
        first = np.flatnonzero(enough)
        marks = np.zeros(len(rank) + 1, np.int64)
        np.add.at(marks, first, 1)
        np.add.at(marks, reach[first], -1)
        keep = np.cumsum(marks[:-1]) > 0
        out = np.unique(np.stack([row[keep], item[keep], start[keep]], axis=1), axis=0) if keep.any() else np.zeros((0, 3), np.int64)
        return out[:, 0], out[:, 1], out[:, 2]

    def candidates(self, symbols: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
        """(row, item, first and last window start, whether by walk): windows and items whose samples agree in some
        repeat, then all runs of windows that lie near each other."""
        found = self.windows(symbols, cuts)
        return [(row, k, start, start, True) for row, k, start in self.sampled(symbols, cuts, *found)] + [(*run, False) for run in self.runs(*found)]

    def runs(self, row: np.ndarray, item: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Windows of a row and item, in order, whose neighbourhoods overlap."""
        if not len(row):
            return []
        apart = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.sizes[item[1:]] + 3 * self.edits[item[1:]])
        first = np.concatenate(([0], np.flatnonzero(apart) + 1))
        last = np.concatenate((first[1:], [len(row)])) - 1
        return list(zip(row[first].tolist(), item[first].tolist(), start[first].tolist(), start[last].tolist()))

    def sampled(self, symbols: np.ndarray, cuts: np.ndarray, row: np.ndarray, item: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, window start) of windows and items whose samples agree in some repeat."""
        row, size, start = np.unique(np.stack([row, self.sizes[item], start], axis=1), axis=0).T
        out: set[tuple[int, int, int]] = set()
        for a in range(0, len(row), 4096):
            b = min(a + 4096, len(row))
            keys = walks(symbols, start[a:b], np.stack([cuts[row[a:b]], cuts[row[a:b] + 1]], axis=1), size[a:b])
            low, high = np.searchsorted(self.samples, keys, "left"), np.searchsorted(self.samples, keys, "right")
            for w, r in zip(*np.nonzero(high > low)):
                out.update((int(row[a + w]), int(k), int(start[a + w])) for k in self.sampled_by[low[w, r] : high[w, r]])
        return sorted(out)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, bool]]:
        """(row, item id, first word, words, distance, whether by walk) of verified items, one for each row and item."""
        symbols, cuts = hashed_words(data, offsets)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        walked: set[tuple[int, int]] = set()
        checked: dict[tuple[int, int], tuple[int, int]] = {}
        if not len(symbols) or not self.ids:
            return []
        for row, k, start, last, by_walk in self.candidates(symbols, cuts):
            n, edits = int(self.sizes[k]), int(self.edits[k])
            low, high = max(int(cuts[row]), start - edits), min(int(cuts[row + 1]), last + n + 2 * edits)
            before = checked.get((row, k))
            if before and before[0] <= low and high <= before[1]:
                continue
            checked[row, k] = (low, high)
            near = symbols[low:high]
            distance, end = edit_distance(self.words[k], near)
            if distance > edits:
                continue
            if by_walk:
                walked.add((row, k))
            _, back = edit_distance(self.words[k][::-1], near[:end][::-1])
            first = low + end - back - int(cuts[row])
            known = best.get((row, k))
            if known is None or (distance, first) < (known[0], known[1]):
                best[row, k] = (distance, first, back)
        return [(row, self.ids[k], first, length, distance, (row, k) in walked) for (row, k), (distance, first, length) in sorted(best.items())]


def leaks(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document and item found in it: the kept columns, item_id, first_word, n_words, distance, by_walk."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length(F.col("text")) + 64)).first()[0] or 0
    blocks = max(1, -(-total // (BLOCK_BYTES // 2)))
    frame = in_small_batches(docs).select(*keep, "text")
    schema = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in keep) + "item_id long, first_word long, n_words long, distance long, by_walk boolean"
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(Index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))))
        found = frame.mapInArrow(_scan(index, keep), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(index, keep):
    def run(batches):
        own = index.value
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column(len(keep)), 2 * SLICE):
                rows = own.matches(data, offsets)
                if rows:
                    row, item, begin, size, distance, by_walk = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).take(pa.array([first + r for r in row])) for i in range(len(keep))), *(pa.array(x, pa.int64()) for x in (item, begin, size, distance)), pa.array(by_walk, pa.bool_())],
                        names=[*keep, "item_id", "first_word", "n_words", "distance", "by_walk"],
                    )

    return run
