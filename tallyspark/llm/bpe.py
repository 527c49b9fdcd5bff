"""Byte-level BPE by a segment tree over byte positions.

The leaves of a piece's tree hold the rank of the pair that starts at each byte
position; every inner node holds the least rank below it, so the root and a descent
that prefers the left child give the leftmost pair of least rank. A merge changes three
leaves (the merged pair, its left and its right live neighbour) and their paths to the
root: logarithmic work, also in a piece of many thousand bytes. Trees of equal height
are updated together as rows of one array.

Results for odd input: a null text is empty and gives no ids; an empty table gives an
empty result; repeated rows give repeated results; extra columns are dropped by
``encode`` and ``decode`` except those named in ``keep``. A text of any length is read whole by one task; a single
unbroken piece takes its time in proportion to its length times the steps of its tree, each step for itself (80,000
letters took 30 s).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyspark.llm.frames import in_small_batches

NONE = np.uint32(0xFFFFFFFF)
#: Pieces that a Python worker keeps with their ids, from task to task; when full, all are forgotten.
CACHE = 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Tokenizer:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pieces = regex.compile(pattern)
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.ints = list(range(len(self.bytes_of)))  # one object for each id, shared by all cached pieces
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.uint32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), np.uint64)
        self.pair_keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.pair_ranks = np.array([pairs[int(k)] for k in keys] + [NONE], np.uint32)
        self.cache: dict[str, tuple[int, ...]] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge(self, pieces: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces, each merged in its own tree."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            step = max(1, (1 << 21) // width)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self._merge_equal([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _merge_equal(self, pieces: list[bytes], width: int) -> Iterator[tuple[int, ...]]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((n, width), NONE, np.uint32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.uint32)
        pairs = inside[:, 1:]
        tree[:, width : 2 * width - 1][pairs] = self.pair_rank(ids[:, :-1][pairs], ids[:, 1:][pairs])
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            least = tree[live, 1]
            node = np.ones(len(live), np.int64)
            while node[0] < width:
                node *= 2
                node += tree[live, node] != least
            left = node - width
            right = after[live, left]
            beyond = after[live, right]
            ids[live, left] = least
            ids[live, right] = NONE
            after[live, left] = beyond
            linked = beyond < lengths[live]
            before[live[linked], beyond[linked]] = left[linked]
            self._put(tree, live, right + width, np.full(len(live), NONE, np.uint32))
            rank = np.full(len(live), NONE, np.uint32)
            rank[linked] = self.pair_rank(least[linked], ids[live[linked], beyond[linked]])
            self._put(tree, live, left + width, rank)
            previous = before[live, left]
            has = previous >= 0
            rows, previous = live[has], previous[has]
            if len(rows):
                self._put(tree, rows, previous + width, self.pair_rank(ids[rows, previous], least[has]))
            live = live[tree[live, 1] != NONE]
        kept = ids != NONE
        flat, ends = [*map(self.ints.__getitem__, ids[kept].tolist())], np.cumsum(kept.sum(axis=1)).tolist()
        start = 0
        for end in ends:
            yield tuple(flat[start:end])
            start = end

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, rank: np.ndarray) -> None:
        """Sets a leaf of each row's tree and renews the nodes above it."""
        tree[rows, node] = rank
        node = node >> 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node >>= 1

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of new pieces into the cache."""
        if len(self.cache) + len(pieces) > CACHE:
            self.cache.clear()
        todo = []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is None:
                todo.append((piece, raw))
            else:
                self.cache[piece] = (self.ints[rank],)
        for (piece, _), ids in zip(todo, self.merge([raw for _, raw in todo])):
            self.cache[piece] = ids

    def encode(self, texts: Sequence[str | None]) -> Iterator[list[int]]:
        split = self.pieces.findall
        cut, size, group = [], 0, list(texts)
        for i, text in enumerate(group):
            cut.append(split(text) if text else [])
            size += len(text or "")
            if size > 2_000_000 or i == len(group) - 1:
                new = set().union(*cut).difference(self.cache)
                known = self.cache
                if new:
                    if len(known) + len(new) > CACHE:
                        known.clear()
                        new = set().union(*cut)
                    self.learn(new)
                for found in cut:
                    ids: list[int] = []
                    for piece in found:
                        ids += known[piece]
                    yield ids
                cut, size = [], 0

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_loaded: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file; read once in each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int), the ids of each whole text, and ``intact``, whether they decode to it."""

    def run(batches):
        own = tokenizer(path, pattern)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            ids = list(own.encode(texts))
            intact = [own.decode(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(ids, pa.list_(pa.int32())), pa.array(intact, pa.bool_())], names=[*keep, "ids", "intact"])

    frame = in_small_batches(docs).select(*keep, text)
    schema = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(run, f"{schema}, ids array<int>, intact boolean")


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``decoded`` (binary), the bytes that the ids stand for; null ids give no bytes."""

    def run(batches):
        own = tokenizer(path, pattern)
        for batch in batches:
            raw = [own.decode(ids or ()) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(raw, pa.binary())], names=[*keep, "decoded"])

    frame = in_small_batches(encoded).select(*keep, "ids")
    schema = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(run, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each whole text in one pass and returns counts and digests:
    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256.
    The ids and the bytes stay in the task, as they would be twice the text."""

    def run(batches):
        own = tokenizer(path, pattern)
        names = list(map(str, range(len(own.bytes_of))))
        for batch in batches:
            counts, id_digests, digests = [], [], []
            for ids in own.encode(batch.column(1).to_pylist()):
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                digests.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
