"""Array helpers that the text operators share: words, hashes and cuts over whole Arrow batches.

A batch of texts is one byte array with row offsets, so that words and hashes of
thousands of documents are found in a few numpy calls. Batches are cut into slices of
about ``SLICE`` bytes (one row at least) to bound memory; a row is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bases of the two window hashes, odd and unrelated.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BYTE_VALUES, OTHER_BYTE_VALUES = np.random.default_rng(20240117).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64),) * 2] * 2
_places = [np.zeros(0, np.uint64)] * 2


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a hash base and of its inverse, modulo 2**64."""
    if len(_powers[which][0]) < n:
        size = max(n, 2 * len(_powers[which][0]), SLICE + 1024)
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _powers[which] = tuple(both)
    return _powers[which][0][:n], _powers[which][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span, by one of two bases."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), which)[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0, which: int = 0) -> np.ndarray:
    """64-bit hashes of the spans [start, stop) of what ``prefix`` was made of, the same wherever a span
    stands. For spans of some hundred values at most: polynomials modulo 2**64 collide on
    longer ones of a certain structure. Longer spans are hashed by ``word_hash``."""
    raw = (prefix[stop] - prefix[start]) * powers(len(prefix), which)[1][start]
    return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the words [start, end) of a byte array, of any length: the sum of each byte's
    random value times a random factor for its place in the word. Two functions with unrelated values."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    longest = int(sizes.max())
    if len(_places[which]) < longest:
        _places[which] = mix(np.arange(1, max(4096, 2 * longest) + 1, dtype=np.uint64) * np.uint64(_BASES[which]) + np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], sizes)
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum((OTHER_BYTE_VALUES if which else BYTE_VALUES)[data[place + np.repeat(starts, sizes)]] * _places[which][place], out=sums[1:])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_slices(column: pa.Array, limit: int = SLICE):
    """Yields (first row, end row, bytes, offsets) over a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and each word's row; ``gaps`` tells which bytes part words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, np.minimum(starts, n), 1)
    np.add.at(depth, np.minimum(ends, n), -1)
    return np.cumsum(depth[:-1]) > 0
