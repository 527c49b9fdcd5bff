"""Content-chosen anchors: which repeated windows to look for, and where.

Of each window of ``width`` tokens (bytes or words) the leftmost ``size``-gram of least
hash is its anchor. Equal windows have equal anchors at equal offsets, so all
occurrences of a window meet under its anchor's hash, although only about two in
``width - size`` positions are kept. An anchor's *context* is the span of all windows
that chose it; two occurrences with equal contexts share all those windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.text import BYTE_VALUES, OTHER_BYTE_VALUES, covered, mix, powers, prefix_hash, span_hash, text_slices, window_minimum, word_hash, words


@dataclass
class Anchors:
    """One entry for each anchor: its row, the first window that chose it, how many did, and the anchor's offset from that window's start."""

    key: np.ndarray
    context: np.ndarray
    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    offset: np.ndarray


def find(prefix: np.ndarray, offsets: np.ndarray, width: int, size: int) -> Anchors:
    """Anchors of all rows of a slice; ``start`` counts from the row's first token. Rows shorter than a window have none."""
    n = len(prefix) - 1
    none = np.zeros(0, np.int64)
    if n < width:
        return Anchors(none.astype(np.uint64), none.astype(np.uint64), none, none, none, none)
    inverse = powers(n + 1)[1]
    keys = mix((prefix[size:] - prefix[:-size]) * inverse[: n - size + 1] + np.uint64(size))
    bits = np.uint64(max(22, n.bit_length()))
    least = window_minimum(keys >> bits << bits | np.arange(len(keys), dtype=np.uint64), width - size + 1)
    sizes = np.diff(offsets)
    end_of_row = np.repeat(offsets[1:], sizes)[: len(least)]
    windows = np.flatnonzero(np.arange(len(least)) + width <= end_of_row)
    if not len(windows):
        return find(prefix[:1], offsets, width, size)
    anchor = (least[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1))))
    first = windows[new]
    last = windows[np.concatenate((new[1:], [len(windows)])) - 1]
    anchor = anchor[new]
    row = np.searchsorted(offsets, first, "right") - 1
    context = span_hash(prefix, first, last + width, 3) ^ mix((anchor - first).astype(np.uint64))
    return Anchors(keys[anchor], context, row, first - offsets[row], last - first + 1, anchor - first)


def tokens_of(data: np.ndarray, offsets: np.ndarray, unit: str, which: int = 0):
    """Hash values of a slice's tokens, by one of two functions, and each row's token offsets; for words also their byte starts and ends."""
    if unit == "byte":
        return (OTHER_BYTE_VALUES if which else BYTE_VALUES)[data], offsets, None, None
    starts, ends, row = words(data, offsets)
    return word_hash(data, starts, ends, which), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1)))).astype(np.int64), starts, ends


#: Bytes of text whose equal contexts are settled before the shuffle.
SETTLED = 8 << 20
SCHEMA = "key long, context long, did long, uid long, pos int, windows int, off int, local boolean"


def anchors_of(docs: DataFrame, unit: str, width: int, size_of_gram: int, same_document: bool) -> DataFrame:
    """Anchors of whole texts, from ``identified`` rows.

    Within about SETTLED bytes equal contexts are already settled: all but the first are
    emitted as ``local`` repeats, so that a context held by a third of all documents
    reaches its group as a few rows from each task. With ``same_document`` a repeat
    counts inside one document too.
    """

    def settled(parts):
        key, context, d, u, pos, windows, off = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pos, u, d, context, key))
        key, context, d, u, pos, windows, off = (x[order] for x in (key, context, d, u, pos, windows, off))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        local = d != d[head]
        if same_document:
            local |= (u != u[head]) | (pos != pos[head])
        key = np.where(local, mix(d.astype(np.uint64) * np.uint64(31) + u.astype(np.uint64) + pos.astype(np.uint64)), key)
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(d), pa.array(u), pa.array(pos), pa.array(windows), pa.array(off), pa.array(local)],
            names=["key", "context", "did", "uid", "pos", "windows", "off", "local"],
        )

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            did, uid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, end, data, offsets in text_slices(batch.column(2)):
                values, cuts, _, _ = tokens_of(data, offsets, unit)
                found = find(prefix_hash(values), cuts, width, size_of_gram)
                parts.append((found.key, found.context, did[first:end][found.row], uid[first:end][found.row], found.start.astype(np.int32), found.windows.astype(np.int32), found.offset.astype(np.int32)))
                size += len(data)
                if size > SETTLED:
                    yield settled(parts)
                    parts, size = [], 0
        if parts:
            yield settled(parts)

    return docs.select("did", "uid", "text").mapInArrow(run, SCHEMA)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def listed(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """For a list column with nulls: each entry's row, and the entries."""
    column = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
    offsets = np.asarray(column.offsets)
    return np.repeat(np.arange(len(column)), np.diff(offsets)), column.flatten()


def cut_spans(docs: DataFrame, spans: DataFrame, unit: str, width: int, keep: tuple[str, ...], whole_chars: bool = False) -> DataFrame:
    """Removes from each ``identified`` row what its repeated windows (did, uid, pos, windows) cover.

    Returns the kept columns and kept (binary; words are joined by one space), n_units,
    n_removed and n_spans (runs of removed units). With ``whole_chars`` a character
    goes only if all its bytes do.
    """
    lists = spans.groupBy("did", "uid").agg(F.collect_set(F.struct("pos", "windows")).alias("spans")).hint("shuffle_hash")
    joined = docs.select("did", "uid", "text", *keep).join(lists, ["did", "uid"], "left").select("text", "spans", *keep)

    def run(batches):
        for batch in batches:
            owner, entries = listed(batch.column(1))
            pos, windows = np.asarray(entries.field("pos")).astype(np.int64), np.asarray(entries.field("windows")).astype(np.int64)
            kept, total, removed, runs = [], [], [], []
            for first, end, data, offsets in text_slices(batch.column(0)):
                starts = ends = None
                cuts = offsets
                if unit == "word":
                    starts, ends, row = words(data, offsets)
                    cuts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=end - first)))).astype(np.int64)
                a, b = np.searchsorted(owner, (first, end))
                begin = cuts[owner[a:b] - first] + pos[a:b]
                gone = covered(begin, begin + windows[a:b] - 1 + width, int(cuts[-1]))
                if whole_chars and len(gone):
                    heads = np.flatnonzero((data & 0xC0) != 0x80)
                    heads = heads if len(heads) and heads[0] == 0 else np.concatenate(([0], heads))
                    gone = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.concatenate((heads, [len(data)]))))
                changes = np.concatenate(([False], gone))
                opens = gone & ~changes[:-1]
                opens[cuts[:-1][cuts[:-1] < len(gone)]] = gone[cuts[:-1][cuts[:-1] < len(gone)]]
                gone_sum, open_sum = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(opens)))
                removed += (gone_sum[cuts[1:]] - gone_sum[cuts[:-1]]).tolist()
                runs += (open_sum[cuts[1:]] - open_sum[cuts[:-1]]).tolist()
                total += np.diff(cuts).tolist()
                if unit == "byte":
                    left = data[~gone].tobytes()
                    bounds = (cuts - gone_sum[cuts]).tolist()
                    kept += [left[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                else:
                    stay = np.flatnonzero(~gone)
                    sizes = ends[stay] - starts[stay] + 1
                    edges = np.concatenate(([0], np.cumsum(sizes)))
                    flat = np.full(int(edges[-1]), 32, np.uint8)
                    flat[ragged(edges[:-1], sizes - 1)] = data[ragged(starts[stay], sizes - 1)]
                    left = flat.tobytes()
                    bounds = edges[cuts - gone_sum[cuts]].tolist()
                    kept += [left[x : max(x, y - 1)] for x, y in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(2 + i) for i in range(len(keep))), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
                names=[*keep, "kept", "n_units", "n_removed", "n_spans"],
            )

    schema = "".join(f"`{c}` {joined.schema[c].dataType.simpleString()}, " for c in keep)
    return joined.mapInArrow(run, f"{schema}kept binary, n_units long, n_removed long, n_spans long")
