"""Substring and suffix dedup against brute force, and odd input."""

import random
import re

import numpy as np
import pytest

from helpers import prose, table
from tallyspark.llm import substrings, suffixes


def brute_bytes(rows, width=100):
    """By (id, text): kept bytes. Rows of one id and text are one document."""
    seen, out = {}, {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        mask = bytearray(len(raw))
        for j in range(len(raw) - width + 1):
            part = raw[j : j + width]
            if part in seen:
                mask[j : j + width] = b"\1" * width
            else:
                seen[part] = i
        out[i, text] = (bytes(b for b, m in zip(raw, mask) if not m), len(raw), sum(mask), len([x for x in bytes(mask).split(b"\0") if x]))
    return out


def brute_words(rows, width=50):
    first, out = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        mask = [0] * len(words)
        for j in range(len(words) - width + 1):
            holder = first.setdefault(tuple(words[j : j + width]), i)
            if holder != i:
                mask[j : j + width] = [1] * width
        out[i, text] = (b" ".join(w for w, m in zip(words, mask) if not m), len(words), sum(mask))
    return out


def found(frame, n):
    return sorted((str(r.doc_id), bytes(r.kept), r.n_units, r.n_removed, r.n_spans)[: n + 1] for r in frame.collect())


def wanted(rows, brute):
    return sorted((str(i), *brute[i, t]) for i, t in rows)


def test_suffixes(spark, odd):
    assert found(suffixes.remove_repeats(table(spark, odd)), 4) == wanted(odd, brute_bytes(odd))


def test_substrings(spark, odd):
    assert found(substrings.remove_repeats(table(spark, odd)), 3) == wanted(odd, brute_words(odd))


def test_words_that_differ_in_structure(spark):
    """A window that holds a word on which polynomial hashes collide is not the other's."""
    one, two = "a", "b"
    for _ in range(11):
        one, two = one + two, two + one
    left, right = prose(5, 30), prose(6, 30)
    rows = [(1, f"{left} {one} {right}"), (2, f"{left} {two} {right}"), (3, f"{left} {one} {right}")]
    got = found(substrings.remove_repeats(table(spark, rows)), 3)
    assert got == wanted(rows, brute_words(rows)) and [x[3] for x in got] == [0, 0, 61]
    assert found(suffixes.remove_repeats(table(spark, rows)), 4) == wanted(rows, brute_bytes(rows))


def test_rows_without_an_id(spark):
    """Each row loses what it has to, whoever shares its id; those without one come last."""
    low, high = -(1 << 63), (1 << 63) - 1
    passage = prose(21, 80)
    rows = [(low, passage + " one"), (high, "two " + passage), (None, passage + " three"), (None, "four five"), (3, prose(22, 60)), (3, "six " + passage)]
    by_words = {t: r for t, r in ((bytes(x.kept), x) for x in substrings.remove_repeats(table(spark, rows)).collect())}
    assert len(by_words) == 6 and by_words[b"two"].n_removed == by_words[b"six"].n_removed == by_words[b"three"].n_removed == 80
    assert found(suffixes.remove_repeats(table(spark, rows)), 4) == wanted(rows, brute_bytes(rows))


@pytest.mark.parametrize("batches", [1, 7])
def test_batches_agree(spark, odd, batches):
    assert found(substrings.remove_repeats(table(spark, odd), batches=batches), 3) == wanted(odd, brute_words(odd))


def test_compaction_and_later_sessions(spark, odd):
    """Runs are compacted on the way, and an index that was opened again goes on where it was."""
    rows = substrings.identified(table(spark, odd), "doc_id")
    index = substrings.FingerprintIndex(spark, fanout=2)
    home = index.home
    for part in substrings._batches(rows, 5):
        index.add(part)
        assert len(index.runs) < 2 + (index.state["fanout"] > 2)
        index = substrings.FingerprintIndex(spark, home=home)
    cut = substrings.cut_spans(rows, index.repeated(rows), "word", 50, ("doc_id",))
    assert found(cut, 3) == wanted(odd, brute_words(odd))
    index.close()


@pytest.mark.parametrize("step", ["_told", "_write"])
def test_a_killed_batch(spark, odd, monkeypatch, step):
    """A session that ends in the middle of a batch, or before its manifest: the next one opens the index as it was and adds the batch again."""
    rows = substrings.identified(table(spark, odd), "doc_id")
    parts = substrings._batches(rows, 3)
    index = substrings.FingerprintIndex(spark)
    index.add(parts[0])
    whole, calls = getattr(substrings.FingerprintIndex, step), []

    def killed(self, *some):
        calls.append(1)
        if step == "_told" or len(calls) == 2:
            raise KeyboardInterrupt
        return whole(self, *some)

    monkeypatch.setattr(substrings.FingerprintIndex, step, killed)
    with pytest.raises(KeyboardInterrupt):
        index.add(parts[1])
    monkeypatch.undo()
    again = substrings.FingerprintIndex(spark, home=index.home)
    assert len(again.runs) == 1
    again.add(parts[1])
    again = substrings.FingerprintIndex(spark, home=index.home)
    again.add(parts[2])
    cut = substrings.cut_spans(rows, again.repeated(rows), "word", 50, ("doc_id",))
    assert found(cut, 3) == wanted(odd, brute_words(odd))
    again.close()


def test_history_is_not_moved(spark, odd, monkeypatch):
    """The merge of a batch with the runs has no exchange."""
    rows = substrings.identified(table(spark, odd), "doc_id")
    index = substrings.FingerprintIndex(spark, fanout=9)
    plans = []
    write = substrings.FingerprintIndex._write
    monkeypatch.setattr(substrings.FingerprintIndex, "_write", lambda self, frame, path, *parts: (plans.append(frame._jdf.queryExecution().executedPlan().toString()) if parts else None, write(self, frame, path, *parts))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part in substrings._batches(rows, 3):
            index.add(part)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 3 and "SortMergeJoin" in plans[-1] and not [p for p in plans if "Exchange" in p]
    index.close()


def test_edited_passages(spark):
    passage = prose(9, 140)
    rows = [(i, prose(100 + i, 40) + (" " if i % 2 else "\n") + " ".join(w if (k + i) % 37 else f"edit{i}" for k, w in enumerate(passage.split())) + " " + prose(200 + i, 30)) for i in range(40)]
    assert found(suffixes.remove_repeats(table(spark, rows)), 4) == wanted(rows, brute_bytes(rows))
    rows = [(i, t.replace("edit", "") if i % 3 else t) for i, t in rows]
    short = [(i, " ".join(t.split()[:90])) for i, t in rows]
    assert found(substrings.remove_repeats(table(spark, short), width=12, size=4), 3) == wanted(short, brute_words(short, 12))


def test_run_index_by_definition():
    """Neighbours and matches that are streamed from samples at run ends, against sorted suffixes; repeats, against sets."""
    draw = random.Random(7)
    for _ in range(200):
        letters, width = draw.randrange(1, 4), draw.randrange(1, 7)
        phrases = [bytes(draw.randrange(letters) for _ in range(draw.randrange(1, 30))) for _ in range(draw.randrange(1, 6))]
        flat, sizes = np.frombuffer(b"".join(phrases), np.uint8), np.array([len(x) for x in phrases])
        seen, want = set(), []
        for x in phrases:
            for j in range(len(x)):
                part = x[j : j + width]
                want.append(len(part) == width and part in seen)
                seen.add(part)
        assert suffixes.repeats(flat, sizes, width).tolist() == want
        symbols = [y for k, x in enumerate(phrases) for y in [*(c + len(phrases) for c in x), k]]
        order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        before, match = suffixes.RunIndex.build(np.array(symbols)).stream(0, len(symbols))
        for x, y in zip(order[:-1], order[1:]):
            assert before[y] == x and match[y] == next(k for k, (a, b) in enumerate(zip(symbols[x:], symbols[y:])) if a != b)


def test_run_index_is_short_and_decides(monkeypatch):
    """Many edited copies: far fewer samples than places, and the index decides the windows that no equal context does."""
    made, build = [], suffixes.RunIndex.build
    base = prose(31, 150).encode()
    copies = [base[: 40 * k] + b"#%d#" % k + base[40 * k + 4 :] for k in range(1, 20)]
    flat, sizes = np.frombuffer(b"".join(copies), np.uint8), np.array([len(x) for x in copies])
    monkeypatch.setattr(suffixes.RunIndex, "build", lambda symbols: made.append((len(symbols), len((index := build(symbols)).head))) or index)
    decided = int(suffixes.repeats(flat, sizes, 100).sum())
    assert made[0][1] * 5 < made[0][0] and decided > len(flat) / 2


def test_oversized_groups(spark, monkeypatch):
    """Blocks so small that groups are cut off, go on, and are settled by window hashes."""
    passage = prose(11, 60)
    rows = [(i, prose(300 + i, 12) + " " + passage[i % 23 :] + " " + prose(400 + i, 12)) for i in range(60)]
    want = wanted(rows, brute_bytes(rows))
    for block, hot in ((500, 1 << 20), (500, 2000), (1, 1)):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        monkeypatch.setattr(suffixes, "HOT", hot)
        assert found(suffixes.remove_repeats(table(spark, rows)), 4) == want


def test_whole_characters(spark):
    rows = [(1, "ab" + "é" * 80 + "cd"), (2, "x" + "é" * 80 + "y")]
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffixes.remove_repeats(table(spark, rows), whole_chars=True).collect()}
    assert kept[2][0] == "x" and kept[2][-1] == "y"


@pytest.mark.parametrize("operator", [suffixes.remove_repeats, substrings.remove_repeats])
def test_empty_table(spark, operator):
    assert operator(table(spark, [])).collect() == []
