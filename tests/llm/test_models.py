"""Tokens, languages, scores, fingerprints, leaks, chats and licences: brute force, round trips, held-out accuracy, odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from helpers import prose, table
from tallyspark.llm import bpe, chat, decontaminate, language, licences, mixing, spots

RANKS = P.path("byte_bpe_50k.tiktoken")


def test_bpe(spark, odd):
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = bpe.round_trip(table(spark, odd), RANKS, P.PATTERN).collect()

    def digest(ids, raw):
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()

    want = sorted((str(i), *digest(model.encode_ordinary(t or ""), (t or "").encode())) for i, t in odd)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    encoded = bpe.encode(table(spark, odd), RANKS, P.PATTERN)
    assert encoded.where("not intact").count() == 0
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()) == sorted((str(i), (t or "").encode()) for i, t in odd)
    assert bpe.encode(table(spark, []), RANKS, P.PATTERN).collect() == []


def test_bpe_pieces():
    own = bpe.Tokenizer(RANKS, P.PATTERN)
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    draw = random.Random(4)
    texts = ["".join(draw.choice("aab  '\n\tsétx1😀.!") for _ in range(draw.randrange(1, 200))) for _ in range(200)] + ["a" * 3000, "é" * 999]
    assert list(own.encode(texts)) == [model.encode_ordinary(t) for t in texts]


def test_language(spark):
    letters = {"xx": "abcde", "yy": "vwxyz", "zz": "abxyé"}
    draw = random.Random(2)
    text = lambda k: " ".join("".join(draw.choice(letters[k]) for _ in range(draw.randrange(2, 7))) for _ in range(60))
    rows = [(i, text(k), k) for i, k in enumerate(draw.choice(list(letters)) for _ in range(150))]
    model = language.fit(table(spark, rows[:100]))
    odd = [(900, None, "xx"), (901, "", None), (902, "12 !!", "xx"), (903, "b", "xx"), (904, "qqqq kkkk jjjj " * 20, None)]
    got = {r.doc_id: r for r in language.predict(table(spark, rows[100:] + odd), model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows[100:]]) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred in letters and got[904].score < language.REJECT
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.fit(table(spark, []))
    assert {r.lang_pred for r in language.predict(table(spark, rows[:3]), nothing).collect()} == {"und"}


def kneser_ney(words, floor):
    """Interpolated Kneser-Ney by dictionaries: the probability of a character after those before it in its word."""
    raw, before = [Counter() for _ in range(language.ORDER + 1)], [{} for _ in range(language.ORDER + 1)]
    for word, n in words.items():
        text = "^" + word + "$"
        for end in range(1, len(text)):
            for size in range(1, min(language.ORDER, end + 1) + 1):
                gram = text[end + 1 - size : end + 1]
                raw[size][gram] += n
                if size < language.ORDER and end >= size:
                    before[size].setdefault(gram, set()).add(text[end - size])
    counts = [None] + [Counter({g: len(before[k][g]) if g in before[k] else n for g, n in raw[k].items()}) for k in range(1, language.ORDER + 1)]
    discounts = [None]
    for found in counts[1:]:
        once, twice = (sum(n == k for n in found.values()) for k in (1, 2))
        discounts.append(once / (once + 2 * twice) if once and twice else 0.5)
    totals, kinds = Counter(), Counter()
    for k in range(1, language.ORDER + 1):
        for gram, n in counts[k].items():
            totals[k, gram[:-1]] += n
            kinds[k, gram[:-1]] += 1

    def probability(context, c):
        p = floor
        for k in range(1, min(language.ORDER, len(context) + 1) + 1):
            history = context[len(context) + 1 - k :]
            if (k, history) in totals:
                d = discounts[k]
                p = max(counts[k][history + c] - (d if history + c in counts[k] else 0), 0) / totals[k, history] + d * kinds[k, history] / totals[k, history] * p
        return p

    return probability


def test_kneser_ney_by_definition():
    """Costs of words, seen and not, are those of the definition, for each language."""
    draw = random.Random(8)
    made = {name: Counter("".join(draw.choice(letters) for _ in range(draw.randrange(1, 9))) for _ in range(200)) for name, letters in (("a", "abcde"), ("b", "cdeé"))}
    for words in made.values():
        for word in list(words)[::3]:
            words[word] += draw.randrange(5)
    model = language.train([(name, w, n) for name, words in made.items() for w, n in words.items()])
    asked = [*list(made["a"])[:60], *list(made["b"])[:60], "x", "abcdeabcdeabcde", "éé", *("".join(draw.choice("abcdeéz") for _ in range(draw.randrange(1, 12))) for _ in range(150))]
    raw = [w.encode() for w in asked]
    entropy, chars = model.entropies(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    for k, name in enumerate(model.languages):
        p = kneser_ney(made[name], model.floor)
        want = [sum(-np.log2(p("^" + w[:i], c)) for i, c in enumerate(w + "$")) for w in asked]
        assert np.allclose(entropy[:, k] * chars, want, rtol=1e-9)
        for context in ("^", "^ab", "^cde", "^éc"):
            total = sum(p(context, c) for c in "abcdeé$")
            assert total <= 1 + 1e-9  # the rest is that of characters which no language has


def test_kneser_ney_sums_to_one():
    words = [("a", w, n) for w, n in Counter("".join(random.Random(i).choice("abc") for _ in range(4)) for i in range(60)).items()]
    model = language.train(words)
    total = 0.0
    for last in ("a", "b", "c", "\x02"):
        text = "\x01ab" + last
        symbols = np.array([ord(c) for c in text], np.uint64)
        place = np.arange(len(text))
        p = model.floor
        for order in range(1, language.ORDER + 1):
            if place[-1] < order - 1:
                break
            key, context = language.gram_keys(symbols, order)[-1], language.gram_keys(symbols, order - 1, 1)[-1]
            (grams, probability), (known, weight) = model.grams[order - 1], model.contexts[order - 1]
            i, j = np.searchsorted(grams, key), np.searchsorted(known, context)
            own = probability[i][0] if i < len(grams) and grams[i] == key else 0.0
            p = own + (weight[j][0] if j < len(known) and known[j] == context else 1.0) * p
        total += p
    assert abs(total + model.floor * 0 - 1) < 0.05


def signature_set(text):
    """Signatures from their definition, as tuples of words."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    common = {w.encode() for w in spots.ANCHORS}
    content = [i for i, w in enumerate(words) if w not in common]
    out, last = set(), None
    for i, w in enumerate(words):
        if w in common:
            last = i
            chain = [words[j] for j in content if j > i][: spots.CHAIN]
            out |= {("after", w, *chain)} if len(chain) == spots.CHAIN else set()
        elif last is None or i - last > spots.ALONE:
            chain = [words[j] for j in content if j >= i][: spots.CHAIN]
            out |= {("from", *chain)} if len(chain) == spots.CHAIN else set()
    if not out:
        out = {("from", *words[i : i + spots.CHAIN]) for i in range(len(words))}
    return out or ({("bytes", text)} if text else set())


def test_fingerprints_by_definition(spark, odd, monkeypatch):
    """Ids that lie far apart, are shared or missing, in many buckets: neighbours, edits and likeness from their definitions."""
    monkeypatch.setattr(spots, "BUCKET", 3)
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, prose(1, 80)), (-5, prose(2, 80)), (10**18, prose(2, 80) + " more"), (9 * 10**18, "?!"), (high, prose(3, 20)), (7, ""), *[(8, prose(30 + k, 30)) for k in range(9)], *[(100 + k, prose(60 + k % 5, 40 + k)) for k in range(12)], (300, "the of und"), (301, "wort " * 12)]
    rows += [(None, prose(80 + k, 25)) for k in range(9)]
    got = spots.compare_with_next(table(spark, rows)).collect()
    assert len(got) == len(rows)
    named = sorted([(i, t) for i, t in rows if i is not None and i != 8], key=lambda r: -r[0])
    found = {r.doc_id: r for r in got}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for (i, text), (j, following) in zip(named, named[1:]):
        if 7 in (i, j) or i - 8 == 0 or (i > 8 > j):
            continue  # the order of the rows that share an id is that of a hash
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        one, two, three = signature_set(text), signature_set(edited), signature_set(following)
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (pytest.approx(like(one, two)), pytest.approx(like(one, three)))
        assert r.fingerprint.startswith(f"{len(one)}:") and (r.fingerprint == r.edited_fingerprint) == (one == two)
    # the first by descending id among those without one is that of the greatest hash, after the last row comes the first again
    shared = [r for r in got if r.doc_id == 8]
    assert len(shared) == 9 and len([r for r in got if r.doc_id is None]) == 9


def test_mixing(spark, odd):
    rows = odd + [(1000 + i, prose(500 + i % 40, 80)) for i in range(120)]
    got = mixing.score(table(spark, rows)).collect()
    tokens = lambda t: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base(t), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held_rows = [r for r in got if r.held_out and r.n_tokens > 50]
    assert held_rows and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)
    assert mixing.score(table(spark, [])).collect() == []
    alone = mixing.score(table(spark, [(i, "a b") for i in range(200) if held(i)])).collect()
    assert alone and all(r.train_tokens == 0 and r.n_known == 0 for r in alone)


class PlainMixing:
    """The scores from their definition: dictionaries of counts by the words themselves, one bit at a time."""

    def __init__(self, rows, fit=True):
        self.texts = [(i, [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None]) for i, t in rows]
        self.trains = [not (i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, _ in self.texts]
        self.words = Counter(w for (_, t), own in zip(self.texts, self.trains) if own for w in t)
        self.after, self.leaf, self.types = Counter(), Counter(), Counter()
        for w, n in self.words.items():
            self.leaf[self.code(w)] += n
            self.types[self.code(w)] += 1
        for (_, t), own in zip(self.texts, self.trains):
            for at in range(len(t) if own else 0):
                for context, depth in self.contexts(t, at):
                    for k in range(depth + 1):
                        self.after[context, k, self.code(t[at]) >> (mixing.BITS - k)] += 1
        self.weights = np.full((mixing.BITS * mixing.KINDS, mixing.INPUTS), 0.3)
        self.refined = np.tile(1 / (1 + np.exp(-mixing.LEVELS)), (mixing.BITS, 1))
        if fit:
            self.learn()

    def code(self, w):
        n = self.words[w]
        if w is None and n:
            return mixing.END_CODE
        if w is None:
            return mixing.END_CODE
        if not n:
            return 0
        raw = np.frombuffer(w, np.uint8)
        h = int(mixing.word_hash(raw, np.array([0]), np.array([len(raw)]))[0])
        return min(1 + int(math.log2(n)), mixing.END_CLASS - 1) << mixing.HASH_BITS | h >> (64 - mixing.HASH_BITS)

    def contexts(self, t, at):
        kinds = [self.code(w) >> mixing.HASH_BITS for w in t[:at]]
        one, two = (kinds[-k] if at >= k else mixing.END_CLASS for k in (1, 2))
        lately = sum(k == 0 for k in kinds[-16:])
        stop = at == 0 or t[at - 1][-1:] in (b".", b"!", b"?", b":", b";", b",")
        steps = sum(lately >= x for x in (1, 2, 4, 8))
        return [(("A", one, two), 5), (("B", stop, one, steps, min(at, 3)), 5), (("1", t[at - 1] if at else ""), mixing.DEPTHS[1]), (("2", t[at - 1] if at else "", t[at - 2] if at > 1 else ""), mixing.DEPTHS[2])]

    def mass(self, code, k, own):
        low = code >> (mixing.BITS - k)
        return sum(n + 0.1 * self.types[c] for c, n in self.leaf.items() if c >> (mixing.BITS - k) == low) + 0.1 * (low == 0) - own

    def sure(self, code, bit):
        return self.mass(code ^ 1 << (mixing.BITS - 1 - bit), bit + 1, 0) < 0.05

    def inputs(self, t, at, bit, code, own):
        value = code >> (mixing.BITS - 1 - bit) & 1
        other = code ^ 1 << (mixing.BITS - 1 - bit)
        sign = 1 if value else -1
        took, left = max(self.mass(code, bit + 1, own), 0.05), max(self.mass(other, bit + 1, 0), 0.05)
        x = [sign * min(12, max(-12, math.log(took / left))), 0, 0, 0, 0, 0.3]
        gate = 0
        for k, (context, depth) in enumerate(self.contexts(t, at)):
            if bit >= depth:
                continue
            n, m = (self.after[context, b, code >> (mixing.BITS - b)] for b in (bit, bit + 1))
            if k < 2:
                x[1 + k] = sign * (math.log(max(m - own, 0) + 0.3) - math.log(n - m + 0.3))
            else:
                seen = min(n, mixing.MANY) - own
                gate += min(2, max(0, seen)) if k == 3 else 3 * (seen > 0)
                log = lambda v: math.log(max(v, 0) + 0.15)
                if n <= 8:
                    x[1 + k] = sign * (log(m - own) - log(n - m))
                else:
                    steps = min(9, max(-9, round(log(m) - log(n - m))))
                    x[1 + k] = sign * (steps + (log(m - own) - log(m) if m <= 8 else 0))
        return np.array(x), bit * mixing.KINDS + gate, value

    def bits(self, t, at, code, own):
        """Bits with inputs, then how many are coded by the counts."""
        for bit in range(mixing.BITS):
            x, gate, value = self.inputs(t, at, bit, code, own)
            if bit >= 5 and (not 0 < code >> mixing.HASH_BITS < mixing.END_CLASS or gate == bit * mixing.KINDS):
                break
            yield bit, x, gate, value

    def learn(self):
        moved, used = np.zeros_like(self.weights), np.zeros(len(self.weights))
        heard, ones = np.zeros_like(self.refined), np.zeros_like(self.refined)
        for (_, t), own in zip(self.texts, self.trains):
            for first in range(0, len(t) if own else 0, mixing.SEGMENT):
                weights, uses = self.weights.copy(), np.zeros(len(used))
                for at in range(first, min(first + mixing.SEGMENT, len(t))):
                    for bit, x, gate, value in self.bits(t, at, self.code(t[at]), 1):
                        if self.sure(self.code(t[at]), bit):
                            continue
                        dot = float(np.clip(weights[gate] @ x, -12, 12))
                        weights[gate] += mixing.RATE * (value - 1 / (1 + math.exp(-dot))) * x
                        uses[gate] += 1
                        cell = int((min(8, max(-8, dot)) + 8.25) * 2)
                        heard[bit, cell] += 1
                        ones[bit, cell] += value
                moved += (weights - self.weights) * uses[:, None]
                used += uses
        self.weights += moved / np.maximum(used, 1)[:, None]
        self.refined = (self.refined * 20 + ones) / (20 + heard)

    def log10(self, t, at, w, own):
        """log10 of the probability that w stands at a place of a text."""
        code, total, bit = self.code(w), 0.0, -1
        for bit, x, gate, value in self.bits(t, at, code, own):
            if self.sure(code, bit):
                continue
            dot = float(np.clip(self.weights[gate] @ x, -12, 12))
            one = 0.5 / (1 + math.exp(-dot)) + 0.5 * self.refined[bit, int((min(8, max(-8, dot)) + 8.25) * 2)]
            total += math.log10(max(one if value else 1 - one, 1e-6))
        if 0 < code >> mixing.HASH_BITS < mixing.END_CLASS:
            total += math.log10((self.words[w] - own + 0.1) / self.mass(code, bit + 1, own))
        return total

    def scores(self):
        return [(str(i), round(sum(self.log10(t, at, t[at], int(own)) for at in range(len(t))), 2)) for (i, t), own in zip(self.texts, self.trains)]


def mixing_rows():
    rows = [(i, prose(900 + i % 9, 12 + i % 5, 60) + (". And so on: the end, " + prose(900 + i % 4, 8) if i % 3 else "")) for i in range(34)]
    return [*rows, (40, None), (41, ""), (42, "one"), (None, "of the end"), (42, prose(901, 9)), (9, rows[8][1])]


def test_mixing_by_definition(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FIT_SHARE", 1.0)
    rows = mixing_rows()
    got = [(str(r.doc_id), r.score) for r in mixing.score(table(spark, rows)).collect()]
    for (i, a), (j, b) in zip(sorted(got), sorted(PlainMixing(rows).scores())):
        assert i == j and a == pytest.approx(b, abs=0.02)


def test_mixing_sums_to_one():
    """All words that may follow, known, unknown and the end, have probabilities that sum to one in a held-out text."""
    model = PlainMixing(mixing_rows())
    _, text = model.texts[3]
    for at in (0, 3, 7):
        chance = sum(10 ** model.log10(text, at, w, 0) for w in [*model.words, b"never seen"])
        assert chance == pytest.approx(1, abs=1e-4)


def test_mixing_learns_from_a_share_and_leaves_no_tables(spark):
    """The more training texts of a language in which words follow from those before, the more probable its held-out texts; no table stays in the catalogue."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    draw, rows = random.Random(6), []
    for i in range(1200):
        words = [draw.randrange(500)]
        for _ in range(60):
            words.append((words[-1] * 7 + draw.choice([1, 2, 3, 90])) % 500)
        rows.append((i, " ".join(f"w{w}" for w in words)))
    asked = [i for i, _ in rows if held(i) and i < 300]

    def score(n):
        found = mixing.score(table(spark, [r for r in rows if r[0] < n])).where("held_out").collect()
        return sum(r.score for r in found if r.doc_id in asked)

    assert score(300) < score(600) < score(1200)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("mixing_")]


def test_mixing_learns_side_by_side(monkeypatch):
    """Evidence is looked up once for each bit of some pieces, not for each token of a text, and what is learned doesn't depend on the pieces that lie side by side."""
    draw, calls = random.Random(8), []
    texts = [" ".join(f"w{min(draw.randrange(60), draw.randrange(60))}" for _ in range(draw.randrange(1, 200))).encode() for _ in range(30)]
    hashes, row, about = mixing.tokens(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    known, first, which, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(known))
    sizes = np.bincount(row)
    batch = mixing.Batch({"ids": [*range(30)], "held": [i % 7 == 0 for i in range(30)], "sizes": sizes, "bytes": sizes, "hashes": mixing.ascending(known), "about": mixing.packed(about[first]), "times": mixing.packed(times), "stream": mixing.packed(rank[which])})
    batch.code(batch.counted())
    leaves = {c: (int(batch.counts[batch.codes == c].sum()), int((batch.codes == c).sum())) for c in set(batch.codes.tolist())}
    told = []
    for kind in mixing.DEPTHS:
        keys, at = batch.pairs(kind, 24)
        own, runs = np.unique(keys >> np.uint64(mixing.BITS), return_counts=True)
        codes, found = keys & np.uint64((1 << mixing.BITS) - 1), np.bincount(at, batch.trains, len(keys))
        told.append({"part": 0, "batch": 0, "kind": kind, "slots": mixing.ascending(own), "runs": mixing.packed(runs), "codes": mixing.packed(codes), "times": mixing.packed(found)})
    answers = [r for r in mixing._tell_contexts(pa.Table.from_pylist(told)).to_pylist() if r["batch"] == 0]
    evidence = mixing.Evidence(batch, answers, mixing.Model(leaves), 24)
    look = mixing.Some.inputs
    monkeypatch.setattr(mixing.Some, "inputs", lambda *a: calls.append(1) or look(*a))
    sums = mixing.learned_sums(evidence)
    assert sums.any() and len(calls) <= mixing.BITS
    monkeypatch.setattr(mixing, "LANES", 300)
    apart = mixing.learned_sums(evidence)
    assert len(calls) > 2 * mixing.BITS and np.abs(apart - sums).max() <= 1e-5 * np.abs(sums).max()


def test_mixing_is_of_the_whole_corpus_and_of_training_texts_only(spark, monkeypatch):
    """Neither the size of batches nor held-out texts make a difference; equal texts score alike."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rows = [(i, " ".join(f"{a} {b} {c}" for a, b, c in zip(*[iter(prose(500 + i % 40, 81).split())] * 3))) for i in range(200)]
    rows += [(1000 + i, prose(5, 40)) for i in range(30)]

    def scores(some):
        return {r.doc_id: (r.n_tokens, pytest.approx(r.score, abs=1e-3)) for r in mixing.score(table(spark, some)).collect()}

    whole = scores(rows)
    without = {i: r for i, r in whole.items() if not held(i) or i % 2}
    monkeypatch.setattr(mixing, "BATCH_BYTES", 4 << 10)
    assert scores(rows) == whole
    assert scores([r for r in rows if r[0] in without]) == without
    for kind in (True, False):
        same = [x[1].expected for i, x in whole.items() if i >= 1000 and held(i) == kind]
        assert same and max(same) - min(same) < 1e-6


def test_fingerprints(spark, odd):
    rows = [r for r in odd if r[0] != 20]
    got = {str(r.doc_id): r for r in spots.compare_with_next(table(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, -(r[0] or 0)))
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        edited = spots.edited_text(text or "", following or "")
        assert (got[str(i)].n_chars, got[str(i)].edited_sha256) == (len(text or ""), hashlib.sha256(edited.encode()).hexdigest())
        one, two, three = spots._sets([(text or "").encode(), edited.encode(), (following or "").encode()])
        assert got[str(i)].fingerprint == spots.fingerprint(one)
        assert got[str(i)].near_edited == pytest.approx(spots.likeness(one, two)) and got[str(i)].near_next == pytest.approx(spots.likeness(one, three))
    assert got["1"].fingerprint == got["2"].fingerprint != got["3"].fingerprint
    assert got["4"].fingerprint == got["5"].fingerprint == ""
    assert spots.compare_with_next(table(spark, [])).collect() == []
    (only,) = spots.compare_with_next(table(spark, [(5, prose(1, 50))])).collect()
    assert only.near_next == 1.0


def test_similar_pairs(spark):
    draw = random.Random(6)
    rows = []
    for group in range(5):
        base = prose(600 + group, 200).split()
        for k in range(6):
            words = list(base)
            for _ in range(k):
                words[draw.randrange(len(words))] = "changed"
            rows.append((10 * group + k, " ".join(words)))
    sets = dict(zip([i for i, _ in rows], spots._sets([t.encode() for _, t in rows])))
    first = {}
    for i, s in sets.items():
        first.setdefault(s.tobytes(), i)
    want = {(a, b) for a in first.values() for b in first.values() if a < b and spots.likeness(sets[a], sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in spots.similar_pairs(spots.fingerprints(table(spark, rows)), 80).collect()} == want and want


def test_alike_sends_no_set_for_each_pair(spark, monkeypatch):
    """What is shuffled for a group of near copies grows with its documents, not with its pairs; all pairs are found, also over many blocks."""
    draw, base = random.Random(9), prose(77, 1500, 5000).split()
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    def near(n):
        rows = []
        for i in range(n):
            words = list(base)
            for _ in range(draw.randrange(1, 60)):
                words[draw.randrange(len(words))] = f"own{draw.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        prints = spots.stored(spots.fingerprints(table(spark, rows)))
        before = shuffled()
        got = {(r.x, r.y): r.likeness for r in spots.alike(prints, 80).collect()}
        sets = {spots.fingerprint(s): s for s in spots._sets([t.encode() for _, t in rows])}
        want = {(a, b): spots.likeness(sets[a], sets[b]) for a in sets for b in sets if a < b}
        want = {pair: like for pair, like in want.items() if like >= 0.8}
        assert got == pytest.approx(want) and 0 < len(want) < len(sets) * (len(sets) - 1) // 2
        return shuffled() - before

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        few, many = near(30), near(120)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert many < 8 * few, (few, many)
    monkeypatch.setattr(spots, "BLOCK", 7)
    near(40)


@pytest.mark.parametrize("sample", [20_000, 5])
def test_classes(spark, odd, monkeypatch, sample):
    """Each document's class and links are those of all pairs, however signatures are ordered; copies, empty and odd texts."""
    monkeypatch.setattr(spots, "SAMPLE", sample)
    draw = random.Random(4)
    base = [prose(300 + k, 80).split() for k in range(4)]
    rows = [r for r in odd if r[0] is not None]
    for i in range(100, 180):
        words = list(base[i % 4])
        for _ in range(draw.randrange(0, 6)):
            words[draw.randrange(len(words))] = f"v{draw.randrange(50)}"
        rows.append((i, " ".join(words[: draw.choice([80, 78, 60])])))
    rows += [(200 + i, rows[-1 - i][1]) for i in range(30)] + [(300, "the"), (301, "of the"), (302, "x y z")]
    sets = spots._sets([(t or "").encode() for _, t in rows])
    names = [spots.fingerprint(s) for s in sets]
    kinds = dict(zip(names, sets))
    links = {n: sum(100 * len(np.intersect1d(s, o)) >= 80 * len(np.union1d(s, o)) for m, o in kinds.items() if m != n and len(o)) if len(s) else 0 for n, s in kinds.items()}
    least = {n: min(i for (i, _), m in zip(rows, names) if m == n) for n in kinds}
    got = sorted(map(tuple, spots.classes(table(spark, rows), 80).collect()))
    assert got == sorted((i, n, least[n], links[n]) for (i, _), n in zip(rows, names)) and sum(links.values()) > 50
    assert spots.classes(table(spark, []), 80).collect() == []
    assert sorted(map(tuple, spots.classes(table(spark, [(None, None), (None, "a b c d"), (1, None)]), 80).collect()), key=str) == sorted([(None, "", 1, 0), (1, "", 1, 0), (None, spots.fingerprint(spots._sets([b"a b c d"])[0]), None, 0)], key=str)


def best_distance(item, text):
    """Least word edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        below = [i + 1]
        for j, x in enumerate(text):
            below.append(min(row[j] + (w != x), row[j + 1] + 1, below[j] + 1))
        row = below
    return min(row)


def test_leaks(spark):
    draw = random.Random(3)
    items = [(i, prose(700 + i, draw.randrange(1, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "...")]
    plain = lambda t: re.findall(r"[a-z0-9é]+", (t or "").lower())
    rows, n = [(0, None), (1, ""), (2, "!!")], 3
    for edit in (0.0, 0.1, 0.2, 0.4):
        for _, t in items[:30]:
            words = t.split()
            for _ in range(int(edit * len(words))):
                how, at = draw.randrange(3), draw.randrange(len(words))
                words[at : at + (how != 2)] = [] if how == 0 and len(words) > 1 else [f"new{draw.randrange(99)}"]
            rows.append((n, prose(2000 + n, 60) + " " + " ".join(words).upper().replace("É", "é") + ", " + prose(3000 + n, 40)))
            n += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(table(spark, rows), bench).collect()
    want = {}
    for d, t in rows:
        for i, x in items:
            if plain(x) and (k := best_distance(plain(x), plain(t))) <= decontaminate.budget(len(plain(x))):
                want[d, i] = k
    got = {(r.doc_id, r.item_id): r.distance for r in found}
    assert got == want
    sizes = {i: len(plain(x)) for i, x in items}
    walked = [r.by_walk for r in found if sizes[r.item_id] >= 5]
    assert sum(walked) >= 0.95 * len(walked) > 0
    assert decontaminate.leaks(table(spark, []), bench).collect() == [] == decontaminate.leaks(table(spark, rows[:9]), bench.limit(0)).collect()


def test_chat(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", None),
        (2, "chosen", 0, None, "same"), (2, "rejected", 0, None, "same"), (3, "chosen", 0, "user", "alone"), (None, "chosen", 0, "user", "x"), (4, "chosen", None, "user", "b"), (4, "chosen", None, "user", "a"), (4, "rejected", 0, "user", "a"), (4, "chosen", 1, "user", "a"),
    ]
    frame = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").withColumn("prompt", F.lit("x"))
    got = {r.pair_id: r for r in chat.format_preferences(frame).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].n_prompt, got[1].prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert (got[1].chosen, got[1].chosen_mask) == ("<|assistant|>\nyes<|end|>\n", "14:0 11:1")
    assert got[1].rejected == "<|assistant|>\nno<|end|>\n<|user|>\n<|end|>\n" and got[1].rejected_mask == "14:0 10:1 17:0"
    assert (got[2].n_prompt, got[2].prompt, got[2].chosen, got[2].rejected) == (1, "<|unknown|>\nsame<|end|>\n", "", "")
    assert (got[3].n_prompt, got[3].n_rejected, got[3].rejected, got[3].chosen) == (0, 0, "", "<|user|>\nalone<|end|>\n")
    assert (got[4].n_prompt, got[4].n_chosen) == (1, 3)
    assert chat.format_preferences(frame.limit(0)).collect() == []


def test_continuations(spark):
    """Conversations with null roles, texts and turns, repeated turns, one reply, none, and an empty table, by the definition."""
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, "user", "only"), (3, 0, "user", "q"), (3, 1, "assistant", None),
        (4, None, None, "lost"), (4, 0, "assistant", "x"), (4, 0, "assistant", "x"), (5, 0, "assistant", "same"), (5, 1, "assistant", "same"), (None, 0, "user", "nobody"), (6, 0, None, None), (7, 0, "user", "y" * 100_000), (7, 1, "assistant", "z" * 100_000),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"pair_id": F.lit(1), "turns": F.lit("x"), "chosen": F.lit("x")})
    key = lambda x: tuple((v is not None, v) for v in x)
    got = {r.pair_id: ([(t.role, t.text) for t in r.chosen], [(t.role, t.text) for t in r.rejected]) for r in chat.continuations(frame).collect()}
    want = {}
    for c in range(1, 8):
        rows = [(r, t) for _, r, t in sorted((x[1:] for x in turns if x[0] == c), key=key)]
        replies = [i for i, (r, _) in enumerate(rows) if r == "assistant"]
        want[c] = (rows, rows) if not replies else (rows[: replies[-1] + 1], rows[: replies[-1]] + ([rows[replies[-2]]] if len(replies) > 1 else []))
    assert got == want
    whole = {r.pair_id: r for r in chat.format_sides(chat.continuations(frame)).collect()}
    assert whole[5].chosen == whole[5].rejected == "" and len(whole[7].chosen) > 100_000 and whole[2].n_prompt == 1
    assert chat.continuations(frame.limit(0)).collect() == [] == chat.format_sides(chat.continuations(frame.limit(0))).collect()


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, f"Title\n{mit}\n{notice}"), (2, notice), (3, "A b. Released under the MIT License. All rights reserved."), (4, None), (5, ""), (6, "This  work is LICENSED under the GNU General Public License, version 3!"), (7, "no licence here"), (7, "no licence here")]
    got = sorted((r.doc_id, r.sentence_ids, r.licences, r.licence) for r in licences.scan(table(spark, rows)).collect())
    assert got == [
        (1, "mit-grant mit-notice", "MIT", "MIT"), (2, "mit-notice", "", None), (3, "mit-ref reserved", "MIT", "MIT"), (4, "", "", None), (5, "", "", None),
        (6, "gpl3-ref", "GPL-3.0-only", "GPL-3.0-only"), (7, "", "", None), (7, "", "", None),
    ]
    assert licences.scan(table(spark, [])).collect() == []


def test_mixing_learns_from_all_training_texts(spark):
    """As it comes, without a share set by a test: weights and the refining table are those of all training texts."""
    rows = mixing_rows()
    got = [(str(r.doc_id), r.score) for r in mixing.score(table(spark, rows)).collect()]
    for (i, a), (j, b) in zip(sorted(got), sorted(PlainMixing(rows).scores())):
        assert i == j and a == pytest.approx(b, abs=0.02)
