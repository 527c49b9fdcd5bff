"""Language identification by character language models.

For each language an interpolated Kneser-Ney model of order five is trained over the
letters of its words (a word is a maximal run of letters, lower-cased, with a mark at
both ends). All languages share, for each order, one sorted array of n-gram hashes with
a column of discounted probabilities per language, and one sorted array of context
hashes with a column of back-off weights. A text's language is the one of least cross-
entropy per character. Confidence is the softmax of the cross-entropies under a
temperature fitted to texts held back from the model, lowered where the best cross-entropy
is far above what that language's held-back texts have; ``REJECT`` is a threshold on it.

Training takes all texts of a language up to ``PER_LANGUAGE`` texts and
``BYTES_PER_LANGUAGE`` bytes (then a hashed sample of about that many): the documented
bounds of the fit. Prediction takes every whole text.

Results for odd input: a null text or one without a letter gives ``und`` with score 0;
without any labelled text every result is ``und``; ties between languages go to the
name that sorts first; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.frames import in_small_batches
from tallyspark.llm.text import mix, prefix_hash, span_hash, text_slices

ORDER = 5
#: Training texts for each language, and their bytes.
PER_LANGUAGE = 500
BYTES_PER_LANGUAGE = 8 << 20
#: One of so many training texts is held back to calibrate.
HELD_BACK = 5
UNKNOWN = "und"
#: Below this confidence the pipeline rejects a text.
REJECT = 0.5
#: Confidence halves where a text's cross-entropy is this many times what is usual for its language.
FAR = 2.5

_START, _END = 1, 2
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-case code point for each letter, 0 for all else."""
    if not _LETTERS:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


@dataclass
class Words:
    """Distinct words of a slice, flattened with end marks, and where each occurs."""

    symbols: np.ndarray
    place: np.ndarray
    owner: np.ndarray
    count: int
    row: np.ndarray
    which: np.ndarray


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = (data & 0xC0) != 0x80
    if int(heads.sum()) == len(points):
        starts_of = np.concatenate(([0], np.cumsum(heads)))[offsets]
    else:  # broken UTF-8: row by row
        rows = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
        points = np.concatenate(rows) if rows else points
        starts_of = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    low = letters()[points]
    solid = low > 0
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[starts_of] = True
    starts = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1])) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | edge[1:])) + 1 if n else np.zeros(0, np.int64)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, 0, none, none)
    hashed = span_hash(prefix_hash(mix(low.astype(np.uint64) + np.uint64(77))), starts, ends)
    _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
    sizes = ends[first] - starts[first]
    total = sizes + 2
    begin = np.concatenate(([0], np.cumsum(total)))
    owner = np.repeat(np.arange(len(first)), total)
    place = np.arange(begin[-1]) - begin[owner]
    symbols = np.full(begin[-1], _END, np.uint64)
    symbols[begin[:-1]] = _START
    body = (place > 0) & (place <= sizes[owner])
    symbols[body] = low[(starts[first][owner] + place - 1)[body]]
    return Words(symbols, place, owner, len(first), np.searchsorted(starts_of, starts, "right") - 1, which)


_FACTORS = mix(np.arange(1, 40, dtype=np.uint64))


def gram_keys(symbols: np.ndarray, size: int, shift: int = 0) -> np.ndarray:
    """Hash of the ``size`` symbols that end ``shift`` before each position; those that would begin too early are not valid."""
    acc = np.full(len(symbols), size * 1000003, np.uint64)
    for back in range(shift, shift + size):
        part = np.zeros(len(symbols), np.uint64)
        part[back:] = symbols[: len(symbols) - back] if back else symbols
        acc += mix(part + _FACTORS[back - shift])
    return mix(acc)


class Model:
    """Sorted hash arrays of all orders, with a column for each language."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = 1.0
        self.temperature = 0.05
        self.usual = np.ones(len(languages))

    def word_costs(self, found: Words) -> np.ndarray:
        """Minus log2 of each distinct word's probability under each language."""
        predicted = found.place > 0
        keys, contexts = [], []
        deep = np.minimum(found.place, ORDER - 1)
        top = np.zeros(len(found.symbols), np.uint64)
        for order in range(1, ORDER + 1):
            keys.append(gram_keys(found.symbols, order))
            contexts.append(gram_keys(found.symbols, order - 1, 1))
            here = deep == order - 1
            top[here] = keys[-1][here]
        _, first, which = np.unique(top[predicted], return_index=True, return_inverse=True)
        at = np.flatnonzero(predicted)[first]
        p = np.full((len(at), len(self.languages)), self.floor)
        for order in range(1, ORDER + 1):
            valid = np.flatnonzero(deep[at] >= order - 1)
            places = at[valid]
            (grams, probability), (known, weight) = self.grams[order - 1], self.contexts[order - 1]
            i = np.minimum(np.searchsorted(grams, keys[order - 1][places]), len(grams) - 1)
            own = np.where((grams[i] == keys[order - 1][places])[:, None], probability[i], 0.0)
            i = np.minimum(np.searchsorted(known, contexts[order - 1][places]), len(known) - 1)
            back = np.where((known[i] == contexts[order - 1][places])[:, None], weight[i], 1.0)
            p[valid] = own + back * p[valid]
        cost = -np.log2(p)
        owner = found.owner[predicted]
        return np.stack([np.bincount(owner, cost[which, k], found.count) for k in range(len(self.languages))], axis=1)

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a character of each row under each language, and the characters counted."""
        rows = len(offsets) - 1
        found = distinct_words(data, offsets)
        if not found.count:
            return np.zeros((rows, len(self.languages))), np.zeros(rows)
        cost = self.word_costs(found)
        sizes = np.bincount(found.owner, found.place > 0, found.count)
        chars = np.bincount(found.row, sizes[found.which], rows)
        total = np.stack([np.bincount(found.row, cost[found.which, k], rows) for k in range(len(self.languages))], axis=1)
        return total / np.maximum(chars, 1)[:, None], chars

    def confidence(self, entropy: np.ndarray, best: np.ndarray) -> np.ndarray:
        z = -(entropy - entropy.min(axis=1, keepdims=True)) / self.temperature
        share = 1.0 / np.exp(z).sum(axis=1)
        beyond = entropy[np.arange(len(best)), best] / self.usual[best] - FAR
        return share / (1.0 + np.exp(np.minimum(50, 20 * beyond)))


def train(counts: list[tuple[str, str, int]]) -> Model:
    """A model from (language, word, times) rows."""
    languages = sorted({r[0] for r in counts})
    model = Model(languages)
    if not languages:
        return model
    alphabet = len({c for _, word, _ in counts for c in word}) + 2
    model.floor = 1.0 / max(alphabet, 2)
    tables: list[list[dict]] = []
    for language in languages:
        own = [(w, n) for name, w, n in counts if name == language]
        text = "".join(f"\x01{w}\x02" for w, _ in own)
        symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.array([len(w) + 2 for w, _ in own])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(len(symbols)) - np.repeat(begin, sizes)
        weight = np.repeat(np.array([n for _, n in own], float), sizes)
        tables.append(_kneser_ney(symbols, place, weight))
    for order in range(ORDER):
        for kind, target in (("gram", model.grams), ("context", model.contexts)):
            keys = np.unique(np.concatenate([t[order][kind][0] for t in tables]))
            values = np.full((len(keys), len(languages)), 0.0 if kind == "gram" else 1.0)
            for k, t in enumerate(tables):
                own, value = t[order][kind]
                values[np.searchsorted(keys, own), k] = value
            target.append((keys, values))
    return model


def _kneser_ney(symbols: np.ndarray, place: np.ndarray, weight: np.ndarray) -> list[dict]:
    """For each order the discounted probabilities of n-grams and the weights of contexts."""
    out: list[dict] = []
    for order in range(1, ORDER + 1):
        at = np.flatnonzero((place >= order - 1) & (place > 0))
        keys, contexts = gram_keys(symbols, order)[at], gram_keys(symbols, order - 1, 1)[at]
        own, first, which = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(which, weight[at])
        if order < ORDER:
            longer = np.flatnonzero(place >= order)
            pairs = np.unique(np.stack([gram_keys(symbols, order + 1)[longer], gram_keys(symbols, order)[longer]], axis=1), axis=0)
            suffix, times = np.unique(pairs[:, 1], return_counts=True)
            i = np.minimum(np.searchsorted(suffix, own), max(len(suffix) - 1, 0))
            extended = (suffix[i] == own) if len(suffix) else np.zeros(len(own), bool)
            counts = np.where(extended, times[i] if len(suffix) else 0, counts)
        once, twice = float((counts == 1).sum()), float((counts == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context_of = contexts[first]
        known, inverse = np.unique(context_of, return_inverse=True)
        total = np.bincount(inverse, counts)
        kinds = np.bincount(inverse)
        out.append({"gram": (own, np.maximum(counts - discount, 0) / total[inverse]), "context": (known, discount * kinds / total)})
    return out


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE) -> DataFrame:
    """Rows with a text and a language, and whether they are held back from the counts.

    All of a language up to both bounds, beyond them a sample by a hash of the id that has about so many texts or bytes.
    """
    rows = in_small_batches(docs).select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    back = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(HELD_BACK)) == 0
    if not sizes:
        return rows.withColumn("back", back)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["texts"], bytes_per_language / max(r["bytes"], 1)))])
    drawn = (F.xxhash64("doc_id", F.lit(11)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30)))
    return rows.where(drawn < share[F.col("lang")]).withColumn("back", back)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Trains and calibrates on labelled rows; only the bounded sample's word counts reach the driver.

    What the calibration measures comes from texts held back from the model that it asks; the
    model that is returned knows all of the sample.
    """
    sample = labelled_sample(docs, per_language)

    def count(batches):
        for batch in batches:
            names = [f"{int(back)}{name}" for name, back in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            for first, end, data, offsets in text_slices(batch.column(0)):
                found = distinct_words(data, offsets)
                if not found.count:
                    continue
                kinds, code = np.unique(np.array(names[first:end], object).astype(str), return_inverse=True)
                pairs, times = np.unique(code[found.row] * found.count + found.which, return_counts=True)
                inner = found.symbols > _END
                text = found.symbols[inner].astype(np.uint32).tobytes().decode("utf-32-le")
                ends = np.cumsum(np.bincount(found.owner[inner], minlength=found.count))
                strings = [text[b - s : b] for b, s in zip(ends.tolist(), np.diff(np.concatenate(([0], ends))).tolist())]
                kind = [str(kinds[p // found.count]) for p in pairs]
                yield pa.RecordBatch.from_pydict({"lang": [k[1:] for k in kind], "word": [strings[p % found.count] for p in pairs], "counted": pa.array(np.where([k[0] == "0" for k in kind], times, 0), pa.int64()), "times": pa.array(times, pa.int64())})

    words = sample.select("text", "lang", "back").mapInArrow(count, "lang string, word string, counted long, times long")
    rows = sorted(tuple(r) for r in words.groupBy("lang", "word").agg(F.sum("counted"), F.sum("times")).collect())
    model = train([(lang, word, times) for lang, word, _, times in rows])
    if model.languages:
        asked = train([(lang, word, counted) for lang, word, counted, _ in rows if counted])
        calibrate(model, asked, sample)
    return model


def calibrate(model: Model, asked: Model, sample: DataFrame) -> None:
    """Sets the model's temperature and each language's usual cross-entropy by what ``asked`` says of texts held back from it.

    A language without such a text has the mean of the others; where there is none at all, the texts it was trained on are measured.
    """
    rows = _measured(asked, sample.where("back")) if asked.languages else []
    if not rows:
        asked, rows = model, _measured(model, sample)
    if not rows:
        return
    index = {name: k for k, name in enumerate(asked.languages)}
    entropy = np.array([r["entropy"] for r in rows])
    truth = np.array([index[r["lang"]] for r in rows])
    own = entropy[np.arange(len(truth)), truth]
    for k, name in enumerate(model.languages):
        known = own[truth == index.get(name, -1)]
        model.usual[k] = max(0.1, float(known.mean() if len(known) else own.mean()))
    losses = []
    for temperature in (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
        z = -(entropy - entropy.min(axis=1, keepdims=True)) / temperature
        losses.append((-(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean(), temperature))
    model.temperature = min(losses)[1]


def _measured(model: Model, sample: DataFrame) -> list:
    """Cross-entropies of the sample's texts of languages that the model knows."""

    def measure(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(0)):
                entropy, chars = model.entropies(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, end - first), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(chars)], names=["lang", "entropy", "chars"])

    found = sample.where(F.col("lang").isin(model.languages)).select("text", "lang").mapInArrow(measure, "lang string, entropy array<double>, chars double")
    return found.where("chars > 0").collect()


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred, score and bits_per_char to the kept columns; reads nothing else than the text."""
    at = keep.index("text") if "text" in keep else len(keep)
    docs = in_small_batches(docs)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = broadcast.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            kinds, scores, bits = [], [], []
            for _, _, data, offsets in text_slices(batch.column(at)):
                rows = len(offsets) - 1
                if not own.languages:
                    kinds += [UNKNOWN] * rows
                    scores += [0.0] * rows
                    bits += [math.nan] * rows
                    continue
                entropy, chars = own.entropies(data, offsets)
                best = entropy.argmin(axis=1)
                sure = own.confidence(entropy, best)
                blank = chars == 0
                kinds += names[np.where(blank, len(own.languages), best)].tolist()
                scores += np.where(blank, 0.0, np.clip(sure, 0, 1)).tolist()
                bits += np.where(blank, np.nan, entropy.min(axis=1)).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(kinds, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=[*keep, "lang_pred", "score", "bits_per_char"])

    frame = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(run, f"{schema}, lang_pred string, score double, bits_per_char double")
