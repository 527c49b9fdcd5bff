"""SpotSigs document fingerprints.

A signature is an anchor (a common word) and the chain of the ``CHAIN`` content words
that follow it; where no common word is near, content words anchor their own chains. A
document's fingerprint set holds its distinct signatures. A document without any takes the chains that start at each of its words, and one without words the
hash of its bytes, so that only an empty text has an empty set. Its fingerprint string
is the set's size and a 128-bit digest of the set.

Sets of very unequal size can't be alike: |A| / |B| bounds the Jaccard similarity, so
``alike`` partitions sets by length, joins neighbouring partitions only, prunes by a prefix
of the rarest signatures, and verifies what is left on the full sets.

Results for odd input: a null text is empty; two empty sets have likeness 1, an empty and
another 0; repeated rows have equal fingerprints; rows that share an id, or have none, follow
each other in the order of a hash of their texts, those without an id after all others; with one
document its next is itself; an empty table gives an empty table; extra columns are ignored. Texts of
any length are read whole by one task; in ``classes`` a null id is the least of its class only if no other is there.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.frames import LAST, UNNAMED, drop_stored, identified, in_small_batches, ranked, shared_folder, stored
from tallyspark.llm.text import LOWER, SPACE, mix, prefix_hash, span_hash, text_slices, word_hash, words

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were with "
    "der die das und ist in den von zu mit auf ein eine nicht "
    "le la les de des du un une et est dans pour par que qui sur au "
    "el los las y en que se con por una para no"
).split()
CHAIN = 3
#: A content word is its own anchor where no common word is among so many words before it.
ALONE = 8
#: Documents of the sample by which signatures are ordered, and the most signatures that are ranked.
SAMPLE, FREQUENT = 20_000, 1 << 16
#: Documents in one bucket of neighbours, on average, and the most buckets (then they grow); documents in one task.
BUCKET, MOST_BUCKETS, TASK = 2048, 1 << 14, 1 << 15
#: Sets in one block of those that are verified.
BLOCK = 512

_GAPS = SPACE.copy()
_GAPS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def _anchor_hashes() -> np.ndarray:
    raw = [w.encode() for w in sorted(set(ANCHORS))]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return np.unique(word_hash(data, ends - [len(w) for w in raw], ends))


_ANCHORS = _anchor_hashes()


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signature hashes of each row, sorted within it, and the row offsets into them."""
    rows = len(offsets) - 1
    low = LOWER[data]
    starts, ends, row = words(low, offsets, _GAPS)
    hashes = word_hash(low, starts, ends)
    common = _ANCHORS[np.minimum(np.searchsorted(_ANCHORS, hashes), len(_ANCHORS) - 1)] == hashes
    content = np.flatnonzero(~common)
    prefix, owner = prefix_hash(hashes[content]), row[content]
    anchor = np.flatnonzero(common)
    begin = np.searchsorted(content, anchor)
    fits = begin + CHAIN <= len(content)
    fits[fits] = owner[begin[fits] + CHAIN - 1] == row[anchor[fits]]
    anchor, begin = anchor[fits], begin[fits]
    counts = np.bincount(row, minlength=rows)
    cuts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    place = np.arange(len(row))
    last = np.maximum.accumulate(np.where(common, place, -1)) if len(row) else place
    lonely = ~common[content] & ((last < cuts[row])[content] | (place - last > ALONE)[content])
    own = np.flatnonzero(lonely[: max(0, len(content) - CHAIN + 1)])
    own = own[owner[own] == owner[own + CHAIN - 1]]
    found = np.concatenate((mix(span_hash(prefix, begin, begin + CHAIN, 61) ^ hashes[anchor]), span_hash(prefix, own, own + CHAIN, 67)))
    of = np.concatenate((row[anchor], owner[own]))
    # rows without a signature
    bare = np.bincount(of, minlength=rows) == 0
    every = prefix_hash(hashes)
    at = np.flatnonzero(bare[row])
    chain = span_hash(every, at, np.minimum(at + CHAIN, cuts[1:][row[at]]), 67)
    silent = np.flatnonzero(bare & (counts == 0) & (np.diff(offsets) > 0))
    found = np.concatenate((found, chain, word_hash(low, offsets[silent], offsets[silent + 1], 1)))
    of = np.concatenate((of, row[at], silent))
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], np.concatenate(([0], np.cumsum(np.bincount(of[new], minlength=rows)))).astype(np.int64)


def fingerprint(members: np.ndarray) -> str:
    return f"{len(members)}:{hashlib.blake2b(members.tobytes(), digest_size=16).hexdigest()}" if len(members) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.large_binary())):
        found, cuts = signatures(data, offsets)
        out += [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, signatures (sorted array of long), fingerprint) of each whole text."""

    def run(batches):
        for batch in batches:
            sets = _sets([(x or "").encode() for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64())), pa.array([fingerprint(s) for s in sets])], names=["doc_id", "signatures", "fingerprint"])

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, signatures array<long>, fingerprint string")


def frequent_signatures(prints: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of several documents of a sample of about SAMPLE, FREQUENT at most, sorted, and how many have each.
    They only set the order in which signatures are looked at, never what is found."""
    count = prints.count()
    drawn = F.pmod(F.xxhash64("fingerprint", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(count, 1)) * (1 << 20))
    often = prints.where(drawn).dropDuplicates(["fingerprint"]).select(F.explode("signatures").alias("s")).groupBy("s").count().where("count > 2")
    rows = often.orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow().sort_by("s")
    return rows.column("s").to_numpy(), rows.column("count").to_numpy()


def _prefixes(prints: DataFrame, percent: int) -> DataFrame:
    """(s, h1, h2, n, at): the first n - ceil(t n) + 1 signatures of each set, rarest first, with the fingerprint's digest as two numbers, the set's size and the signature's place."""
    common, times = frequent_signatures(prints)

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            own = list({name: i for i, name in enumerate(names)}.values())  # copies of a batch are one here
            lists = batch.column(1).take(pa.array(own, pa.int32()))
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy()
            place = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
            rank = np.where(common[place] == flat, times[place], 0) if len(common) else np.zeros(len(flat), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, rank, row))
            first = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            among = first < np.repeat(sizes - -(-sizes * percent // 100) + 1, sizes)
            keep = order[among]
            owner = row[keep]
            n = sizes[owner]
            digests = b"".join(bytes.fromhex(names[i].partition(":")[2]) for i in own)
            digest = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(n.astype(np.int32)), pa.array(first[among].astype(np.int32))], names=["s", "h1", "h2", "n", "at"])

    return prints.select("fingerprint", "signatures").mapInArrow(run, "s long, h1 long, h2 long, n int, at int")


def _candidates(prints: DataFrame, percent: int) -> DataFrame:
    """(x, y), structs (h1, h2, n) with x < y: sets that share a rare signature and whose places of shared ones leave room for the threshold.

    All sets are in one order. The first signature that is in both of two alike sets has as many from its place on, in either, as
    the two must share. Those found to be shared so early, with what is left after the last of them, bound what is shared at all."""
    own = _prefixes(prints, percent).repartition("s").groupBy("s", "h1", "h2").agg(F.first("n").alias("n"), F.first("at").alias("at"))
    own = own.withColumn("part", F.floor(F.ln("n") / max(1e-9, -math.log(percent / 100)) + 1e-9))
    sides = [own.select("s", F.struct("h1", "h2", "n").alias(name), F.col("part").alias(f"part_{name}"), F.col("at").alias(f"at_{name}")) for name in ("x", "y")]
    left = F.least(F.col("x.n") - F.col("at_x"), F.col("y.n") - F.col("at_y"))
    enough = lambda shared: shared * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    met = sides[0].join(sides[1], "s").where("x < y and abs(part_x - part_y) <= 1").where(F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent).where(enough(left))
    found = met.groupBy("x", "y").agg(F.count("*").alias("shared"), F.max("at_x").alias("at_x"), F.max("at_y").alias("at_y"))
    return found.where(enough(F.col("shared") - 1 + left)).select("x", "y")


def _verify(percent: int):
    """Pairs of a cell and the cell's sets to (x, y, i, u) of the pairs that are alike: names, sizes of intersection and union."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        lists, names = sets.column("signatures").combine_chunks(), sets.column("fingerprint").combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        values, which = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        begin, place = np.cumsum(size) - size, sets.column("place").to_numpy()
        order = np.argsort(place)
        x, y = (order[np.searchsorted(place, pairs.column(c).to_numpy(), sorter=order)] for c in ("px", "py"))
        by_x = np.argsort(x, kind="stable")
        x, y = x[by_x], y[by_x]
        shared, marked = np.zeros(len(x), np.int64), np.zeros(len(values), bool)
        cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)] if len(x) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = which[begin[x[a]] : begin[x[a]] + size[x[a]]]
            marked[own] = True
            for k in range(a, b):
                shared[k] = np.count_nonzero(marked[which[begin[y[k]] : begin[y[k]] + size[y[k]]]])
            marked[own] = False
        union = size[x] + size[y] - shared
        good = shared * 100 >= union * percent
        return pa.table({"x": names.take(pa.array(x[good])), "y": names.take(pa.array(y[good])), "i": shared[good], "u": union[good]})

    return run


def alike(prints: DataFrame, percent: int = 80) -> DataFrame:
    """(x, y, likeness) of unequal fingerprints of sets that aren't empty, x before y, whose sets are alike at ``percent`` / 100 or more.

    A pair's sets differ in length by the factor of the threshold at most, so only equal or neighbouring
    length partitions are compared; a pair must share one of each set's first n - ceil(t n) + 1
    signatures, rarest first. What shares one is verified on the full sets. Equal fingerprints
    are one before they are joined, however many documents have them; one shuffle by signature serves both sides of the join.

    Sets aren't sent once for each pair: they are numbered so that those of a group of candidates follow each other, cut
    into blocks of ``BLOCK``, and sent once for each pair of blocks that has a candidate with them.
    """
    prints = prints.where(F.size("signatures") > 0)
    pairs = stored(_candidates(prints, percent))
    ends = pairs.select(F.col("x").alias("node"), F.col("y").alias("other")).union(pairs.select("y", "x"))
    nodes = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("group"))
    nodes = stored(ranked(nodes, "group", "node").select("node", "place"))
    half = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    pairs = pairs.join(nodes.select(F.col("node").alias("x"), F.col("place").alias("px")), "x").select("y", "px")
    pairs = pairs.join(nodes.select(F.col("node").alias("y"), F.col("place").alias("py")), "y")
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    cells = stored(pairs.select(F.least("px", "py").alias("px"), F.greatest("px", "py").alias("py")).select("px", "py", block("px").alias("bx"), block("py").alias("by")))
    asked = cells.select(F.col("px").alias("place"), "bx", "by").union(cells.select("py", "bx", "by")).groupBy("place").agg(F.collect_set(F.struct("bx", "by")).alias("cells"))
    asked = asked.join(nodes, "place").select("place", "cells", F.concat(F.col("node.n").cast("string"), F.lit(":"), half(F.col("node.h1")), half(F.col("node.h2"))).alias("fingerprint"))
    sets = prints.select("fingerprint", "signatures").join(asked, "fingerprint").dropDuplicates(["fingerprint"])
    sets = sets.select("place", "fingerprint", "signatures", F.inline("cells"))
    found = cells.groupBy("bx", "by").cogroup(sets.groupBy("bx", "by")).applyInArrow(_verify(percent), "x string, y string, i long, u long")
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("i") / F.col("u")).alias("likeness"))


def similar_pairs(prints: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b, likeness): the pairs of ``alike`` by the least id that has each fingerprint."""
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    found = alike(prints, percent).join(least.withColumnsRenamed({"fingerprint": "x", "least": "ix"}), "x").join(least.withColumnsRenamed({"fingerprint": "y", "least": "iy"}), "y")
    return found.select(F.least("ix", "iy").alias("a"), F.greatest("ix", "iy").alias("b"), "likeness")


def classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, fingerprint, class_id, n_links) of each document: the least id of those with an equal fingerprint, and how many
    other fingerprints are alike at ``percent`` / 100 or more. A document without a text is of a class and linked with nothing."""
    path = shared_folder(docs.sparkSession)
    prints = stored(fingerprints(docs), path)
    found = stored(alike(prints, percent).select("x", "y"))
    links = found.select(F.col("x").alias("fingerprint")).union(found.select("y")).groupBy("fingerprint").agg(F.count("*").alias("n_links"))
    kinds = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")).join(links, "fingerprint", "left"))
    out = stored(prints.select("doc_id", "fingerprint").join(kinds, "fingerprint").select("doc_id", "fingerprint", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    drop_stored(docs.sparkSession, path)
    return out


def _bucketed(rows: DataFrame, edges: np.ndarray, heavy: np.ndarray, bits: int) -> DataFrame:
    """Adds the bucket of (did, uid), the first two columns. Buckets are in the order of rows: the ids between
    two edges, or a part of the rows that share one heavy id, by the leading bits of their uid."""

    def run(batches):
        for batch in batches:
            did, uid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.searchsorted(edges, did)
            same = np.zeros(len(did), bool)
            if len(edges):
                same = edges[np.minimum(at, len(edges) - 1)] == did
            alone = same & heavy[np.minimum(at, max(0, len(edges) - 1))] if len(edges) else same
            bucket = np.where(alone, 2 * at + 1, 2 * (at + (same & ~alone))) << 21 | np.where(alone, uid >> (63 - bits), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int64())], names=[*batch.schema.names, "bucket"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, bucket long")


def with_next(docs: DataFrame, edit) -> DataFrame:
    """Maps ``edit`` over Arrow batches of each document and the next by descending id (after the last the first).

    Ids are dealt into buckets of neighbours of about equal numbers of documents, whatever the gaps
    between ids: the edges are quantiles of the ids, at most MOST_BUCKETS of them. Each bucket also
    gets a copy of the first document of the bucket after it, so one shuffle of the texts suffices.
    """
    rows = identified(docs)
    ids = rows.select("did", "uid")
    count = ids.count()
    n = max(1, min(MOST_BUCKETS, count // BUCKET))
    cuts = ids.agg(F.percentile_approx("did", [k / n for k in range(1, n)] or [0.5], 20 * n).alias("cuts")).first()["cuts"] if n > 1 else []
    edges, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    heavy, bits = times > 1, min(21, 2 + int(times.max(initial=1)).bit_length())
    first = _bucketed(ids, edges, heavy, bits).groupBy("bucket").agg(F.max(F.struct("did", "uid")).alias("top"))
    first = stored(first.select("bucket", "top.*"))
    order = Window.orderBy("bucket")  # over one row for each bucket
    links = first.select("did", "uid", F.lead("bucket").over(order).alias("up"), F.min("bucket").over(Window.partitionBy(F.lit(0))).alias("lowest"))
    # the document after a bucket's last is the first of the bucket below; after the lowest comes the highest
    links = stored(links.select("did", "uid", F.coalesce("up", "lowest").alias("bucket"), F.lit(True).alias("halo")))
    halo = rows.join(links, ["did", "uid"]).select("did", "uid", "text", "bucket", "halo").dropDuplicates(["bucket"])
    dealt = _bucketed(rows.select("did", "uid", "text"), edges, heavy, bits).withColumn("halo", F.lit(False)).unionByName(halo)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK))
    dealt = dealt.select("bucket", "did", "uid", "text", "halo").repartition(tasks, "bucket").sortWithinPartitions(F.col("bucket"), F.col("halo"), F.col("did").desc(), F.col("uid").desc())
    return dealt.mapInArrow(edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to that and to the next document."""

    def edit(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            did, uid = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = list(zip([d if d < LAST or u < UNNAMED else None for d, u in zip(did, uid)], batch.column(3).to_pylist(), batch.column(4).to_pylist()))
            rows = [held, *rows] if held is not None else rows
            held = rows[-1]
            for at in range(0, len(rows) - 1, 1000):
                some = rows[at : at + 1001]
                texts = [x[1] for x in some]
                edited = [edited_text(a, b) for a, b in zip(texts[:-1], texts[1:])]
                raw = [x.encode() for x in edited]
                sets = _sets([x.encode() for x in texts])
                changed = _sets(raw)
                own = [i for i in range(len(some) - 1) if not some[i][2]]
                ids = [some[i][0] for i in own]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids, pa.int64()),
                        "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                        "edited_sha256": pa.array([hashlib.sha256(raw[i]).hexdigest() for i in own], pa.string()),
                        "fingerprint": pa.array([fingerprint(sets[i]) for i in own], pa.string()),
                        "edited_fingerprint": pa.array([fingerprint(changed[i]) for i in own], pa.string()),
                        "near_edited": pa.array([likeness(sets[i], changed[i]) for i in own], pa.float64()),
                        "near_next": pa.array([likeness(sets[i], sets[i + 1]) for i in own], pa.float64()),
                    }
                )

    return with_next(docs, edit)
