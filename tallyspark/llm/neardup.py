"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. Register i of its sketch is
``floor(1 - log_b x)`` of the least of exponentially distributed hash values x of its
shingles, clipped to 0..q+1: registers of a union are the maxima of registers, and two
registers are equal with a probability that grows with the Jaccard similarity (for b near
1 it is about that).

1. Documents of equal sets are one representative (the least id).
2. Bands of registers are hashed. Representatives that share a band value are linked to
   the least of them, and the components of those links are candidate groups: any two
   documents that share a band are in one group, without listing the pairs.
3. Each candidate group gets its documents' full sets once, in blocks of bounded size. Two
   similar sets of a block share one of the rarest shingles of each (as many as the threshold
   lets them differ in, and one), so only documents under one such shingle are compared. Two that
   share a shingle of few documents meet there; under a common one (of a form, say) only those meet
   whose common shingles alone can reach the threshold. Of those that meet, first
   the Jaccard similarity is estimated jointly with the set sizes by maximum likelihood over
   the counts of larger, equal and smaller registers; what is not far below the threshold is
   verified on the full sets. Documents linked with no leader become leaders; followers whose
   rare shingles lead to other parts are compared with those.
4. Groups that need more than one block and whose parts are not connected yet go on over the
   whole group: documents that share a rare shingle of it meet, and only those whose common
   shingles alone could reach the threshold go block against block.
5. Components of the verified links are the result.

Results for odd input: a document without words (null text too) has an empty set and is
linked with nothing; with fewer words than a shingle its whole word sequence is the one
shingle. Every row gets a row. Rows of equal id and text are one document; other rows that
share an id are judged each for itself. Rows without an id come after all others and have a
null component_id unless they are linked with one that has an id. kept says whether the row's id is
its component's; without an id, whether it is the component's first document. An empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import connected_components
from tallyspark.llm.frames import identified, ranked, real_id, stored
from tallyspark.llm.text import LOWER, mix, prefix_hash, span_hash, text_slices, word_hash, words

BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: Pairs whose estimated similarity is this far below the threshold are not verified (seven standard errors).
MARGIN = 0.25
#: Documents of a block that a shingle is in, beyond which it is common there.
COMMON = 32
#: Shingles in one block of a candidate group.
BLOCK = 4_000_000

_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within it, and the row offsets into them."""
    rows = len(offsets) - 1
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    hashes = word_hash(data, starts, ends)
    counts = np.bincount(row, minlength=rows)
    cuts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    prefix = prefix_hash(hashes)
    n = len(hashes)
    at = np.flatnonzero(np.arange(n) + size <= np.repeat(cuts[1:], counts))
    short = np.flatnonzero((counts > 0) & (counts < size))
    found = np.concatenate((span_hash(prefix, at, at + size, 41), span_hash(prefix, cuts[short], cuts[short + 1], 41)))
    owner = np.concatenate((row[at], short))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=rows)))).astype(np.int64)


def registers(found: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sketch of each row's set; empty sets have registers 0."""
    rows = len(cuts) - 1
    has = np.flatnonzero(cuts[1:] > cuts[:-1])
    out = np.zeros((rows, REGISTERS), np.uint16)
    if len(has):
        least = np.empty((len(has), REGISTERS))
        for i in range(REGISTERS):
            value = found * _SEEDS[i]
            value ^= value >> np.uint64(32)
            value *= np.uint64(0x9E3779B97F4A7C15)
            least[:, i] = np.minimum.reduceat(value, cuts[:-1][has])
        x = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
        out[has] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LIMIT + 1)
    return out


def _log_likelihood(similarity: np.ndarray, u: np.ndarray, larger: np.ndarray, equal: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Of the counts of registers of one sketch that are larger than, equal to and smaller than
    another's, where the sets have the shares u and 1 - u of the sum of both sizes."""

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = p(u - (1 - u) * similarity), p(1 - u - u * similarity)
    return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))


def _counts(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    larger, smaller = (one > others).sum(axis=1), (one < others).sum(axis=1)
    return larger, REGISTERS - larger - smaller, smaller


def likely_similarity(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of one sketch and others, given the set sizes."""
    u = size / (size + sizes)
    top = np.minimum(u / (1 - u), (1 - u) / u)
    grid = np.linspace(0, 1, 101)[:, None] * top
    return grid[_log_likelihood(grid, u, *_counts(one, others)).argmax(axis=0), np.arange(len(sizes))]


def may_be_similar(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether the maximum-likelihood similarity is at least ``floor`` (the likelihood, which has one
    maximum, still rises there), and the number of equal registers."""
    u = size / (size + sizes)
    counts = _counts(one, others)
    reachable = np.minimum(u / (1 - u), (1 - u) / u) > floor + 1e-4
    return reachable & (_log_likelihood(np.float64(floor + 1e-4), u, *counts) >= _log_likelihood(np.float64(floor), u, *counts)), counts[1]


def _rare_first(found: np.ndarray, cuts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the shingles of a block, for each document its rarest ones, of which a similar document
    must share one, as pairs (shingle, document) in the order of shingles and document sizes; and how many documents each shingle is in."""
    m, sizes = len(cuts) - 1, np.diff(cuts)
    _, dense, times = np.unique(found, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.lexsort((dense, times[dense], owner))
    place = np.arange(len(dense)) - cuts[owner]
    must_share = -(-sizes * percent // 100)  # a similar set shares so many at least
    rare = order[place < (sizes - must_share + 1)[owner]]
    rare = rare[times[dense[rare]] > 1]
    by = np.lexsort((owner[rare], sizes[owner[rare]], dense[rare]))
    return dense, dense[rare][by], owner[rare][by], times


def verified_links(ids: np.ndarray, found: np.ndarray, cuts: np.ndarray, sketches: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """What the threshold connects within a block, as a link from each document to the least of its part.

    Only documents that share a rare shingle are looked at, so a block in which nothing is
    similar takes time in proportion to its size.
    """
    m = len(ids)
    sizes = np.diff(cuts)
    none = np.zeros(0, np.int64)
    if not len(found):
        return []
    dense, shingle, holder, times = _rare_first(found, cuts, percent)
    edges = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1], [True]))) if len(shingle) else np.zeros(1, np.int64)
    begin, end = edges[:-1], edges[1:]
    number = np.repeat(np.arange(len(begin)), end - begin)
    widths = sizes[holder]
    common = times[shingle[begin]] > COMMON if len(shingle) else np.zeros(0, bool)
    # of documents that share common shingles only, a similar one has at most so many: 100 shared >= percent * united
    alone = np.add.reduceat((times[dense] > COMMON).astype(np.int64), cuts[:-1][sizes > 0]) if sizes.any() else none
    widest = np.zeros(m, np.int64)
    widest[sizes > 0] = alone * (100 + percent) // percent - sizes[sizes > 0]
    by_holder = np.argsort(holder, kind="stable")
    lists, bounds = number[by_holder], np.concatenate(([0], np.cumsum(np.bincount(holder, minlength=m))))
    flag = np.zeros(int(dense.max()) + 1, bool)
    part = np.arange(m)
    members: dict[int, list[int]] = {}

    def join(i, others):
        """Puts i and others into one part, the smaller ones into the largest."""
        parts = sorted({int(p) for p in part[others]} | {int(part[i])}, key=lambda p: -len(members.get(p, (p,))))
        into = parts[0]
        own = members.setdefault(into, [into])
        for other in parts[1:]:
            moved = members.pop(other, [other])
            part[moved] = into
            own += moved

    def near(i):
        """Documents that share a rare shingle with i and may be as large, i left out, and their registers equal to its."""
        among = met(i, lists[bounds[i] : bounds[i + 1]])
        return likely(i, among[among != i])

    def met(i, own):
        """Documents under these rare shingles of i that are large and small enough to be similar."""
        least, most = -(-sizes[i] * percent // 100), sizes[i] * 100 // percent
        out = []
        for k in own:
            top = min(most, widest[i]) if common[k] else most
            if top < least:
                continue
            size = widths[begin[k] : end[k]]
            some = holder[begin[k] + np.searchsorted(size, least) : begin[k] + np.searchsorted(size, top, "right")]
            out.append(some[widest[some] >= sizes[i]] if common[k] else some)
        return np.unique(np.concatenate(out)) if out else none

    def likely(i, among):
        close, equal = may_be_similar(sketches[i], int(sizes[i]), sketches[among], sizes[among], floor)
        return among[close], equal[close]

    def similar(i, among):
        """Which of the others are similar to i, by exact counts of shared and united shingles."""
        own = dense[cuts[i] : cuts[i + 1]]
        flag[own] = True
        spans = sizes[among]
        ends = np.cumsum(spans)
        places = np.repeat(cuts[among] - (ends - spans), spans) + np.arange(int(ends[-1]))
        shared = np.add.reduceat(flag[dense[places]].astype(np.int64), ends - spans)
        flag[own] = False
        return among[100 * shared >= percent * (sizes[i] + spans - shared)]

    def tie(i, among, equal):
        """Links i with each other part that has a similar document, the likeliest first."""
        among = among[np.argsort(-equal, kind="stable")]
        while len(among):
            some, among = among[:256], among[256:]
            linked = similar(i, some)
            if len(linked):
                join(i, linked)
            among = among[part[among] != part[i]]

    floor = percent / 100 - MARGIN
    leader_of = np.full(m, -1)
    for i in range(m):
        if leader_of[i] >= 0:
            continue
        leader_of[i] = i
        among, equal = near(i)
        if not len(among):
            continue
        free = among[leader_of[among] < 0]
        if len(free):
            linked = similar(i, free)
            if len(linked):
                join(i, linked)
                leader_of[linked] = i
        # of those that have a leader, one link to each part is enough
        tied = (leader_of[among] >= 0) & (part[among] != part[i])
        tie(i, among[tied], equal[tied])
    if len(begin):
        # a leader has met all others; what is left are followers that share a rare shingle with another part
        of = part[holder]
        mixed = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin)
        for i in np.unique(holder[mixed[number]]):
            if leader_of[i] == i:
                continue
            own = [k for k in lists[bounds[i] : bounds[i + 1]] if mixed[k]]
            among = met(i, own)
            among = among[(part[among] != part[i]) & (leader_of[among] != among)]
            if len(among):
                tie(i, *likely(i, among))
    out = []
    for own in members.values():
        least = min(own)
        out += [(int(ids[i]), int(ids[least])) for i in own if i != least]
    return out


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(did, n_shingles, set hash in two words, bands) of each document."""

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                found, cuts = shingles(data, offsets, size)
                sketch = registers(found, cuts)
                totals = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(found + np.uint64(k)), dtype=np.uint64))) for k in (0, 5)]
                sums = [(t[cuts[1:]] - t[cuts[:-1]]).view(np.int64) for t in totals]
                bands = np.stack([span_hash(prefix_hash(np.ascontiguousarray(sketch[:, b * ROWS : (b + 1) * ROWS]).astype(np.uint64).ravel() + np.uint64(1)), np.arange(end - first) * ROWS, np.arange(1, end - first + 1) * ROWS, b) for b in range(BANDS)], axis=1)
                flat = pa.array(bands.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(cuts)), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)],
                    names=["did", "n_shingles", "s1", "s2", "bands"],
                )

    return docs.select("did", "text").mapInArrow(run, "did long, n_shingles long, s1 long, s2 long, bands array<long>")


def _full_sets(texts: DataFrame, size: int) -> DataFrame:
    """(part, did, set as bytes, sketch as bytes) of the documents of candidate groups."""

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(2)):
                found, cuts = shingles(data, offsets, size)
                sketch = registers(found, cuts)
                raw, bounds = found.tobytes(), (cuts * 8).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=["part", "did", "members", "sketch"],
                )

    return texts.select("part", "did", "text").mapInArrow(run, "part string, did long, members binary, sketch binary")


def _connect(sets: DataFrame, percent: int) -> DataFrame:
    """Verified links within each part: (a, b)."""

    def run(batches):
        held, now = [], None

        def settle():
            if len(held) < 2:
                return None
            held.sort(key=lambda x: x[0])
            members = [np.frombuffer(x[1], np.uint64) for x in held]
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in members])))
            found = verified_links(np.array([x[0] for x in held]), np.concatenate(members), cuts, np.array([np.frombuffer(x[2], np.uint16) for x in held]), percent)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"]) if found else None

        for batch in batches:
            for part, did, members, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if part != now:
                    if (links := settle()) is not None:
                        yield links
                    held, now = [], part
                if not held or held[-1][0] != did:
                    held.append((did, members.as_py(), sketch.as_py()))
        if (links := settle()) is not None:
            yield links

    return sets.repartition("part").sortWithinPartitions("part", "did").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_equal, first, uid): the least id that is reachable over
    links of Jaccard similarity ``percent`` / 100 or more. first marks the least document of each
    component, uid tells apart documents that share an id or have none."""
    rows = identified(docs)
    odd = bool(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1))
    names = None
    if odd:
        names = stored(ranked(rows.select("did", "uid").distinct(), "did", "uid", name="node"))
        texts = rows.dropDuplicates(["did", "uid"]).join(names, ["did", "uid"]).select(F.col("node").alias("did"), "text")
        texts = stored(texts)
    else:
        texts = rows.select("did", "text")
    sketches = stored(_sketches(texts, shingle))
    named = sketches.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("did").alias("rep"), F.count("*").alias("n_equal"), F.first("bands").alias("bands"))
    named = stored(named)
    banded = named.select("rep", "n_shingles", F.posexplode("bands").alias("band", "value"))
    stars = stored(banded.groupBy("band", "value").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1"))
    stars = banded.join(stars, ["band", "value"]).where("rep > center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    groups = stored(connected_components(stars))
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    sized = groups.join(named.select(F.col("rep").alias("node"), "n_shingles"), "node")
    blocks = stored(sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks")))
    placed = stored(sized.join(blocks, "component").select("node", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    part = F.concat_ws("/", "component", "block")
    assigned = placed.select(F.col("node").alias("did"), part.alias("part"))
    links = stored(_connect(_full_sets(texts.join(assigned.hint("shuffle_hash"), "did"), shingle), percent))
    large = placed.where("blocks > 1")
    if large.head(1):
        links = links.unionByName(_across(texts, large, links, shingle, percent))
    merged = connected_components(links)
    reps = stored(named.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n_shingles", "n_equal", F.coalesce("component", "rep").alias("component")))
    found = sketches.join(reps, ["s1", "s2", "n_shingles"], "left").select("did", "n_shingles", F.coalesce("component", "did").alias("component"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))
    if not odd:
        first = F.col("component") == F.col("did")
        return found.select(F.col("did").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), first.alias("kept"), "n_equal", first.alias("first"), F.lit(0).cast("long").alias("uid"))
    least = names.select(F.col("node").alias("component"), real_id().alias("component_id"))
    found = found.withColumnRenamed("did", "node").join(least, "component").join(names, "node")
    first = F.col("node") == F.col("component")
    doc_id = real_id()
    found = found.select("did", "uid", doc_id.alias("doc_id"), "n_shingles", "component_id", F.when(doc_id.isNull(), first).otherwise(doc_id.eqNullSafe(F.col("component_id"))).alias("kept"), "n_equal", first.alias("first"))
    return rows.select("did", "uid").join(stored(found), ["did", "uid"]).select("doc_id", "n_shingles", "component_id", "kept", "n_equal", "first", "uid")


def _exploded(texts: DataFrame, size: int) -> DataFrame:
    """(component, did, n, s) for each shingle of each document of (component, did, text)."""

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(2)):
                found, cuts = shingles(data, offsets, size)
                n = np.diff(cuts)
                row = pa.array(np.repeat(np.arange(first, end), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.repeat(n, n)), pa.array(found.view(np.int64))], names=["component", "did", "n", "s"])

    return texts.select("component", "did", "text").mapInArrow(run, "component long, did long, n long, s long")


def _across(texts: DataFrame, large: DataFrame, links: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between different blocks of groups whose parts are not connected yet.

    As within a block: documents of such a group that share one of their rarest shingles, one of few documents
    of the group, are a part of its own. Only documents whose common shingles alone could reach the threshold go block against block.
    """
    have = connected_components(links).withColumnRenamed("component", "own")
    open_groups = large.join(have, "node", "left").withColumn("own", F.coalesce("own", "node"))
    several = open_groups.groupBy("component").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x < y").select("component")
    members = stored(open_groups.join(several, "component").select(F.col("node").alias("did"), "component", "block", "blocks"))
    rows = stored(_exploded(texts.join(members, "did"), shingle))
    few = rows.groupBy("component", "s").agg(F.count("*").alias("times")).where(F.col("times") <= COMMON)
    counted = rows.join(few, ["component", "s"], "left")
    rare = F.sort_array(F.collect_list(F.when(F.col("times").isNotNull(), F.struct("times", "s"))))
    each = counted.groupBy("component", "did").agg(F.max("n").alias("n"), F.count_if(F.col("times").isNull()).alias("alone"), rare.alias("rare"))
    least = F.ceil(F.col("n") * percent / 100)
    each = stored(each.select("component", "did", "n", "alone", "rare", least.alias("least"), (F.col("n") - least + 1).cast("int").alias("first")))
    shared = F.explode(F.filter(F.slice("rare", F.lit(1), F.col("first")), lambda x: x["times"] > 1)).alias("x")
    parts = each.select("did", "component", shared).select("did", F.concat_ws("/", "component", F.lit("s"), "x.s").alias("part"))
    common = each.where((F.size("rare") < F.col("first")) & (F.floor(F.col("alone") * (100 + percent) / percent) - F.col("n") >= F.col("least"))).select("did")
    pair = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: other != F.col("block"))).alias("other")
    pairs = members.join(common, "did", "left_semi").select("did", "component", "block", pair).select("did", F.concat_ws("/", "component", F.least("block", "other"), F.greatest("block", "other")).alias("part"))
    return _connect(_full_sets(texts.join(parts.unionByName(pairs), "did"), shingle), percent)
