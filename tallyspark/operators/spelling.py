"""The names nearest to others by edit distance, exactly, without comparing all with all.

A name that is at most r edits away from a query has, cut into r + 1 pieces, one piece that the edits leave
alone: the query has it too, shifted by no more than the edits before and after it allow. So names and
queries are joined where they have the same piece for the same length, and only pairs that
meet there are measured. The radius is doubled until each query has as many names as are
asked for within it; those that have are not looked at again.

Pieces that very many names share (a leading zero, a common last word) would let queries meet a part of all names each.
So names that have at most ``VARIANTS`` forms with up to r characters left out meet queries by such forms instead: two strings
at most r edits apart have one in common, and those that have one differ by 2 r characters left out or put in at most.
What meets there is near to what is found, however alike the names are otherwise.

Names of r characters or less can't be cut into r + 1 pieces; they meet all queries that are
within r of their length. Queries that have too few names within ``WIDEST`` edits are unlike almost everything:
for them all names are measured, in blocks of queries. Names are whole strings, compared by
character; null is no name.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.versions import new_folder

#: The largest radius that is searched by pieces.
WIDEST = 16
#: Forms of a name, with characters left out, at most; longer names are cut into pieces.
VARIANTS = 512
#: Queries that are measured against all names at once.
TOGETHER = 256


def _piece(length: Column, i: Column, pieces: int) -> tuple[Column, Column]:
    """Start (from 0) and length of piece i of a string: equal lengths, the last ones longer by one."""
    base, longer = F.floor(length / pieces), F.pmod(length, F.lit(pieces))
    first_longer = F.lit(pieces) - longer
    return i * base + F.greatest(F.lit(0), i - first_longer), base + (i >= first_longer).cast("int")


def pieces_of_names(names: DataFrame, name: str, radius: int) -> DataFrame:
    """(name, length, i, piece): the radius + 1 pieces of each name; of a short one just its length (i = -1)."""
    long = names.select(F.col(name).alias("name"), F.length(name).alias("length")).where("name is not null")
    cut = long.where(F.col("length") > radius).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(radius))))
    start, size = _piece(F.col("length"), F.col("i"), radius + 1)
    cut = cut.select("name", "length", "i", F.substring("name", (start + 1).cast("int"), size.cast("int")).alias("piece"))
    return cut.unionByName(long.where(F.col("length") <= radius).select("name", "length", F.lit(-1).alias("i"), F.lit("").alias("piece")))


def pieces_of_queries(queries: DataFrame, radius: int) -> DataFrame:
    """(query, length, i, piece): what a name of each length within the radius would have to have one of."""
    own = F.length("query")
    near = queries.select("query", own.alias("own"), F.explode(F.sequence(F.greatest(F.lit(0), own - radius), own + radius)).alias("length"))
    cut = near.where(F.col("length") > radius).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(radius))))
    start, size = _piece(F.col("length"), F.col("i"), radius + 1)
    shift = F.col("own") - F.col("length")
    cut = cut.select("query", "own", "length", "i", start.alias("start"), size.alias("size"), shift.alias("shift"))
    low = F.greatest(F.lit(0), F.col("start") - F.col("i"), F.col("start") + F.col("shift") - (radius - F.col("i")))
    high = F.least(F.col("own") - F.col("size"), F.col("start") + F.col("i"), F.col("start") + F.col("shift") + (radius - F.col("i")))
    cut = cut.withColumns({"low": low, "high": high}).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    cut = cut.select("query", "length", "i", F.substring("query", (F.col("at") + 1).cast("int"), F.col("size").cast("int")).alias("piece")).distinct()
    return cut.unionByName(near.where(F.col("length") <= radius).select("query", "length", F.lit(-1).alias("i"), F.lit("").alias("piece")))


def longest_varied(radius: int) -> int:
    """The length up to which a name has at most VARIANTS forms with up to ``radius`` characters left out; -1 for none."""
    forms = lambda n: sum(comb(n, i) for i in range(radius + 1))
    length = 0
    while length < VARIANTS and forms(length + 1) <= VARIANTS:
        length += 1
    return length if length > radius else -1


def variants(rows: DataFrame, name: str, radius: int) -> DataFrame:
    """(name, form): hashes of what is left of each name with up to ``radius`` characters left out, once each."""

    def shorter(forms: Column) -> Column:
        without = lambda x, i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))
        some = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: without(x, i))
        return F.array_distinct(F.flatten(F.transform(F.filter(forms, lambda x: x != ""), some)))

    # names are short and their forms many, so they are dealt to all cores whatever their size
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    levels = rows.repartition(tasks).select(name, F.array(name).alias("form_0"))
    for i in range(radius):
        levels = levels.withColumn(f"form_{i + 1}", shorter(F.col(f"form_{i}")))
    every = F.flatten(F.array(*[f"form_{i}" for i in range(radius + 1)]))
    return levels.select(name, F.explode(every).alias("form")).select(name, F.xxhash64("form").alias("form"))


def within(names: DataFrame, queries: DataFrame, name: str, radius: int) -> DataFrame:
    """(query, name, distance): all pairs of distinct names and distinct queries, column query, at most ``radius`` edits apart."""
    named = names.select(F.col(name).alias("name")).where("name is not null")
    longest, size = longest_varied(radius), F.length("name")
    short = variants(named.where(size <= longest), "name", radius)
    asked = variants(queries.select("query").where(F.length("query") <= longest + radius), "query", radius)
    pieces = pieces_of_queries(queries, radius).where(F.col("length") > longest)
    met = pieces.join(pieces_of_names(named.where(size > longest), "name", radius), ["length", "i", "piece"]).select("query", "name")
    if longest > 0:
        # forms are many times the names that Spark measures, so neither side is broadcast
        met = asked.join(short.hint("merge"), "form").select("query", "name").unionByName(met)
    near = met.withColumn("distance", F.levenshtein("query", "name", radius).cast("long")).where("distance >= 0")
    return near.distinct()


def nearest_spellings(names: DataFrame, queries: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """(query, name, distance, nth): for each distinct query name the ``limit`` other distinct names of
    least edit distance; ties go to the name that sorts first."""
    spark, folder = names.sparkSession, new_folder(names.sparkSession)

    def kept(frame: DataFrame, what: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{what}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{what}")

    every = kept(names.select(F.col(name).alias("name")).where("name is not null").distinct(), "names")
    left = kept(queries.select(F.col(name).alias("query")).where("query is not null").distinct(), "queries")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("distance", "name"))
    done: list[DataFrame] = []
    radius = 1
    while radius <= WIDEST and left.head(1):
        best = within(every, left, "name", radius).where("query <> name").withColumn("nth", nth).where(F.col("nth") <= limit)
        found = kept(best, f"found_{radius}")
        full = found.where(F.col("nth") == limit).select("query")
        done.append(found.join(full, "query", "left_semi"))
        left = kept(left.join(full, "query", "left_anti"), f"left_{radius}")
        radius *= 2
    if left.head(1):
        done.append(_against_all(every, left).where("query <> name").withColumn("nth", nth).where(F.col("nth") <= limit))
    out = done[0] if done else spark.createDataFrame([], "query string, name string, distance long, nth int")
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("query", F.col("name").alias(name), "distance", "nth")


def _against_all(names: DataFrame, queries: DataFrame) -> DataFrame:
    """Distances of all names to each query; queries travel in blocks of about TOGETHER, each of which meets each name once."""
    blocks = max(1, -(-queries.count() // TOGETHER))
    held = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("query").alias("queries"))
    met = names.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(held, "block")
    pairs = met.select("name", F.explode("queries").alias("query"))
    return pairs.select("query", "name", F.levenshtein("query", "name").cast("long").alias("distance"))
