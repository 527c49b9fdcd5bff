"""Connected components of a link table, by rounds of joins and group-bys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.frames import stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for all nodes that have a link.

    Alternates large-star and small-star rounds: each node sends its larger (then its
    smaller) neighbours to the least one it knows, until every node hangs on one least
    node. Rounds grow with the logarithm of the longest path; nothing but the answer
    whether to go on reaches the driver. The least neighbours are written before they are
    joined, so that both sides of each join are plain exchanges and Spark splits the task of a
    node with very many links.
    """
    edges = stored(links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u > v").distinct())
    while _tangled(edges):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(stored(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        edges = stored(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _tangled(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(sums.where("up > 1 or (up = 1 and down = 1)").head(1))
