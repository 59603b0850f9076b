"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.staging import stage


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge, root being the least node that it reaches.

    Each round hangs every node below the least node it knows of and writes the edges to the shared folder; a chain of n
    nodes takes about log n rounds. Edges with a NULL end or equal ends are left out; repeated edges count once.
    """
    current = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .distinct(),
        "edges",
    )
    before = _mark(current)
    while before[0]:
        current = stage(_small_star(_large_star(current)), "edges")
        after = _mark(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(current.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node among the node and its neighbours."""
    both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"))
    return both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.unionByName(least.select("v", F.col("m").alias("u"))).distinct()
