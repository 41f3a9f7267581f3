"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epimill.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for nodes with an edge.

    edges: columns a and b of one type; loops, repeats and either direction are allowed.
    Alternates large-star and small-star steps, which take a number of rounds that grows with
    the logarithm of the size, until a round changes nothing. The least neighbour of a node
    is found by a partial aggregate and brought back by a join, so that a hub's edges never
    meet in one task. Each round is stored in the shared folder, which cuts the lineage.
    """
    forward = F.col("a") > F.col("b")
    edges = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = stored(edges.distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        least = least.select("a", F.least("a", "least").alias("least"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.filter(forward).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        own = least.select("a", F.col("least").alias("b"))
        edges = stored(small.unionByName(own).filter(F.col("a") != F.col("b")).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
