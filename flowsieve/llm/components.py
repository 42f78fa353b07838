"""Connected components by alternating large and small stars; nothing but counts passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges to (node, root): every node that is not the smallest of its component, with the smallest.

    Each round is written to the shared folder, so lost executors cost a round at most. The minimum of a node's neighbours is
    an aggregation, so a node with very many neighbours is combined before the shuffle. The minima are written before they are
    joined to the edges: both sides of the join are then dealt for it alone, and adaptive execution can split the
    partition of such a node. No edge, an edge from a node to itself and repeated edges are no matter.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    current = written(edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct(), name)
    before = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large, name)
        own = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(own, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = written(small.unionByName(own.select("a", F.col("m").alias("b"))).distinct(), name)
        after = _state(current)
        if after == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
