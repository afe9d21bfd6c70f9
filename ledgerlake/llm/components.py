"""Connected components of a large edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns ``a`` and ``b``; returns ``node`` and ``root``
    (the smallest node reachable) for every node of an edge with two ends.

    A round hangs the larger neighbours of each node on its smallest neighbour,
    then the smaller ones; the number of rounds grows with the logarithm of a
    component's size.  Each round's table is written to the shared folder.  No
    step gathers the neighbours of a node: minima are pre-aggregated and joined
    back, and the join of a hub's edges may be split."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = _staged(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges, now = _staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple]:
    edges = stage(edges, "edges")
    # the xor of row hashes tells whether a round changed the table
    return edges, tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
