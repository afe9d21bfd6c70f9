"""The first maximal independent set of an ordered graph, in parallel.

Going through nodes in order, a node is chosen unless an earlier chosen node is
its neighbour.  Only the earlier neighbours matter, so nodes need not be taken one
by one: a node without an undecided earlier neighbour is decided at once.  A round
chooses all such nodes and rules out their later neighbours; the rounds are as many
as the longest chain of decisions, which on graphs in random order grows with
the logarithm of the nodes.  Every round is a few joins over what is left, written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import shuffled, staged


def first_independent_set(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Chosen rows of ``nodes`` (``keys``, ``node``) and the number of rounds.

    ``edges`` (``keys``, ``before``, ``after``) go from the earlier to the later
    of two neighbours; every graph of ``keys`` is decided on its own."""
    at = [*keys, "node"]
    chosen, rounds = None, 0
    written = lambda df, label: shuffled(staged(df, label))
    nodes, edges = shuffled(nodes), shuffled(edges)
    while not edges.isEmpty():
        rounds += 1
        waiting = edges.select(*keys, F.col("after").alias("node")).distinct()
        now = written(nodes.join(waiting, at, "left_anti"), "chosen")
        chosen = now if chosen is None else chosen.unionByName(now)
        out = edges.join(now.withColumnRenamed("node", "before"), [*keys, "before"], "left_semi").select(*keys, F.col("after").alias("node")).distinct()
        out = written(out, "ruled-out")
        nodes = written(nodes.join(now.unionByName(out), at, "left_anti"), "nodes")
        # an edge from a chosen node has its end ruled out; one from a node ruled out says nothing
        edges = edges.join(out.withColumnRenamed("node", "after"), [*keys, "after"], "left_anti")
        edges = written(edges.join(out.withColumnRenamed("node", "before"), [*keys, "before"], "left_anti"), "edges")
    return nodes if chosen is None else chosen.unionByName(nodes), rounds
