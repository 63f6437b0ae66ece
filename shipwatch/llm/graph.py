"""Connected components by alternating large-star and small-star steps.

Only the narrow edge table moves: each step takes the smallest neighbour of
every node (summed per task before the shuffle) and hangs the others on it.
The number of edges never grows and the steps needed grow with the logarithm
of the longest path. Every round is a table in the shared folder.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from shipwatch.llm.store import settled


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """(a, b) with a > b: every neighbour of a node hangs on the smallest of the node and its neighbours."""
    both = edges.select("a", "b") if not larger else edges.select("a", "b").union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    linked = both.join(low, "a")
    if larger:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            low.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; the root is its component's smallest node."""
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "components")
    before = None
    while True:
        edges = settled(_star(_star(edges, True), False), "components")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
