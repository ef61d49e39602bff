"""Connected components by alternating large-star and small-star rounds.

Every round is a few joins and aggregations over the edges and ends in a written table, so
lineage stays short.  Edges converge to stars around each component's smallest node; the number of rounds grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_counted
from tidemark.session import materialize


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """Link every ``v`` of a node ``u`` to the smallest of ``u`` and its ``v``; hubs are broadcast, see join_counted."""
    low = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    return join_counted(pairs, low, ["u"], "n", total)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component``: smallest reachable node, for every node of ``edges(u, v)``.

    Self-loops and repeated edges are allowed, nulls are not.  No edges give no rows.
    """
    edges = materialize(edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").filter("u > v").distinct())
    state = None
    for _ in range(max_rounds):
        total = 2 * edges.count()
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        large = _star(both, total).filter("v > u").selectExpr("v AS u", "m AS v").distinct()
        large = materialize(large.filter("u > v"))
        near = _star(large, total)
        small = near.selectExpr("v AS u", "m AS v").unionByName(near.selectExpr("u", "m AS v"))
        edges = materialize(small.filter("u > v").distinct())
        # Equal counts and hash sums of the edges: nothing moved.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return nodes.unionByName(roots)
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
