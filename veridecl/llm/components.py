"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) has u > v here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of any ordered type to rows (node, component), component being the smallest node reachable.

    Nodes without an edge to another node have no row; null ends are left out. The work of a round is in
    proportion to the edges; each round's edges are a table in the shared folder, so a lost executor costs one
    round. A node with very many neighbours is met by a partial minimum and by joins that can be split.
    """
    now = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        # done when every node hangs on one root and no root hangs on another node
        roots = now.select(F.col("v").alias("u")).distinct()
        if now.join(roots, "u", "left_semi").isEmpty() and now.groupBy("u").count().filter("count > 1").isEmpty():
            break
        after = materialize(_small_star(_large_star(now)), "edges")
        forget(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
