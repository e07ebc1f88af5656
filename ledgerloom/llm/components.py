"""Connected components by alternating large-star and small-star.

Edges stay in distributed tables.  Each step takes the smallest neighbour of
every node with partial aggregation and joins it back; the minima are written
first, so that both sides of the join come from plain exchanges and adaptive
execution can split a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import forget, written


def _step(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
    near = both.join(least.hint("merge"), "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    made = written(out.where("u <> v").distinct(), "star-edges")
    forget(least)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) edges; component is the smallest reachable node.

    Each step keeps edges as (u, v) with u > v.  It ends when neither star
    changes the edges: every node then points at its component's smallest.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")

    def mark(df: DataFrame) -> tuple:
        r = df.select(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16)).alias("x")).first()
        return r.n, r.x

    before, at = None, mark(now)
    while at != before and at[0]:
        for large in (True, False):
            after = _step(now, large)
            forget(now)
            now = after
        before, at = at, mark(now)
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
