"""Connected components of an edge table, by contraction, with nothing but joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievector.plans.staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges(a, b)``; ``root`` is the smallest node of the component.

    Every round each node points at its least neighbour if that is smaller, pointers are followed
    twice, and edges are drawn anew between roots.  Each round that leaves edges at least halves the
    nodes that have any, so rounds grow with the logarithm of the nodes.  Tables between rounds are
    staged, so a lost executor costs one round at most.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both(edges.where(F.col("a") != F.col("b"))).distinct(), "edges")
    roots = None
    while edges.limit(1).count():
        least = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
        step = _jump(_jump(stage(least, "up")))
        step = stage(step, "up")
        if roots is None:
            roots = step.select("node", F.col("up").alias("root"))
        else:
            moved = roots.join(step.withColumnRenamed("node", "root"), "root", "left")
            roots = stage(moved.select("node", F.coalesce("up", "root").alias("root")), "roots")
        ends = step.select(F.col("node").alias("a"), F.col("up").alias("a2"))
        other = step.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        drawn = edges.join(ends, "a").join(other, "b").where("a2 != b2").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        edges = stage(drawn.distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _jump(step: DataFrame) -> DataFrame:
    onward = step.select(F.col("node").alias("up"), F.col("up").alias("next"))
    return step.join(onward, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
