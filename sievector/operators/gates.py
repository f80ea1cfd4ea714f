"""Walks over a neighbour graph under a filter tree: which nodes may be crossed, and which are results.

Each leaf of the filter has a set of buckets.  A node passes a leaf if its own bucket is in the set or if its
bitmap (``graph.bits``: the buckets that its paths lead to) has one of them.  Results always satisfy the exact filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievector.functions.filters import Attribute, Logic, Node, allowed_buckets, leaves, parse, to_column
from sievector.operators import search


def traversal(base: DataFrame, bits: dict[str, DataFrame], node: Node, attributes: dict[str, Attribute], gate: str = "fid_or_tb", prefix: str = "fid_") -> DataFrame:
    """``base`` with ``gate``: whether the node may be crossed.

    ``bits`` are (node_id, bucket) by attribute.  ``fid_or_tb`` takes own buckets or bitmaps and follows the tree; ``tb``
    takes bitmaps alone; ``any`` takes either and joins all leaves by OR, whatever the tree says, so that a walk for an AND of two
    attributes still finds its way.
    """
    if gate not in ("fid_or_tb", "tb", "any"):
        raise ValueError(f"unknown gate {gate!r}")
    tests: list[Column] = []
    out = base
    for i, leaf in enumerate(leaves(node)):
        allowed = sorted(allowed_buckets(leaf, attributes[leaf.field]))
        held = bits[leaf.field].where(F.col("bucket").isin(allowed)).select(F.col("node_id").alias("vec_id"), F.lit(True).alias(f"__tb{i}")).distinct()
        out = out.join(held, "vec_id", "left")
        test = F.coalesce(F.col(f"__tb{i}"), F.lit(False))
        tests.append(test if gate == "tb" else test | F.col(f"{prefix}{leaf.field}").isin(allowed))

    def tree(at: Node) -> Column:
        if not isinstance(at, Logic):
            return tests.pop(0)
        left, right = tree(at.left), tree(at.right)
        return left & right if at.op == "AND" and gate != "any" else left | right

    passes = tree(node)
    return out.withColumn("gate", passes).select(*base.columns, "gate")


def descend(base: DataFrame, queries: DataFrame, shrink: int = 16, seed: int = 100) -> DataFrame:
    """(query_id, vec_id) where each query enters: the nearest node of the upper layer, which has one node in ``shrink`` by hash.

    The layer is searched whole, by blocks, so an entry is at least as near as a greedy way down would find."""
    layer = base.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(shrink)) == 0)
    if not layer.limit(1).count():
        layer = base
    return search.knn(layer, queries, 1).select("query_id", "vec_id")


def graph_search(
    base: DataFrame, edges: DataFrame, bits: dict[str, DataFrame], queries: DataFrame, k: int, predicate: str, attributes: dict[str, Attribute],
    ef: int, hops: int | None, gate: str = "fid_or_tb", break_factor: float | None = None, done: Callable[[DataFrame], DataFrame] | None = None, metric: str = "l2",
) -> DataFrame:
    """Approximate filtered kNN on a graph (query_id, rank, vec_id, dist); ``base`` has encoded attributes (``encode.encode``).

    With a ``break_factor`` a query stops at ceil(k * break_factor) accepted results; ``done`` is any other stop condition, as ``search.beam`` takes it.
    """
    node = parse(predicate)
    exact = to_column(node, base.schema)
    nodes = traversal(base, bits, node, attributes, gate)
    enough = math.ceil(k * break_factor) if break_factor else None
    return search.beam(nodes, edges, queries, k, exact, F.col("gate"), ef, hops, descend(base, queries), metric, enough, done)
