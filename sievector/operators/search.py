"""Filtered nearest-neighbour search: exact, by radius, by document, with a post-filter, and by gated walks.

Query sets travel to the tasks and are checked first: more than ``QUERY_CELLS`` vector elements are searched in
blocks of that size.  Base vectors are never broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievector.functions import distance
from sievector.functions.filters import parse, to_column

#: Elements of a query block that travels to every task (32 MB as doubles).
QUERY_CELLS = 4 << 20
#: Cells of a distance block that a task holds.
BLOCK_CELLS = 4 << 20
#: Vector elements of a graph that travels to the tasks whole (64 MB as floats); walks over larger graphs are joins.
GRAPH_CELLS = 16 << 20


class VectorError(ValueError):
    """A vector of another dimension than the queries, or a query set with several."""


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; a vector of another width is an error that names it."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise VectorError(f"a vector has {int(sizes[sizes != width][0])} elements, not {width}")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def where(base: DataFrame, predicate: str | Column | None) -> DataFrame:
    """Rows that satisfy a filter text or column."""
    if predicate is None:
        return base
    return base.where(to_column(parse(predicate), base.schema) if isinstance(predicate, str) else predicate)


def scored(base: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """(query_id, vec_id, dist, other base columns) of every query and row, in the JVM.

    ``queries`` (query_id, q) must fit one block; larger sets go through ``knn_blocks``.
    """
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    if n * width > QUERY_CELLS:
        raise ValueError("too many queries for one block; use knn_blocks")
    return base.where("embedding is not null").crossJoin(F.broadcast(queries.where("q is not null"))).withColumn("dist", distance.COLUMNS[metric](F.col("q"), F.col("embedding"))).drop("q", "embedding")


def nearest(pairs: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), tie: str = "vec_id") -> DataFrame:
    """The k rows of least distance of each group, ties by id, with ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy("dist", tie)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(base: DataFrame, queries: DataFrame, k: int, predicate: str | Column | None = None, metric: str = "l2", method: str = "auto") -> DataFrame:
    """Exact filtered kNN (query_id, rank, vec_id, dist).  The filter runs before any distance; tasks keep
    k rows a query before the shuffle.

    ``auto`` takes matrix products over Arrow batches for floating-point metrics, which beat array lambdas
    even on small sets; ``columns`` stays in the JVM.
    """
    if method == "auto" and metric in ("l2", "ip"):
        return knn_blocks(base, queries, k, predicate, metric)
    pairs = scored(where(base, predicate).select("vec_id", "embedding"), queries, metric)
    return nearest(pairs, k).select("query_id", "rank", "vec_id", "dist")


def knn_blocks(base: DataFrame, queries: DataFrame, k: int, predicate: str | Column | None = None, metric: str = "l2") -> DataFrame:
    """The same by matrix products over Arrow batches, for many queries.

    A task holds a query block and k candidates a query; blocks of queries follow each other.  Rows without a
    vector are never near; queries without one have no results.
    """
    spark = base.sparkSession
    parts = []
    for ids, q in query_blocks(queries):
        shared = spark.sparkContext.broadcast((ids, q))
        parts.append(where(base, predicate).where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_partial(shared, k, metric), "query_id long, vec_id long, dist double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, dist double")
    return nearest(reduce(DataFrame.union, parts), k).select("query_id", "rank", "vec_id", "dist")


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries that have one, in blocks of about ``QUERY_CELLS`` elements."""
    queries = queries.where("q is not null")
    n, width, least = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1)), F.coalesce(F.min(F.size("q")), F.lit(1))).first()
    if n and width != least:
        raise VectorError(f"queries have {least} to {width} elements")
    blocks = max(1, -(-n * width // QUERY_CELLS))
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = own.orderBy("query_id").collect()  # one block of the stated size
        if rows:
            yield np.array([r["query_id"] for r in rows], np.int64), np.array([r["q"] for r in rows], np.float64)


def _partial(shared, k: int, metric: str):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best_d, best_id = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            for lo in range(0, batch.num_rows, most := max(1, BLOCK_CELLS // max(1, q.shape[1]))):
                part = batch.slice(lo, most)
                rows, own = matrix(part.column(1), q.shape[1]), part.column(0).to_numpy()
                # few queries against many rows: each query's k best are merged once a batch
                for at in range(0, len(q), step := max(1, BLOCK_CELLS // len(own))):
                    merge(best_d, best_id, np.arange(at, min(at + step, len(q))), q, own, rows, metric)
        keep = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(1))), pa.array(best_id[keep]), pa.array(best_d[keep])], ["query_id", "vec_id", "dist"])

    return body


def merge(best_d: np.ndarray, best_id: np.ndarray, who: np.ndarray, q: np.ndarray, own: np.ndarray, rows: np.ndarray, metric: str) -> None:
    """Put rows (ids ``own``) that belong there into the k best of the queries ``who``, in place."""
    if not len(who) or not len(own):
        return
    k = best_d.shape[1]
    rough = distance.block(q[who], rows, metric)
    slack = distance.rounding(q[who], rows)
    # what may enter: within rounding of the k-th best so far and of the k-th of some of the block's own
    limit = best_d[who, -1]
    if not np.isfinite(limit).all() and len(own) > k:
        limit = np.minimum(limit, np.partition(rough[:, : max(1024, k)], k - 1, 1)[:, k - 1])
    near = rough <= (limit + slack)[:, None]
    if np.count_nonzero(near) > 32 * k * len(who) and len(own) > k:
        limit = np.minimum(limit, np.partition(rough, k - 1, 1)[:, k - 1])
        near = rough <= (limit + slack)[:, None]
    qi, ri = np.nonzero(near)
    if not len(qi):
        return
    step = max(1, BLOCK_CELLS // 4 // q.shape[1])  # copies of one vector may all enter
    exact = np.concatenate([distance.pairs(q[who[qi[at : at + step]]], rows[ri[at : at + step]], metric) for at in range(0, len(qi), step)])
    some = np.unique(qi)
    at = np.concatenate([np.repeat(some, k), qi])
    d, v = np.concatenate([best_d[who[some]].ravel(), exact]), np.concatenate([best_id[who[some]].ravel(), own[ri]])
    order = np.lexsort((v, d, at))
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    best = order[first[:, None] + np.arange(k)[None, :]]  # every group has k rows at least
    best_d[who[some]], best_id[who[some]] = d[best], v[best]


def places(base: DataFrame, queries: DataFrame, found: DataFrame, metric: str = "l2") -> DataFrame:
    """(query_id, vec_id, place): where rows of ``found`` (query_id, vec_id, dist) stand among all rows, from 1, ties by id.

    Counts of nearer rows, a number a query and row of ``found``, are all that tasks hold and send.
    """
    spark, parts = base.sparkSession, []
    for ids, q in query_blocks(queries):
        own = found.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "query_id long")), "query_id")
        row, marks = {i: n for n, i in enumerate(ids.tolist())}, [[] for _ in ids]
        for r in own.select("query_id", "vec_id", "dist").collect():  # k rows a query of the block
            marks[row[r["query_id"]]].append((r["dist"], r["vec_id"]))
        k = max(map(len, marks))
        if not k:
            continue
        dist, vec = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for i, own_marks in enumerate(marks):
            for j, (d, v) in enumerate(own_marks):
                dist[i, j], vec[i, j] = d, v
        shared = spark.sparkContext.broadcast((ids, q, dist, vec))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, dist, vec = shared.value
            nearer = np.zeros(dist.shape, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, step := max(1, BLOCK_CELLS // len(q))):
                    rows, own = matrix(batch.column(1).slice(at, step), q.shape[1]), batch.column(0).slice(at, step).to_numpy()
                    rough = distance.block(q, rows, metric)
                    slack = 1e-9 * (1 + np.abs(rough).max())
                    for j in range(dist.shape[1]):
                        below, upto = rough < dist[:, j : j + 1] - slack, rough <= dist[:, j : j + 1] + slack
                        nearer[:, j] += below.sum(1)
                        qi, ri = np.nonzero(upto & ~below)  # within rounding of the mark
                        exact = distance.pairs(q[qi], rows[ri], metric)
                        before = (exact < dist[qi, j]) | (exact == dist[qi, j]) & (own[ri] < vec[qi, j])
                        nearer[:, j] += np.bincount(qi, before, len(q)).astype(np.int64)
            there = np.isfinite(dist)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(1))), pa.array(vec[there]), pa.array(nearer[there])], ["query_id", "vec_id", "nearer"])

        rows = base.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        parts.append(rows.mapInArrow(count, "query_id long, vec_id long, nearer long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, vec_id long, place long")
    return reduce(DataFrame.union, parts).groupBy("query_id", "vec_id").agg((F.sum("nearer") + 1).alias("place"))


def post_filter(base: DataFrame, queries: DataFrame, k: int, predicate: str | Column, max_candidates: int, metric: str = "l2") -> DataFrame:
    """Iterative post-filter (query_id, rank, vec_id, dist, candidates): the nearest c rows are filtered, and c
    doubles from k until k survive or c reaches the cap.

    The c that the loop would stop at follows from where the k nearest survivors stand among all rows, so nothing as
    large as the cap is ranked or kept.
    """
    from sievector.plans.staging import stage

    cap = min(max_candidates, base.where("embedding is not null").count())
    ladder = [k]
    while ladder[-1] < cap:
        ladder.append(min(2 * ladder[-1], cap))
    ladder[0] = min(k, cap)
    found = stage(knn(base, queries, k, predicate, metric), "survivors")
    kept = found.join(places(base, queries, found, metric), ["query_id", "vec_id"])
    kth = F.max(F.when(F.col("rank") == k, F.col("place"))).over(Window.partitionBy("query_id"))
    stop = reduce(lambda x, c: F.when(kth <= c, F.lit(c)).otherwise(x), reversed(ladder), F.lit(cap))
    kept = kept.withColumn("candidates", stop).where(F.col("place") <= F.col("candidates"))
    return kept.select("query_id", "rank", "vec_id", "dist", "candidates")


def radius(base: DataFrame, queries: DataFrame, epsilon: float, limit: int, predicate: str | Column | None = None, metric: str = "l2") -> DataFrame:
    """Rows within ``epsilon``, nearest first, at most ``limit`` a query."""
    # the nearest ``limit`` of those within epsilon are those within epsilon of the nearest ``limit``
    return knn(base, queries, limit, predicate, metric).where(F.col("dist") <= epsilon)


def documents(base: DataFrame, queries: DataFrame, k: int, predicate: str | Column | None = None, metric: str = "l2") -> DataFrame:
    """The k documents (``doc``) whose nearest vector is nearest."""
    pairs = scored(where(base, predicate).select("vec_id", "doc", "embedding"), queries, metric)
    least = pairs.groupBy("query_id", "doc").agg(F.min("dist").alias("dist"))
    return nearest(least, k, tie="doc").select("query_id", "rank", "doc", "dist")


def candidates_needed(k: int, ef: int | None = None, break_factor: float | None = None) -> int:
    """Width of a walk: given, or from the break factor, or at least 100."""
    if ef:
        return ef
    return max(k, int(np.ceil(k * break_factor))) if break_factor else max(100, k)


def beam(
    base: DataFrame, edges: DataFrame, queries: DataFrame, k: int, allowed: Column, gate: Column, ef: int, hops: int | None = None, entry: int | DataFrame = 0, metric: str = "l2", enough: int | None = None, done: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Approximate gated walk (query_id, rank, vec_id, dist).

    A query starts from the entry row, or from the one which ``entry`` (query_id, vec_id) names for it.  A hop reaches the links of the
    frontier; rows that pass ``gate`` and are neither expanded nor waiting are scored, the best ``ef`` of these and of the waiting ones
    are the next frontier, and the next best ``ef`` wait.  Rows of a frontier that are ``allowed`` are accepted as results; the
    entry row is expanded whatever the gate says.

    A query stops when its ``ef`` best results are all nearer than its frontier, when ``enough`` results are accepted, when nothing is left
    to reach, or when ``done`` says so, which gets the best results so far (query_id, vec_id, dist, hop) and names queries (query_id).
    Without ``hops`` nothing else ends a walk.

    A graph of at most ``GRAPH_CELLS`` vector elements travels to the tasks, and each walks its own queries to the end.  With a larger
    one, or with ``done``, all queries walk together, a hop a join.  Both ways take the same steps.
    """
    nodes = base.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", allowed.alias("allowed"), gate.alias("gate"))
    asked = queries.where("q is not null")
    entries = asked.select("query_id", F.lit(entry).cast("long").alias("vec_id")) if isinstance(entry, int) else entry.select("query_id", "vec_id")
    width = max(k, ef, enough or 0)
    n, wide = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if done is None and n * wide <= GRAPH_CELLS:
        return _walk_alone(nodes, edges, asked, entries, k, ef, width, hops, metric, enough)
    return _walk_together(nodes, edges, asked, entries, k, ef, width, hops, metric, enough, done)


def _walk_alone(nodes: DataFrame, edges: DataFrame, asked: DataFrame, entries: DataFrame, k: int, ef: int, width: int, hops: int | None, metric: str, enough: int | None) -> DataFrame:
    from sievector.plans.staging import stage

    spark = nodes.sparkSession
    got = nodes.toArrow().sort_by("vec_id").combine_chunks()  # GRAPH_CELLS vector elements at most
    ids = got["vec_id"].to_numpy()
    wide = len(got["embedding"][0]) if len(ids) else 0
    sizes = pa.compute.list_value_length(got["embedding"]).to_numpy()
    if (sizes != wide).any():
        raise VectorError(f"a vector has {int(sizes[sizes != wide][0])} elements, not {wide}")
    x = pa.compute.list_flatten(got["embedding"]).to_numpy().reshape(len(ids), wide)
    flag = lambda c: pa.compute.fill_null(got[c], False).to_numpy(zero_copy_only=False)
    passing, results = flag("gate"), flag("allowed")
    links = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).toArrow()
    place = lambda c: np.minimum(np.searchsorted(ids, links[c].to_numpy()), max(0, len(ids) - 1))
    if len(ids):
        src, dst = place("src"), place("dst")
        known = (ids[src] == links["src"].to_numpy()) & (ids[dst] == links["dst"].to_numpy()) & passing[dst]
        src, dst = src[known], dst[known].astype(np.int32)
    else:
        src, dst = np.empty(0, np.int64), np.empty(0, np.int32)
    order = np.argsort(src, kind="stable")
    starts = np.searchsorted(src[order], np.arange(len(ids) + 1))
    shared = spark.sparkContext.broadcast((ids, x, results, starts, dst[order]))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, results, starts, links = shared.value
        away = np.zeros(len(ids), bool)  # expanded or waiting
        for batch in batches:
            found: list[tuple] = []
            for query, q, entry in zip(batch.column(0).to_pylist(), matrix(batch.column(1), x.shape[1]) if len(ids) else [], batch.column(2).to_pylist()):
                at = int(np.searchsorted(ids, entry))
                if at < len(ids) and ids[at] == entry:
                    i, d = _walk(x, results, starts, links, q, at, ef, width, hops, metric, enough, away)
                    found.append((np.full(len(i[:k]), query), np.arange(1, len(i[:k]) + 1, dtype=np.int32), ids[i[:k]], d[:k]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "rank", "vec_id", "dist"])

    own = asked.join(entries, "query_id").select(F.col("query_id").cast("long").alias("query_id"), "q", "vec_id")
    dealt = own.repartition(4 * spark.sparkContext.defaultParallelism)
    return stage(dealt.mapInArrow(body, "query_id long, rank int, vec_id long, dist double"), "walked")


def _walk(x: np.ndarray, results: np.ndarray, starts: np.ndarray, links: np.ndarray, q: np.ndarray, entry: int, ef: int, width: int, hops: int | None, metric: str, enough: int | None, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of one query's best results; ``away`` is all false before and after."""
    measure = lambda i: distance.pairs(q[None, :], x[i].astype(np.float64), metric)
    best = lambda i, d, n: (lambda o: (i[o], d[o]))(np.lexsort((i, d))[:n])
    front = np.array([entry])
    front_d = measure(front)
    left, left_d = np.empty(0, np.int64), np.empty(0)
    got, got_d = front[results[front]], front_d[results[front]]
    marked, hop = [front], 0
    away[front] = True
    while len(front) and (hops is None or hop < hops):
        hop += 1
        lo, n = starts[front], starts[front + 1] - starts[front]
        fresh = np.unique(links[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        fresh = fresh[~away[fresh]].astype(np.int64)
        i, d = best(np.concatenate([left, fresh]), np.concatenate([left_d, measure(fresh)]), 2 * ef)
        away[left] = False
        away[i] = True
        marked.append(i)
        front, front_d, left, left_d = i[:ef], d[:ef], i[ef:], d[ef:]
        mine = results[front]
        got, got_d = best(np.concatenate([got, front[mine]]), np.concatenate([got_d, front_d[mine]]), width)
        if enough is not None and len(got) >= enough or len(front) and len(got) >= ef and front_d[0] > got_d[ef - 1]:
            break
    away[np.concatenate(marked)] = False
    return best(got, got_d, width)


def _walk_together(nodes: DataFrame, edges: DataFrame, asked: DataFrame, entries: DataFrame, k: int, ef: int, width: int, hops: int | None, metric: str, enough: int | None, done: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """The walk by joins.  Every hop writes its own rows and the best results only."""
    from sievector.plans.staging import stage

    measure = lambda df: df.join(asked, "query_id").withColumn("dist", distance.COLUMNS[metric](F.col("q"), F.col("embedding"))).drop("q", "embedding")
    links = edges.select(F.col("src").alias("vec_id"), "dst")
    names = ["query_id", "vec_id", "allowed", "dist", "hop"]
    frontier = stage(measure(entries.join(nodes, "vec_id")).withColumn("hop", F.lit(0)).select(*names), "walk")
    waiting, expanded, best = frontier.limit(0), frontier.select("query_id", "vec_id"), frontier.where("allowed").drop("allowed")
    for hop in count(1) if hops is None else range(1, hops + 1):
        reached = frontier.join(links, "vec_id").select("query_id", F.col("dst").alias("vec_id")).distinct()
        met = expanded.unionByName(waiting.select("query_id", "vec_id"))
        fresh = measure(reached.join(met, ["query_id", "vec_id"], "left_anti").join(nodes.where("gate"), "vec_id")).withColumn("hop", F.lit(hop))
        ahead = stage(nearest(waiting.unionByName(fresh.select(*names)), 2 * ef), "walk")
        frontier = ahead.where(F.col("rank") <= ef).withColumn("hop", F.lit(hop)).select(*names)
        waiting = ahead.where(F.col("rank") > ef).select(*names)
        if not frontier.limit(1).count():
            break
        expanded = expanded.unionByName(frontier.select("query_id", "vec_id"))
        best = stage(nearest(best.unionByName(frontier.where("allowed").drop("allowed")), width).drop("rank"), "best")
        bound = nearest(best, width).groupBy("query_id").agg(F.count("*").alias("held"), F.max(F.when(F.col("rank") == ef, F.col("dist"))).alias("bound"))
        first = frontier.groupBy("query_id").agg(F.min("dist").alias("ahead"))
        full = F.col("ahead") > F.col("bound")
        over = first.join(bound, "query_id").where(full if enough is None else full | (F.col("held") >= enough)).select("query_id")
        if done is not None:
            over = over.unionByName(done(best).select("query_id"))
        over = stage(over.distinct(), "over")
        frontier, waiting = frontier.join(over, "query_id", "left_anti"), waiting.join(over, "query_id", "left_anti")
    return nearest(best, k).select("query_id", "rank", "vec_id", "dist")
