"""Ground truth against results: recall, selectivity, latency, comparisons of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievector.functions.scalars import pow2_bin, share


def recall(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, enns_size, anns_size, hits, recall_at_k): hits over min(k, true rows); a query without true rows
    has recall 1 if nothing was found, else 0."""
    true = truth.groupBy("query_id").agg(F.count("*").alias("enns_size"))
    got = found.groupBy("query_id").agg(F.count("*").alias("anns_size"))
    hit = found.join(truth, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    out = queries.select("query_id").join(true, "query_id", "left").join(got, "query_id", "left").join(hit, "query_id", "left").na.fill(0)
    ratio = F.when(F.col("enns_size") > 0, F.col("hits") / F.least(F.lit(k), F.col("enns_size"))).otherwise((F.col("anns_size") == 0).cast("double"))
    return out.withColumn("recall_at_k", ratio)


def recall_by_position(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Recall over the first min(k, true rows) ranks of both."""
    sizes = truth.groupBy("query_id").agg(F.least(F.lit(k), F.count("*")).alias("n"))
    head = lambda df: df.join(sizes, "query_id").where(F.col("rank") <= F.col("n"))
    hits = head(found).join(head(truth), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return sizes.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall_at_k"))


def recall_summary(per_query: DataFrame, k: int) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), F.avg("recall_at_k").alias("avg_recall"), F.count_if(F.col("enns_size") < k).alias("short_queries"))


def selectivity(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(name, matched, total, ratio) of each predicate, in one scan."""
    counted = rows.agg(F.count("*").alias("total"), *[F.count_if(p).alias(f"p{i}") for i, p in enumerate(predicates.values())])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"p{i}").alias("matched")) for i, name in enumerate(predicates)])).alias("x")
    return counted.select("total", each).select("x.name", "x.matched", "total", share(F.col("x.matched"), F.col("total")).alias("ratio"))


def joint_selectivity(rows: DataFrame, exact: list[Column], ranges: list[Column]) -> DataFrame:
    """Matches under AND and under OR of the exact conditions; ranges are ANDed to both, and OR needs two."""
    both = F.lit(True)
    for c in (*exact, *ranges):
        both = both & c
    either = F.lit(False)
    for c in exact:
        either = either | c
    for c in ranges:
        either = either & c
    out = [F.count("*").alias("total"), F.count_if(both).alias("and_matched")]
    return rows.agg(*out, (F.count_if(either) if len(exact) > 1 else F.lit(None).cast("long")).alias("or_matched"))


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact interpolated percentiles, mean and queries a second of times in nanoseconds."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p.alias("p"), F.sum(value).alias("total"))
    return out.select(*by, "n", "mean", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"), F.get("p", F.lit(2)).alias("p99"), F.try_divide(F.col("n") * 1e9, F.col("total")).alias("qps"))


def rough_latency(rows: DataFrame, value: str, by: list[str], accuracy: int = 10_000) -> DataFrame:
    """The same with percentiles off by at most 1 / ``accuracy`` in rank, from sketches of bounded size: for groups whose values
    are too many to sort in one task."""
    p = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), accuracy)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p.alias("p"), F.sum(value).alias("total"))
    return out.select(*by, "n", "mean", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"), F.get("p", F.lit(2)).alias("p99"), F.try_divide(F.col("n") * 1e9, F.col("total")).alias("qps"))


def counters(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Sum and mean a query of each counter: (by..., queries, sum_<name>, mean_<name>)."""
    return rows.groupBy(*by).agg(F.count("*").alias("queries"), *[f(n).alias(f"{kind}_{n}") for n in names for kind, f in (("sum", F.sum), ("mean", F.avg))])


def medians_by_bin(rows: DataFrame, size: str, value: str) -> DataFrame:
    """Median of ``value`` by power-of-two bin of ``size``."""
    return rows.where(F.col(size) > 0).groupBy(pow2_bin(F.col(size)).alias("bin")).agg(F.count("*").alias("n"), F.median(value).alias("median_value"))


def method_deltas(results: DataFrame, old: str, new: str) -> DataFrame:
    """Relative gain of one method over another by selectivity: mean, median, best and worst, with their ef.

    ``results`` has (method, selectivity, ef, qps)."""
    side = lambda m, name: results.where(F.col("method") == m).select("selectivity", "ef", F.col("qps").alias(name))
    pairs = side(old, "q_old").join(side(new, "q_new"), ["selectivity", "ef"]).withColumn("gain", F.try_divide(F.col("q_new") - F.col("q_old"), F.col("q_old")))
    return pairs.groupBy("selectivity").agg(
        F.avg("gain").alias("mean_gain"), F.median("gain").alias("median_gain"), F.max("gain").alias("best_gain"), F.min("gain").alias("worst_gain"), F.max_by("ef", F.struct("gain", "ef")).alias("best_ef"), F.min_by("ef", F.struct("gain", "ef")).alias("worst_ef")
    )


def series(runs: DataFrame) -> DataFrame:
    """Points of QPS-over-recall curves: good, finite runs, numbered by recall within method and selectivity."""
    good = runs.where((F.col("status") == "OK") & F.col("qps").isNotNull() & (F.abs("qps") < F.lit(float("inf"))) & F.col("recall").isNotNull())
    order = Window.partitionBy("method", "selectivity").orderBy("recall", "qps")
    return good.select("method", "selectivity", "recall", "qps", F.row_number().over(order).alias("place"))
