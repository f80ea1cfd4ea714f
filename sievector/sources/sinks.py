"""Result files: top-k lines, per-query CSV, summary text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topk_lines(found: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, hits) with hits ``id:dist,id:dist`` in order of rank."""
    pair = F.concat_ws(":", F.col("vec_id").cast("string"), F.format_string(f"%.{digits}f", "dist"))
    hits = F.array_sort(F.collect_list(F.struct("rank", pair.alias("hit"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(hits, lambda x: x["hit"]), ",").alias("hits"))


def write_topk(found: DataFrame, path: str) -> None:
    topk_lines(found).write.mode("overwrite").csv(path, sep="\t", quote="")


def write_per_query(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def read_runs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Result CSVs of several selectivities as one table, each row with the name of its run; columns that a file lacks are null."""
    parts = [spark.read.csv(p, header=True, inferSchema=True).withColumn("selectivity", F.lit(name)) for name, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_missing_groups(found: DataFrame, path: str) -> None:
    """Lines ``entry id id ...`` of the nodes that stand for buckets an entry point lacks, in order of bucket and rank."""
    nodes = F.array_sort(F.collect_list(F.struct("bucket", "rank", "vec_id")))
    line = F.concat_ws(" ", F.col("entry").cast("string"), F.array_join(F.transform("nodes", lambda x: x["vec_id"].cast("string")), " "))
    found.groupBy("entry").agg(nodes.alias("nodes")).select(line.alias("value")).write.mode("overwrite").text(path)


def summary_text(row: DataFrame) -> str:
    """``key: value`` lines of a table of one row."""
    (one,) = row.limit(2).collect()
    return "".join(f"{k}: {v}\n" for k, v in one.asDict().items())
