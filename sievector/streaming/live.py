"""Structured Streaming around the batch operators: queries that arrive are answered, changes that arrive are applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievector.operators import encode, search


def answer(queries: DataFrame, base: DataFrame, k: int, out: str, checkpoint: str, predicate: str | Column | None = None, metric: str = "l2") -> StreamingQuery:
    """Answers a stream of (query_id, q) against ``base``: one exact block search a micro-batch, whose rows
    (batch, query_id, rank, vec_id, dist) go to a folder of their own, so a batch that runs again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        found = search.knn_blocks(base, batch.select("query_id", "q"), k, predicate, metric)
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_changes(changes: DataFrame, folder: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Applies a stream of rows with ``deleted`` to a table kept as numbered versions ``version=N`` under ``folder``.

    Within a micro-batch the last change of a key in ``order`` counts.  Batch n writes version n + 1 from version n, so
    one that runs again writes the same version; version 0 is there before the stream starts.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = encode.last_wins(batch, key, order).drop(order)
        encode.upsert(spark.read.parquet(f"{folder}/version={number}"), last, key).write.mode("overwrite").parquet(f"{folder}/version={number + 1}")

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
