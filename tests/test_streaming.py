from pyspark.sql import functions as F

from sievector.operators import search
from sievector.streaming import live

SF = "/root/testdata/sf0.001"


def test_queries_that_arrive(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = base.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    queries.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    live.answer(stream, base, 5, f"{tmp_path}/out", f"{tmp_path}/at", "label < 5").awaitTermination()
    names = ("query_id", "rank", "vec_id", "dist")
    got, want = spark.read.parquet(f"{tmp_path}/out").select(*names), search.knn(base, queries, 5, "label < 5").select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_changes_that_arrive(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string").write.parquet(f"{tmp_path}/t/version=0")
    kind = "k long, v string, deleted boolean, n long"
    for i, rows in enumerate(([(2, "x", False, 1), (2, "B", False, 2), (4, "d", False, 3)], [(3, "", True, 4), (4, "D", False, 5)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        live.apply_changes(stream, f"{tmp_path}/t", "k", "n", f"{tmp_path}/at").awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t/version={i + 1}").collect()))
        assert got == [[(1, "a"), (2, "B"), (3, "c"), (4, "d")], [(1, "a"), (2, "B"), (4, "D")]][i]
