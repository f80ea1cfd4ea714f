import numpy as np
import pytest
from pyspark.sql import functions as F

from sievector.functions import scalars
from sievector.operators import evaluate, profile
from sievector.plans import sql, staging
from sievector.sources import manifest, metadata, sinks

SF = "/root/testdata/sf0.01"  # no other test caches these


def test_functions_and_statement(spark):
    sql.register(spark)
    assert spark.sql("SELECT l2_sq(array(1, 2), array(4, 6)), inner_product(array(1, 2), array(4, 6))").first()[:] == (25.0, -15.0)
    base = spark.read.parquet(f"{SF}/embeddings.parquet")
    base.createOrReplaceTempView("vectors")
    query = base.where("vec_id = 7").first()["embedding"]
    got = [r["vec_id"] for r in spark.sql(sql.statement("vectors", query, 5, "label = 3")).collect()]
    rows = base.where("label = 3").collect()
    want = sorted(rows, key=lambda r: (((np.array(r["embedding"], float) - np.array(query, float)) ** 2).sum(), r["vec_id"]))
    assert got == [r["vec_id"] for r in want[:5]]
    plan = sql.explain(spark.sql(sql.statement("vectors", query, 5, "label = 3")))
    assert plan.top_k and any("label" in x for x in plan.pushed_filters) and not plan.partition_filters and "Scan parquet" in plan.text
    assert not sql.explain(base).top_k
    assert sql.operators("SELECT a <-> b, t.e<->array(1.0, 2.0) FROM t") == "SELECT l2_sq(a, b), l2_sq(t.e, array(1.0, 2.0)) FROM t"


def test_partition_filters_of_cells(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 4).alias("cell")).write.partitionBy("cell").parquet(f"{tmp_path}/cells")
    assert sql.explain(spark.read.parquet(f"{tmp_path}/cells").where("cell = 2")).partition_filters


def test_sentences(spark):
    texts = [
        ('What was said on the "Red Team" group chat, posted on 2021-03-04?', "2021-03-04", "Red Team"),
        ('POSTED  ON 2020-01-01 ON  THE "x" GROUP CHAT', "2020-01-01", "x"),
        ("on 2021-03-04 in group 'a'", None, None),
        ('on the "a" group chats', None, None),
        ('on the "a" b "c" group chat', None, 'a" b "c'),
        (None, None, None),
    ]
    rows = spark.createDataFrame(texts, "t string, d string, g string").select("d", "g", scalars.date_in(F.col("t")).alias("day"), scalars.group_in(F.col("t")).alias("name")).collect()
    assert all(r["d"] == r["day"] and r["g"] == r["name"] for r in rows)


def test_conditions(spark):
    rows = spark.createDataFrame([('{"url": "http://a", "t": "10:30", "n": 5, "b": true}',), ("broken",), (None,)], "j string")
    holds = lambda test: [r[0] for r in rows.select(test).collect()][0]
    for rule in ("url=http://a", "t=10:30", "n=5", "n=5.0", "b=true"):
        assert holds(profile.condition(F.col("j"), rule))
    assert not holds(profile.condition(F.col("j"), "url=http://b"))
    for rule, want in (("n=1:5", True), ("n=:4", False), ("n=5:", True), ("n=6:9", False)):
        assert holds(profile.range_condition(F.col("j"), rule)) == want
    for rule in ("n=5", "n=a:b"):
        with pytest.raises(ValueError):
            profile.range_condition(F.col("j"), rule)


def test_json_leaves(spark):
    texts = [(1, '{"a": {"b": {"c": 1.5, "d": [1, {"e": 2}]}, "n": null}, "s": "x", "t": true}'), (2, "[1]"), (3, "broken"), (4, None), (5, "{}"), (6, '{"a.b": {"c": 1}}')]
    rows = profile.json_leaves(spark.createDataFrame(texts, "id long, j string"), "j", "id").collect()
    assert sorted(map(tuple, rows)) == [(1, "a.b.c", "1.5"), (1, "a.b.d", '[1,{"e":2}]'), (1, "s", "x"), (1, "t", "true"), (6, "a.b.c", "1")]
    deep = profile.json_leaves(spark.createDataFrame(texts[:1], "id long, j string"), "j", "id", depth=2).collect()
    assert (1, "a.b", '{"c":1.5,"d":[1,{"e":2}]}') in set(map(tuple, deep))


def test_small_reports(spark, tmp_path):
    sizes = spark.createDataFrame([("a", 10, True), ("b", 30, True), ("c", 5, False), ("d", 50, False)], "attr string, bytes long, is_text boolean")
    kept = lambda budget: {r["attr"] for r in profile.chosen_columns(sizes, budget).where("kept").collect()}
    assert kept(95) == {"a", "b", "c", "d"} and kept(85) == {"b", "c", "d"} and kept(60) == {"c", "d"} and kept(50) == {"d"} and kept(0) == set()
    runs = spark.createDataFrame([("m", 2, 10), ("m", 4, 30), ("o", 1, None)], "method string, calls long, bytes long")
    assert sorted(map(tuple, evaluate.counters(runs, ["calls", "bytes"], ["method"]).collect())) == [("m", 2, 6, 3.0, 40, 20.0), ("o", 1, 1, 1.0, None, None)]
    for name, text in (("1", "q,recall\n1,0.5\n"), ("10", "q,recall,extra\n2,0.25,x\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    found = sinks.read_runs(spark, {"1%": f"{tmp_path}/1.csv", "10%": f"{tmp_path}/10.csv"})
    assert sorted((r["q"], r["recall"], r["selectivity"], r["extra"]) for r in found.collect()) == [(1, 0.5, "1%", None), (2, 0.25, "10%", "x")]
    missing = spark.createDataFrame([(5, 2, 1, 9), (5, 1, 2, 8), (5, 1, 1, 7), (6, 0, 1, 3)], "entry long, bucket int, rank int, vec_id long")
    sinks.write_missing_groups(missing, f"{tmp_path}/missing")
    read = metadata.extra_neighbours(spark, f"{tmp_path}/missing")
    assert sorted((r["entry"], r["neighbours"]) for r in read.collect()) == [(5, [7, 8, 9]), (6, [3])]
    texts = spark.createDataFrame([(" 'a b' ", "a b", "_a_b__"), ('"x', '"x', "_x"), ("''", "", "__"), ("k/v.1", "k/v.1", "k_v.1")], "t string, v string, k string").drop("k")
    assert all(r[0] == r[1] for r in texts.select(scalars.clean_value(F.col("t")), "v").collect())
    assert [r[0] for r in texts.select(scalars.clean_key(F.trim("t"))).collect()] == ["_a_b_", "_x", "__", "k_v.1"]


def test_bucket_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    fid, tb = rng.integers(0, 256, 1000), rng.random((1000, 256)) < 0.02
    manifest.write_fid(f"{tmp_path}/a.fid", fid)
    manifest.write_tb(f"file://{tmp_path}/a.tb", tb)
    assert (manifest.read_fid(f"{tmp_path}/a.fid") == fid).all() and (manifest.read_tb(f"{tmp_path}/a.tb") == tb).all()
    table = manifest.fid_table(spark, f"{tmp_path}/a.fid", rowsPerPartition=300)
    assert table.rdd.getNumPartitions() == 4 and [r["bucket"] for r in table.orderBy("vec_id").collect()] == fid.tolist()
    bits = manifest.tb_table(spark, f"{tmp_path}/a.tb", rowsPerPartition=300)
    assert sorted((r["vec_id"], r["bucket"]) for r in bits.collect()) == [tuple(x) for x in np.argwhere(tb).tolist()]
    (tmp_path / "b.fid").write_bytes((5).to_bytes(8, "little") + b"123")
    with pytest.raises(Exception, match="should have 5 bytes, not 3"):
        manifest.fid_table(spark, f"{tmp_path}/b.fid").collect()
    manifest.write_log(f"{tmp_path}/log", [("read", 1.5, 10), ("encode", 0.25, 10)])
    assert (tmp_path / "log").read_text() == "read: 1.500 s, 10 rows\nencode: 0.250 s, 10 rows\ntotal: 1.750 s\n"


def test_exact_row_count(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    rows, _ = metadata.read_jsonl(spark, f"{tmp_path}/a.jsonl", ["a"], 2, exactly=True)
    assert rows.count() == 2
    with pytest.raises(ValueError, match="has 2 lines, not 3"):
        metadata.read_jsonl(spark, f"{tmp_path}/a.jsonl", ["a"], 3, exactly=True)


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    class Bare:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Bare)
