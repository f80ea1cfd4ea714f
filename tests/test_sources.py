import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievector.functions.filters import Attribute
from sievector.sources import manifest, metadata, sinks, vectors


def records(rows, kind):
    return b"".join(np.int32(len(r)).tobytes() + np.asarray(r).astype(kind).tobytes() for r in rows)


@pytest.mark.parametrize("suffix,kind", [(".fvecs", "<f4"), (".bvecs", "u1"), (".ivecs", "<i4")])
def test_vector_files(spark, tmp_path, suffix, kind):
    data = [[i, 200 - i, 7] for i in range(50)]
    path = str(tmp_path / f"x{suffix}")
    open(path, "wb").write(records(data, kind))
    df = vectors.read(spark, path, rowsPerPartition=16)
    assert df.rdd.getNumPartitions() == 4
    assert [(r["vec_id"], list(r["embedding"])) for r in df.orderBy("vec_id").collect()] == [(i, [float(x) for x in d] if suffix == ".fvecs" else d) for i, d in enumerate(data)]
    assert [r[0] for r in vectors.read(spark, path, start=10, end=12).select("vec_id").collect()] == [10, 11]
    again = str(tmp_path / f"y{suffix}")
    assert vectors.write(df, again) == 50 and open(again, "rb").read() == open(path, "rb").read()
    parts = vectors.write_parts(df, str(tmp_path / "parts"), suffix).collect()
    assert b"".join(open(p["path"], "rb").read() for p in sorted(parts, key=lambda p: p["first"])) == open(path, "rb").read()


@pytest.mark.parametrize("data", [b"", b"\x01", records([[1, 2], [1]], "<f4"), np.int32(0).tobytes(), np.int32(-3).tobytes() + b"1234", records([[1.0, 2.0]], "<f4")[:-1]])
def test_bad_vector_files(tmp_path, data):
    path = tmp_path / "x.fvecs"
    path.write_bytes(data)
    with pytest.raises(vectors.VectorFileError):
        file = vectors.inspect(str(path))
        vectors.read_rows(file, 0, file.num)


def test_unknown_suffix(tmp_path):
    with pytest.raises(vectors.VectorFileError):
        vectors.inspect(str(tmp_path / "x.npy"))


def test_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿id , a,b\n0, x ,1\n1,,2\n"2","q""t, u",3\nbad,z,4\n9,z,5\n0,y,6\n', encoding="utf-8")
    df, counters = metadata.read_csv(spark, str(path), ["a", "nope"], "id", 5)
    assert {r["label"]: r["a"] for r in df.collect()} == {0: "y", 1: "", 2: 'q"t, u'}
    assert tuple(counters.first()) == (6, 4, 1, 1)
    with pytest.raises(ValueError):
        metadata.read_csv(spark, str(path), ["nope"], "id", 5)


def test_jsonl(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"a": 1, "b": true}\n\nbroken\n{"a": null, "c": 1.5}\n[1]\n{"a": "x", "d": {"e": [1]}}\n{"a": 9}\n')
    df, counters = metadata.read_jsonl(spark, str(path), ["a", "b", "c", "d"], 6)
    assert {r["label"]: (r["a"], r["b"], r["c"], r["d"]) for r in df.collect()} == {0: ("1", "true", None, None), 3: (None, None, "1.5", None), 5: ("x", None, None, '{"e":[1]}')}
    assert tuple(counters.first()) == (6, 3, 3)
    six, _ = metadata.read_jsonl(spark, str(path), ["a", "c"], 6, six_digits=True)
    assert {r["label"]: (r["a"], r["c"]) for r in six.collect()}[3] == (None, "1.500000")


def test_json_shapes(spark, tmp_path):
    for name, text in (("a", '[{"x": 1}, {"x": 2}]'), ("b", '{"x": 1}\n{"x": 2}\n')):
        (tmp_path / name).write_text(text)
        assert sorted(r["x"] for r in metadata.read_json(spark, str(tmp_path / name)).collect()) == [1, 2]
    (tmp_path / "f").write_text('[{"name": "t", "values": ["b", "a"]}]')
    assert metadata.category_order(spark, str(tmp_path / "f")) == {"t": ["b", "a"]}
    (tmp_path / "n").write_text("1 2 3\n\n4\n")
    assert {r["entry"]: list(r["neighbours"]) for r in metadata.extra_neighbours(spark, str(tmp_path / "n")).collect()} == {1: [2, 3], 4: []}
    (tmp_path / "c").write_text('a,b\n"x\ny",2\n')
    assert metadata.csv_column(spark, str(tmp_path / "c"), "a").first()[0] == "x\ny"


def test_manifest(tmp_path):
    path = str(tmp_path / "manifest.json")
    manifest.write(path, [Attribute("c", False, 255, categories={"a": 0}), Attribute("n", True, 255, 1.0, 2.0)], 10, 4, 256)
    head, attributes, files = manifest.read(path)
    assert head["n_elements"] == 10 and [a.key for a in attributes] == ["c", "n"] and attributes[1].max_value == 2.0
    assert files["c"][0].startswith(str(tmp_path))
    raw = json.load(open(path))
    del raw["attributes"][0]["fid_file"]
    json.dump(raw, open(path, "w"))
    with pytest.raises(ValueError):
        manifest.read(path)


def test_payloads(spark, tmp_path):
    fid, tb = str(tmp_path / "x.fid"), str(tmp_path / "x.tb")
    manifest.write_fid(fid, np.array([1, 255, 0]))
    assert [r["bucket"] for r in manifest.fid_table(spark, fid).orderBy("vec_id").collect()] == [1, 255, 0]
    bits = np.zeros((3, 256), bool)
    bits[0, 9] = bits[2, 255] = True
    manifest.write_tb(tb, bits)
    assert open(tb, "rb").read()[8:10] == b"\x00\x02" and (manifest.read_tb(tb) == bits).all()
    open(fid, "ab").write(b"x")
    with pytest.raises(ValueError):
        manifest.read_fid(fid)


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([(1, 2, 7, 0.5), (1, 1, 5, 0.25)], "query_id long, rank int, vec_id long, dist double")
    sinks.write_topk(found, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "1\t5:0.250000,7:0.500000"
    assert sinks.summary_text(found.agg(F.count("*").alias("n"))) == "n: 2\n"
    sinks.write_per_query(found, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).count() == 2


def test_saved_table(spark):
    metadata.save_table(spark.range(10).withColumnRenamed("id", "k"), "saved_for_test", "k", buckets=2)
    assert spark.table("saved_for_test").count() == 10
    spark.sql("drop table saved_for_test")
