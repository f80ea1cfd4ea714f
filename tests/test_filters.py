import random

import pytest
from pyspark.sql import functions as F

from sievector.functions import filters as f

VALUES = ["10", "10.0", "9", "abc", " 5", "5 ", "", "1.5d", "inf", "0x10", "-3e2", "1e999", None]
LITERALS = ["10", "'10'", "10.0", "abc", "'5 '", "''", "-300"]


@pytest.mark.parametrize("text", ["", "   ", "a ==", "a == 1 AND", "a IN []", "a IN (1)", "(a == 1", "a == 1 b", "a BETWEEN 1", "== 1", "a # 1", "a == 'x", "NOT a == 1 x", "a IN [1,]"])
def test_bad_filters(text):
    with pytest.raises(f.FilterError):
        f.parse(text)


def test_error_has_the_place():
    with pytest.raises(f.FilterError, match="at 5"):
        f.parse("a == (1)")


def test_shapes():
    assert f.parse("a.b-c == 'it\\'s'") == f.Compare("a.b-c", "==", "it's")
    assert f.parse("x between 1 and 2") == f.Between("x", "1", "2")
    assert f.parse("x in [1, 'b', c]") == f.In("x", ("1", "b", "c"))
    tree = f.parse("a == 1 OR b == 2 AND c == 3")
    assert tree.op == "OR" and tree.right.op == "AND"
    assert f.referenced_fields(tree) == ["a", "b", "c"]
    assert f.parse("958 <= w <= 965") == f.parse("(w >= 958 AND w <= 965)")


def test_recognisers():
    assert f.as_interval(f.parse("w >= 1 AND w < 5 AND w > 2")) == f.Interval("w", 2.0, 5.0, False, False)
    assert f.as_interval(f.parse("w BETWEEN 1 AND 5")).holds(5)
    assert f.as_interval(f.parse("w == 1")) is None and f.as_interval(f.parse("w > 1 AND v < 2")) is None
    assert f.single_field(f.parse("a > 1 OR a < 0")) == "a" and f.single_field(f.parse("a > 1 OR b < 0")) is None
    assert f.two_equalities(f.parse("a == 1 OR b == x"))[0] == "OR"
    for bad in ("a == 1 AND a == 2", "a == 1", "a == 1 AND b > 2"):
        with pytest.raises(f.FilterError):
            f.two_equalities(f.parse(bad))
    assert f.equality_tree(f.parse("a == 1 AND (b == 2 OR c == 3)")) and not f.equality_tree(f.parse("a == 1 AND b > 2"))
    assert f.relaxed(f.parse("a == 1 AND b == 2")).op == "OR"
    assert f.single_equality(f.parse("a == 4")) == ("a", "4")


def test_column_follows_the_row_rule(spark):
    texts = [f"v {op} {x}" for op in ("==", "!=", ">", ">=", "<", "<=") for x in LITERALS]
    texts += ["v IN [10, abc]", "v IN ['5 ']", "v BETWEEN 5 AND 10", "v BETWEEN 5 AND b", "v > 5 AND v < 11 OR v == abc"]
    rows = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = rows.select("v", *[F.coalesce(f.to_column(f.parse(t), rows.schema), F.lit(False)).alias(f"c{i}") for i, t in enumerate(texts)]).collect()
    for r in got:
        for i, t in enumerate(texts):
            assert r[f"c{i}"] == f.matches(f.parse(t), {"v": r["v"]}), (r["v"], t)


def test_numeric_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    kept = df.where(f.to_column(f.parse("p_size > 7 AND p_retailprice <= 950.5 AND p_size IN [8, 9]"), df.schema)).select("p_partkey")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(p_size,7)" in plan and "LessThanOrEqual(p_retailprice,950.5)" in plan and "In(p_size, [8,9])" in plan


def test_unknown_field(spark):
    with pytest.raises(f.FilterError):
        f.to_column(f.parse("nope == 1"), spark.range(1).schema)


def test_boundary_value():
    a = f.Attribute("w", True, 255, 18.0, 16300.0)
    assert a.bucket(958) == 14 and a.bucket(965) == 14 and a.bucket(18) == 0 and a.bucket(16300) == 254


def test_buckets_lose_no_match():
    rng = random.Random(3)
    for _ in range(300):
        values = [rng.uniform(-50, 50) for _ in range(60)]
        a = f.Attribute("v", True, rng.choice([1, 5, 31]), min(values), max(values))
        x, y = sorted(rng.choice(values) for _ in range(2))
        for t in (f"v > {x!r}", f"v >= {x!r}", f"v < {x!r}", f"v <= {x!r}", f"v == {x!r}", f"v != {x!r}", f"v BETWEEN {x!r} AND {y!r}", f"v IN [{x!r}, {y!r}]", f"v > {x!r} AND v < {y!r}"):
            allowed = f.tree_buckets(f.parse(t), a)
            assert all(a.bucket(v) in allowed for v in values if f.matches(f.parse(t), {"v": repr(v)})), t


def test_category_buckets_are_exact():
    a = f.Attribute("c", False, 255, categories={"10": 0, "10.0": 1, "9": 2, "abc": 3})
    assert f.allowed_buckets(f.parse("c == 10"), a) == {0, 1}
    assert f.allowed_buckets(f.parse("c > 9"), a) == {0, 1, 3}
    assert f.allowed_buckets(f.parse("c == zzz"), a) == set()
    assert f.boundary_buckets(f.parse("c != abc"), a) == {0, 1, 2}


def test_engine_compile_loses_boundary_rows():
    a = f.Attribute("v", True, 10, 0.0, 100.0)
    assert f.boundary_buckets(f.parse("v > 55"), a) == {6, 7, 8, 9} and 5 in f.allowed_buckets(f.parse("v > 55"), a)
    assert f.representative_buckets(f.parse("v >= 55"), a) == {5, 6, 7, 8, 9}
    b = f.Attribute("v", True, 10, 0.0, 100.0, all_numbers=False)
    assert f.allowed_buckets(f.parse("v > 55"), b) == set(range(11))
