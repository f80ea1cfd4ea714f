"""Attribute encoding: columns to small bucket numbers, and the manifest that explains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievector.functions import filters
from sievector.functions.scalars import bucket_numeric
from sievector.plans.staging import stage


def usable_bins(buckets: int) -> int:
    """One bucket is kept for missing values."""
    return max(1, buckets - 1)


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``place`` from 0 in the given order, which has no ties: ranges are numbered side by side and begin where
    the ranges before them end; one count a range reaches the driver."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    begins, held = {}, 0
    for r in sorted(dealt.groupBy("__range").count().collect()):
        begins[r["__range"]], held = held, held + r["count"]
    begin = F.element_at(F.create_map(*[F.lit(x) for pair in begins.items() for x in pair]), F.col("__range")) if begins else F.lit(0)
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("place", begin + within).drop("__range")


def dictionary(rows: DataFrame, column: str, seed: list[str] | None = None) -> DataFrame:
    """(value, bucket) of distinct present values: seeded values first in their order, the rest sorted."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    if not seed:
        return numbered(values, "value").withColumnRenamed("place", "bucket")
    given = F.create_map(*[x for i, v in enumerate(seed) for x in (F.lit(v), F.lit(i))])
    ranked = values.withColumn("__seed", F.coalesce(F.element_at(given, F.col("value")), F.lit(len(seed))))
    return numbered(ranked, "__seed", "value").select("value", F.col("place").alias("bucket"))


def first_come(rows: DataFrame, token: Column, order: str, buckets: int) -> DataFrame:
    """(token, bucket): numbers in order of first appearance; tokens beyond the buckets share them by hash."""
    firsts = rows.select(token.alias("token"), order).groupBy("token").agg(F.min(order).alias("first"))
    return numbered(firsts, "first", "token").select("token", F.when(F.col("place") < buckets, F.col("place")).otherwise(F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")).alias("bucket"))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One scan: (attr, unique_non_missing, missing, min_value, max_value, unparsable) of each column."""
    types = {f.name: f.dataType for f in rows.schema}
    parts = []
    for c in columns:
        x = filters.numeric_value(F.col(c), types[c])
        parts += [F.count_distinct(c), F.count_if(F.col(c).isNull()), F.min(x), F.max(x), F.count_if(F.col(c).isNotNull() & x.isNull())]
    named = rows.agg(*[p.alias(f"a{i}") for i, p in enumerate(parts)])
    names = ("unique_non_missing", "missing", "min_value", "max_value", "unparsable")
    each = [F.struct(F.lit(c).alias("attr"), *[F.col(f"a{5 * i + j}").alias(n) for j, n in enumerate(names)]) for i, c in enumerate(columns)]
    return named.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def manifest(rows: DataFrame, columns: list[str], buckets: int = 256, seeds: dict[str, list[str]] | None = None) -> list[filters.Attribute]:
    """How each column is encoded.  A column with no more distinct values than usable bins is categorical, even
    if they are numbers; others are cut between their least and greatest number."""
    bins, out = usable_bins(buckets), []
    for r in profile(rows, columns).collect():  # one row a column
        c = r["attr"]
        if r["unique_non_missing"] <= bins:
            names = {x["value"]: x["bucket"] for x in dictionary(rows, c, (seeds or {}).get(c)).collect()}  # at most ``bins`` rows
            out.append(filters.Attribute(c, False, bins, categories=names))
        else:
            out.append(filters.Attribute(c, True, bins, r["min_value"], r["max_value"], all_numbers=r["unparsable"] == 0))
    return out


def encode(rows: DataFrame, attributes: list[filters.Attribute], prefix: str = "fid_") -> DataFrame:
    """The rows with a bucket column for each attribute; missing, unknown and unparsable values get the last bucket."""
    types = {f.name: f.dataType for f in rows.schema}
    made = {}
    for a in attributes:
        c = F.col(a.key)
        if a.numeric:
            x = filters.numeric_value(c, types[a.key])
            bucket = F.when(x.isNotNull(), bucket_numeric(x, F.lit(a.min_value), F.lit(a.max_value), a.usable_bins))
        elif a.categories:
            known = F.create_map(*[x for k, v in a.categories.items() for x in (F.lit(k), F.lit(v))])
            bucket = F.element_at(known, c.cast("string"))
        else:
            bucket = F.lit(None).cast("int")
        made[prefix + a.key] = F.coalesce(bucket, F.lit(a.usable_bins)).cast("int")
    return rows.withColumns(made)


def histogram(encoded: DataFrame, column: str) -> DataFrame:
    return encoded.groupBy(F.col(column).alias("bucket")).agg(F.count("*").alias("n"))


def code_255(value: Column, low: Column, high: Column) -> Column:
    """trunc((v - min) * 255 / range) of whole numbers; 0 where the range is empty."""
    return F.coalesce(F.floor(F.try_divide((value - low) * F.lit(255), high - low)), F.lit(0)).cast("int")


def inclusion(unique: Column, whole: Column) -> Column:
    """How a profiled column is coded: by dictionary, by scaling whole numbers, or not at all."""
    return F.when(unique <= 256, F.lit("dictionary")).when(whole, F.lit("scaled")).otherwise(F.lit("excluded"))


def coded(profiled: DataFrame, rows: DataFrame) -> DataFrame:
    """A profile (``profile``) with ``coding``: how each column would be kept in a byte, by ``inclusion``."""
    whole = [f.name for f in rows.schema if isinstance(f.dataType, T.IntegralType)]
    return profiled.withColumn("coding", inclusion(F.col("unique_non_missing"), F.col("attr").isin(whole) if whole else F.lit(False)))


def byte_code(value: Column, low: Column, high: Column) -> Column:
    """Alternative mapping of whole numbers: the offset if the range is below 256, else steps of range / 256."""
    return F.when(high - low < 256, value - low).otherwise(F.least(F.lit(255), F.floor((value - low) / F.ceil((high - low + 1) / F.lit(256))))).cast("int")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the last in ``order``."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those with the same key; rows marked ``deleted`` go."""
    kept = base.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(~F.col("deleted")).drop("deleted"))
