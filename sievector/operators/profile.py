"""Profiles of columns and JSON, value counts, memory and compression reports."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievector.functions.scalars import share
from sievector.plans.staging import stage


def json_field(text: Column, path: str, kind: str = "string") -> Column:
    """A value of a JSON text by path; null where the text or the path is bad."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def flatten(schema: T.StructType, prefix: str = "", column: str = "") -> list[Column]:
    """Leaf columns of nested structs under dotted names; arrays and maps are leaves as JSON text."""
    out = []
    for f in schema:
        path, name = f"{column}.`{f.name}`" if column else f"`{f.name}`", f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += flatten(f.dataType, name + ".", path)
        else:
            leaf = F.to_json(F.col(path)) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.col(path).cast("string")
            out.append(leaf.alias(name))
    return out


def json_leaves(rows: DataFrame, column: str, key: str, depth: int = 32) -> DataFrame:
    """(key, attr, value) of the leaves of JSON texts: nested objects under dotted names, arrays as JSON text; null
    leaves, broken texts and texts that are no objects give nothing, and what is nested deeper than ``depth`` is kept as text."""
    level = rows.select(F.col(key).alias("key"), F.lit("").alias("attr"), F.try_parse_json(column).alias("v"))
    parts = []
    kind = lambda: F.schema_of_variant("v")
    level = level.where(kind().startswith("OBJECT"))
    for at in range(depth):
        level = stage(level, "json-level")
        if not level.limit(1).count():
            break
        level.createOrReplaceTempView(view := f"json_level_{uuid.uuid4().hex}")
        opened = rows.sparkSession.sql(f"SELECT l.key, concat(l.attr, x.key) AS attr, x.value AS v FROM {view} l, LATERAL variant_explode(l.v) x")
        inside = kind().startswith("OBJECT") if at < depth - 1 else F.lit(False)
        text = F.when(kind().startswith("ARRAY") | kind().startswith("OBJECT"), F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string"))
        parts.append(opened.where(~inside & F.col("v").isNotNull() & ~F.is_variant_null("v")).select("key", "attr", text.alias("value")))
        level = opened.where(inside).select("key", F.concat("attr", F.lit(".")).alias("attr"), "v")
    if not parts:
        return level.select("key", "attr", F.lit("").alias("value"))
    return reduce(DataFrame.unionByName, parts)


def chosen_columns(sizes: DataFrame, budget: int) -> DataFrame:
    """(attr, bytes, kept) of (attr, bytes, is_text): what stays when columns are dropped, texts before numbers and the smallest
    first, until the rest fits the budget.  One row a column."""
    order = Window.orderBy(F.col("is_text").desc(), "bytes", "attr").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("bytes").over(Window.partitionBy()) - F.coalesce(F.sum("bytes").over(order), F.lit(0))
    return sizes.select("attr", "bytes", (left <= budget).alias("kept"))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(attr, value, n) of present values."""
    each = F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]))
    return rows.select(each.alias("attr", "value")).where("value is not null").groupBy("attr", "value").agg(F.count("*").alias("n"))


def json_value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(attr, value, n) over the top-level keys of JSON texts."""
    pairs = rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("attr", "value"))
    return pairs.groupBy("attr", "value").agg(F.count("*").alias("n"))


def column_bytes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(attr, text_bytes, binary_bytes): as text, and as 4-byte numbers where numeric."""
    types = {f.name: f.dataType for f in rows.schema}
    made = rows.agg(*[F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).alias(f"t{i}") for i, c in enumerate(columns)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    each = [F.struct(F.lit(c).alias("attr"), F.col(f"t{i}").alias("text_bytes"), (F.col(f"n{i}") * 4 if isinstance(types[c], T.NumericType) else F.col(f"t{i}")).alias("binary_bytes")) for i, c in enumerate(columns)]
    return made.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def compressed_bytes(rows: DataFrame, column: str, chunk: int) -> DataFrame:
    """(chunks, raw_bytes, deflate_bytes, ratio) of a column's text, in chunks of ``chunk`` bytes a batch."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = "\n".join(b["value"].dropna()).encode()
            parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
            yield pd.DataFrame({"chunks": [len(parts)], "raw": [len(raw)], "packed": [sum(len(zlib.compress(p)) for p in parts)]})

    sizes = rows.select(F.col(column).cast("string").alias("value")).mapInPandas(body, "chunks long, raw long, packed long")
    out = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "raw", "packed")])
    return out.select("chunks", F.col("raw").alias("raw_bytes"), F.col("packed").alias("deflate_bytes"), share(F.col("packed"), F.col("raw")).alias("ratio"))


def graph_bytes(n: Column, m: int) -> Column:
    """Size of a layered proximity graph of n nodes with m links: N(8M+2) + N/(M-1)(4M+2)."""
    return n * F.lit(8 * m + 2) + n / F.lit(m - 1) * F.lit(4 * m + 2)


def zone(wait: Column, dist: Column, lz4: Column) -> Column:
    """Where a wait falls: hidden by distance work, by distance and decompression, or exposed."""
    return F.when(wait <= dist, F.lit("hidden")).when(wait <= dist + lz4, F.lit("partly")).otherwise(F.lit("exposed"))


def condition(text: Column, rule: str) -> Column:
    """A test of a JSON text: ``KEY=VALUE`` with a value of its JSON type.  Keys may be dotted; the value may hold any sign."""
    key, _, value = rule.partition("=")
    path = "$." + key
    try:
        typed = json.loads(value)
    except ValueError:
        typed = value
    if isinstance(typed, bool):
        return json_field(text, path, "boolean") == typed
    return json_field(text, path, "double") == float(typed) if isinstance(typed, int | float) else json_field(text, path) == str(typed)


def range_condition(text: Column, rule: str) -> Column:
    """``KEY=MIN:MAX`` on numbers, both ends in it and either left open; an end that is no number is an error."""
    key, _, value = rule.partition("=")
    low, colon, high = value.partition(":")
    if not colon:
        raise ValueError(f"{rule!r} is no range")
    x = json_field(text, "$." + key, "double")
    test = x.isNotNull()
    test = test & (x >= float(low)) if low else test
    return test & (x <= float(high)) if high else test


def parse_profile(lines: DataFrame) -> DataFrame:
    """(attr, unique_count) of a printed profile whose lines read ``field: NAME unique: COUNT``."""
    pattern = r"field:\s*(\S+)\s+unique:\s*(\d+)"
    kept = lines.where(F.col("value").rlike(pattern))
    return kept.select(F.regexp_extract("value", pattern, 1).alias("attr"), F.regexp_extract("value", pattern, 2).cast("long").alias("unique_count"))


def synthetic(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(id, number, country, symbol): even numbers 0..255, country names, and symbols 1..16 with Zipf weights."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    names = F.array(*[F.lit(x) for x in ("Brazil", "Chile", "France", "India", "Japan", "Kenya", "Norway", "Spain")])
    total, edges, held = sum(1 / i for i in range(1, 17)), [], 0.0
    for i in range(1, 17):
        held += 1 / i / total
        edges.append(held)
    symbol = F.lit(16)
    for i in range(15, 0, -1):
        symbol = F.when(draw(3) < edges[i - 1], F.lit(i)).otherwise(symbol)
    return spark.range(n).select("id", F.floor(draw(1) * 256).cast("int").alias("number"), F.get(names, F.floor(draw(2) * 8).cast("int")).alias("country"), symbol.alias("symbol"))
