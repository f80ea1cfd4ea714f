"""Metadata tables from CSV and JSON lines, with the counters of what was read and left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievector.operators.encode import last_wins
from sievector.plans.staging import stage


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of a text file, numbered from 0 in file order.

    Lines are numbered within their read partition, and each partition starts where the lines of those
    before it end; one count a partition reaches the driver.
    """
    lines = stage(spark.read.text(path).withColumn("__at", F.monotonically_increasing_id()), "lines")
    part = F.shiftright("__at", 33)
    counts = {r[0]: r[1] for r in lines.groupBy(part.alias("p")).count().collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    first = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "p long, first long"))
    return lines.join(first, part == F.col("p")).select((F.col("first") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("line"), "value")


def json_text(text: Column, name: str, six_digits: bool = False) -> Column:
    """A scalar of a JSON text as text; null and absent give null, arrays and objects their JSON.

    ``six_digits`` prints fractions as %.6f, as readers that keep only texts do.
    """
    path = f"$.{name}" if name.isidentifier() else f"$['{name}']"
    value = F.try_variant_get(F.try_parse_json(text), path, "string")
    if not six_digits:
        return value
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    return F.when(kind.rlike("^(DECIMAL\\(\\d+,[1-9]\\d*\\)|DOUBLE|FLOAT)"), F.format_string("%.6f", value.try_cast("double"))).otherwise(value)


def read_jsonl(spark: SparkSession, path: str, fields: list[str], num_labels: int, six_digits: bool = False, exactly: bool = False) -> tuple[DataFrame, DataFrame]:
    """Row i of the file is label i: (label, fields...) and counters (total, populated, invalid).

    Blank, broken and non-object lines are invalid but use their label up; lines past ``num_labels`` are not read.
    With ``exactly``, a file of fewer lines is an error.
    """
    lines = numbered_lines(spark, path).where(F.col("line") < num_labels)
    if exactly and (there := lines.count()) < num_labels:
        raise ValueError(f"{path} has {there} lines, not {num_labels}")
    valid = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    rows = lines.select(F.col("line").alias("label"), valid.alias("valid"), *[F.when(valid, json_text(F.col("value"), f, six_digits)).alias(f) for f in fields])
    present = F.lit(False)
    for f in fields:
        present = present | F.col(f"`{f}`").isNotNull()
    counters = rows.agg(F.count("*").alias("total"), F.count_if(present).alias("populated"), F.count_if(~F.coalesce("valid", F.lit(False))).alias("invalid"))
    return rows.where("valid").drop("valid"), counters


def read_csv(spark: SparkSession, path: str, fields: list[str], id_column: str, num_labels: int) -> tuple[DataFrame, DataFrame]:
    """(label, fields...) of a CSV with a header, and counters (total, kept, invalid, dropped).

    Names and values are trimmed, a byte-order mark is skipped, only asked-for fields are kept (an error if
    none exists); an id that is no number is invalid, one of ``num_labels`` or more is dropped, and of rows
    with one id the later wins.  An empty value is present, and so is one that a short row lacks.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False, emptyValue="", nullValue="\x00", encoding="UTF-8")
    names = {c: c.lstrip("﻿").strip() for c in raw.columns}
    raw = raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in names.items()])
    kept = [f for f in fields if f in raw.columns]
    if id_column not in raw.columns or not kept:
        raise ValueError(f"{path} has no column {id_column!r} or none of {fields}")
    rows = raw.withColumn("line", F.monotonically_increasing_id()).withColumn("label", F.when(F.col(id_column).rlike(r"^\d+$"), F.col(id_column).try_cast("bigint")))
    counters = rows.agg(F.count("*").alias("total"), F.count_if(F.col("label") < num_labels).alias("kept"), F.count_if(F.col("label").isNull()).alias("invalid"), F.count_if(F.col("label") >= num_labels).alias("dropped"))
    good = rows.where(F.col("label") < num_labels)
    return last_wins(good.select("label", "line", *kept), "label", "line").drop("line"), counters


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array, a single object, or JSON lines."""
    head = spark.read.text(path, wholetext=False).where(F.trim("value") != "").limit(1).collect()
    lone = bool(head) and not head[0][0].strip().endswith("}")
    return spark.read.json(path, multiLine=lone or (bool(head) and head[0][0].strip().startswith("[")))


def category_order(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Order of categories by attribute, from a JSON list of {name, values}; a small file."""
    return {r["name"]: [str(v) for v in r["values"]] for r in spark.read.json(path, multiLine=True).collect()}


def csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a CSV whose records may span lines."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).select(column)


def extra_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(entry, neighbours) of lines ``entry id id ...``."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).cast("bigint").alias("entry"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("bigint")).alias("neighbours"))


def save_table(rows: DataFrame, name: str, key: str, buckets: int = 0) -> None:
    """Save as a table with statistics; ``buckets`` co-locates later joins on the key."""
    writer = rows.write.mode("overwrite")
    (writer.bucketBy(buckets, key).sortBy(key) if buckets else writer).saveAsTable(name)
    rows.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
