"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievector.llm import base_sql, encoding, fingerprints, licenses, neardup, packing, quality, rules, scoring, training_order, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Vocabulary files come with the public_tokenizers package of every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(documents(spark, sf_dir))
    votes = [c for c in out.columns if c.startswith("v_")]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", *votes)


@query
def op1_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoding.encode(documents(spark, sf_dir), vocabulary_path())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path())


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform("base", lambda s: s["first"])
    return (
        licenses.scan(documents(spark, sf_dir))
        .withColumn("base", base)
        .select(
            "doc_id",
            "n_words",
            F.size("base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            labels(F.col("base")).alias("base_labels"),
            labels(F.col("spans")).alias("labels"),
            F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        )
    )


@query
def op8_cws_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.classify(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


@query
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(documents(spark, sf_dir), width=3, percent=85, bands=32, rows=5)
    kept = F.coalesce(F.col("key") == F.col("component"), F.col("rid") == F.col("keeper"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


@query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10))
    out = scoring.score(documents(spark, sf_dir), vocabulary_path(), remainder != 0)
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.derivatives(pages).select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "n_links", F.length("block").cast("long").alias("n_chars"), "warc_headers", F.col("block").alias("text"))


@query
def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training_order.materialise(documents(spark, sf_dir), vocabulary_path())
    return out.select("doc_id", "part", F.col("n").alias("n_tokens"), "slot", "shard", "offset", "ids_crc32")


# The columns that the contracts of other operators fix, which SQL can express; the operators themselves run for them.


def _fixed(name: str, of: Callable[[SparkSession, str], DataFrame], columns: list[str], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: of(spark, sf_dir).selectExpr(*columns)
    ORACLE_SQL[name] = sql


ORACLE_SQL["op7_minhash_dedup"] = base_sql.NEAR
_fixed("lm_base_columns", op3_lm_score, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 6) AS base_score"], base_sql.LM)
_fixed("license_base_columns", op4_license_scan, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], base_sql.LICENCES)
_fixed("rules_base_columns", op5_quality_rules, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], base_sql.RULES)
_fixed("fingerprint_base_columns", op8_cws_fingerprint, ["doc_id", "n_chars", "edited_sha256"], base_sql.EDITED)
