"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the
shared folder and gives the rows read back to the next stage.  All but the last keep the columns of
``documents``.  Rows are judged one by one, so repeated or null ids neither multiply nor vanish in joins.

Defined cases: a null or empty text has no words, so the rules drop it; very long texts go through whole; an empty table gives
an empty result of the same columns; extra columns come along through all filters, whatever their names, and the last stage
returns its own columns only; without labels no classifier can be fitted, every score is 0.5, and no document is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievector.llm import neardup, packing, quality, rules
from sievector.llm.queries import vocabulary_path
from sievector.plans.staging import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep(docs, labels)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and whose votes make them likely good."""
    return rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles."""
    return neardup.keep(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return packing.pack(docs, vocabulary_path())


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", pack)]

#: The classifier, the vote model and the packing are iterative; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
