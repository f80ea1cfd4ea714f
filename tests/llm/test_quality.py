import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievector.llm import quality


def test_operator(odd, none, clashing, documents, labels):
    for docs in (odd, clashing, documents):
        rows = quality.classify(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        for r in rows:
            key = b"" if r["doc_id"] is None else str(r["doc_id"]).encode()
            assert r["held_out"] == (zlib.crc32(key) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
    assert quality.classify(none, labels).count() == 0
    assert quality.keep(clashing, labels).columns == clashing.columns
    kept = {r["doc_id"] for r in quality.keep(documents, labels).collect()}
    assert kept == {r["doc_id"] for r in quality.classify(documents, labels).where("predicted = 1").collect()}


def test_without_labels(documents, labels):
    rows = quality.classify(documents, labels.limit(0)).collect()
    assert {r["score"] for r in rows} == {0.5}


def test_labels_do_not_leak(spark, documents, labels):
    """Labels of held-out rows change no score."""
    turned = labels.withColumn("quality", F.when(quality.remainder() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(documents, x).collect()} for x in (labels, turned))
    assert a == b


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), marks).where("held_out").join(marks, "doc_id").collect()
    right = np.mean([r["predicted"] == r["quality"] for r in rows])
    assert right > 0.97


def test_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    good = rng.normal(1, 1, (400, 3))
    web = np.concatenate([rng.normal(1, 1, (600, 3)), rng.normal(-2, 1, (400, 3))])
    net = quality.fit_network(good, web, 0.6, epochs=40, batch=200)
    assert net.score(rng.normal(1, 1, (500, 3))).mean() > 0.75 > 0.3 > net.score(rng.normal(-2, 1, (500, 3))).mean()


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(1)
    good = rng.normal(1.2, 1, (2000, 4))
    web = np.concatenate([rng.normal(1.2, 1, (int(6000 * share), 4)), rng.normal(-1.2, 1, (6000 - int(6000 * share), 4))])
    assert abs(quality.estimate_prior(good, web) - share) < 0.08


def test_odd_labels(spark, documents):
    """Null labels are ignored, and of several the mean counts."""
    ids = [r["doc_id"] for r in documents.select("doc_id").collect()]
    once = [(i, int(i % 3 > 0)) for i in ids]
    often = [(i, q) for i, q in once for _ in range(3)] + [(i, 1 - q) for i, q in once] + [(i, None) for i in ids] + [(None, 1)]
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(documents, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (once, often))
    assert a == b


def test_copies_do_not_fill_the_sample(spark, documents, labels):
    """A third of the rows are copies of one text: as unlabelled rows they stay a third, so other texts keep their verdict."""
    count = documents.count()
    text = documents.join(labels.where("quality = 0"), "doc_id").first()["text"]
    copies = spark.range(1_000_000, 1_000_000 + count // 2).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    alone = {r["doc_id"]: r["predicted"] for r in quality.classify(documents, labels).collect()}
    both = quality.classify(documents.select("doc_id", "text").unionByName(copies), labels).collect()
    assert np.mean([alone[r["doc_id"]] == r["predicted"] for r in both if r["doc_id"] in alone]) > 0.93
    assert not any(r["predicted"] for r in both if r["doc_id"] >= 1_000_000)
