import collections
import re

from sievector.llm import rules


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures(spark, odd, documents, clashing):
    for docs in (odd, clashing, documents):
        got = sorted(repr((r["doc_id"], *(r[n] for n in NAMES))) for r in rules.measure(docs).collect())
        assert got == sorted(repr((r["doc_id"], *measured(r["text"]))) for r in docs.collect())


def test_window_shapes(spark):
    texts = ["a b c d e f g h", "a b c d e f g h a b c d e f g h", "a a a a a a a a a", "a b c d e f g h x a b c d e f g h", " ".join("abcdefgh" * 40), "a b c d e f g h i a b c d e f g h i j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in rules.measure(docs).collect()} == {i: measured(t)[4] for i, t in enumerate(texts)}


def test_verdicts(spark, odd, none, clashing):
    got = rules.judge(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["posterior"] <= 1 for r in got)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert rules.judge(none).count() == 0 and rules.keep(none).count() == 0
    assert rules.keep(clashing).columns == clashing.columns


def test_keep_equals_judge(documents):
    kept = {r["doc_id"] for r in rules.judge(documents).where("kept").collect()}
    rows = rules.keep(documents)
    assert rows.columns == documents.columns and {r["doc_id"] for r in rows.collect()} == kept


def test_fit_finds_planted_accuracies():
    import random

    rng, counts = random.Random(2), collections.Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        votes = []
        for right in (0.9, 0.8, 0.85, 0.75):
            votes.append(0 if rng.random() < 0.3 else (1 if good else -1) if rng.random() < right else (-1 if good else 1))
        counts[tuple(votes)] += 1
    model = rules.fit_votes(sorted(counts.items()), 4)
    assert abs(model.prior - 0.7) < 0.06
    for (_, _, up), right in zip(model.good, (0.9, 0.8, 0.85, 0.75)):
        assert abs(up / 0.7 - right) < 0.06


def test_against_labels(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    judged = rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    good, lost, junk, caught = judged.agg(*[F.count_if(F.expr(x)) for x in ("quality = 1", "quality = 1 and not kept", "quality = 0", "quality = 0 and not kept")]).first()
    assert lost <= 0.01 * good and caught >= 0.9 * junk
