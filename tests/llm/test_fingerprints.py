import collections
import hashlib
import re

from sievector.llm import fingerprints
from pyspark.sql import functions as F


def terms(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return collections.Counter(zip(w, [*w[1:], None]))


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_weights(spark, odd):
    got = odd.select("text", fingerprints.weighted_terms(F.coalesce("text", F.lit(""))).alias("t")).collect()
    for r in got:
        assert sorted(x["weight"] for x in r["t"] or []) == sorted(terms(r["text"]).values())


def test_collision_rate(documents):
    rows = documents.orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(documents).collect()}
    errors, far = [], []
    for i, r in enumerate(rows):
        n, after = len(r["text"]), rows[(i + 1) % len(rows)]["text"]
        edited = r["text"][: n - n // 4] + after[: n // 4]
        own = got[r["doc_id"]]
        assert own["n_chars"] == n and own["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(own["near_edited"] - jaccard(terms(r["text"]), terms(edited)))
        far.append(own["near_next"] - jaccard(terms(r["text"]), terms(after)))
    assert abs(sum(errors) / len(errors)) < 0.03 and abs(sum(far) / len(far)) < 0.02
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.12


def test_equal_texts(odd, clashing):
    for docs in (odd, clashing):
        rows = fingerprints.fingerprint(docs).collect()
        assert len(rows) == docs.count()
        by = {repr(r["doc_id"]): r["fingerprint"] for r in rows}
        assert by["1"] == by["2"] != by["6"] and by["3"] == by["4"] == by["5"]
        assert {r["near_next"] for r in rows if r["doc_id"] in (1, 3, 4)} == {1.0}


def test_small_tables(spark, none):
    assert fingerprints.fingerprint(none).count() == 0
    (one,) = fingerprints.fingerprint(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b c d e f " + b"a b").hexdigest()
