import collections
import random
import re

import numpy as np
import pytest

from sievector.llm import neardup


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """Component of each row number, by comparing all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = collections.Counter((a, b) for v in where.values() for i, b in enumerate(v) for a in v[:i])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def got(found):
    return sorted((repr((r["key"], r["n_shingles"], r["component"])) for r in found.collect()))


def test_components(spark, odd, clashing, documents):
    for docs, k, percent in ((odd, 3, 85), (clashing, 5, 80), (documents, 3, 85), (documents, 5, 80)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert got(neardup.components(docs, k, percent)) == sorted(map(repr, brute(rows, k, percent)))


def test_families(spark, monkeypatch):
    """Near copies around the threshold, with buckets that are split into blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert 1 < len({c for _, _, c in want}) < 110
    assert got(neardup.components(docs, 3, 85, 32, 5)) == sorted(map(repr, want))


def test_empty_table(none):
    assert neardup.components(none).count() == 0 and neardup.keep(none).count() == 0


def test_keep(odd, clashing, documents):
    kept = neardup.keep(odd)
    assert kept.columns == odd.columns
    ids = sorted(repr(r["doc_id"]) for r in kept.collect())
    assert ids.count("None") == 1 and ids.count("8") == 1 and "2" not in ids and "1" in ids and {"3", "4", "5"} <= set(ids)
    assert neardup.keep(clashing).columns == clashing.columns
    found = neardup.components(documents).collect()
    assert neardup.keep(documents).count() == len({r["keeper"] for r in found})


def test_signature_agreement():
    """Coordinates agree as often as sets are alike."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 1 << 63, 60, dtype=np.uint64)])
    s = neardup.signatures([np.unique(a), np.unique(b)], 2000)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.05


@pytest.mark.parametrize("n,links", [(2, 1), (3, 2)])
def test_forest(n, links):
    sets = [np.arange(100, dtype=np.uint64) for _ in range(n)]
    assert len(neardup._forest(np.arange(n), sets, 80, None)) == links
