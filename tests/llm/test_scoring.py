import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievector.llm import attention, scoring
from sievector.llm.queries import op3_lm_score
from sievector.llm.subwords import Vocabulary
from sievector.llm.words import Coder
from sievector.llm.words import words as word_batch

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = {"size": 256, "n_classes": 16, "broadcast_words": 50, "least_windows": 300, "first_windows": 200}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def base_scores(rows):
    tokens = [words(t) + [None] for _, t, _ in rows]
    counts = collections.Counter(w for (_, _, training), ws in zip(rows, tokens) if training for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(k, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (k, _, _), ws in zip(rows, tokens)]


def same(found, rows):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found), key=repr)
    assert got == sorted(((*x[:4], round(x[4], 6)) for x in base_scores(rows)), key=repr)


def test_base_score(odd, none, clashing, documents):
    rule = F.coalesce(F.pmod(F.col("doc_id"), F.lit(3)) != 0, F.lit(False))
    for docs in (odd, clashing, documents):
        found = scoring.score(docs, PATH, rule, **SMALL).collect()
        same(found, [(r["doc_id"], r["text"], r["doc_id"] is not None and r["doc_id"] % 3 != 0) for r in docs.collect()])
        assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in found)
    assert scoring.score(none, PATH, rule, **SMALL).count() == 0


def test_sums_by_a_tree(documents, monkeypatch):
    """Weights added up over several levels are those added up at once."""
    docs, rule = documents.repartition(7, "doc_id"), F.col("doc_id") % 3 != 0
    monkeypatch.setattr(scoring, "stage", lambda df, tag, f=scoring.stage: f(df.repartition(7, *df.columns) if tag == "gathered" else df, tag))
    docs.sparkSession.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        flat = {r["doc_id"]: r["score"] for r in scoring.score(docs, PATH, rule, **SMALL).collect()}
        monkeypatch.setattr(scoring, "FAN", 2)
        tree = {r["doc_id"]: r["score"] for r in scoring.score(docs, PATH, rule, **SMALL).collect()}
    finally:
        docs.sparkSession.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(abs(flat[k] - tree[k]) < 1e-3 * abs(flat[k]) for k in flat)


def test_nothing_to_learn_from(odd):
    found = scoring.score(odd, PATH, F.lit(False), **SMALL).collect()
    same(found, [(r["doc_id"], r["text"], False) for r in odd.collect()])


def test_query(spark):
    found = op3_lm_score(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    # texts that it hasn't learned from: better than the frequencies of words, although it spells them
    assert sum(r["score"] for r in held) > 0.98 * sum(r["base_score"] for r in held)


def test_words_and_ids(odd):
    """Words of a batch, and their ids, are those that each word has by itself."""
    texts = [*(r["text"] for r in odd.collect()), "A\x0bB\x0cC\x1cD\x85E\u00a0F  g", " ", "\u2003x \u0130 \x00 <|endoftext|>"]
    vocabulary = Vocabulary.load(PATH)
    library = Tokenizer.from_file(PATH)
    coder = Coder(vocabulary.tokens, vocabulary.special)
    found = word_batch(pa.array(texts, pa.string()))
    own = found.spelled()
    for i, t in enumerate(texts):
        assert [own[c] for c in found.code[found.of == i]] == words(t)
    ids, sizes = coder.ids(found)
    assert sizes.sum() == len(ids) and len(sizes) == len(texts)
    for part, t in zip(np.split(ids, np.cumsum(sizes)[:-1]), texts):
        alone = [coder.ids(word_batch(pa.array([w])))[0].tolist() for w in words(t)]
        assert part.tolist() == [i for w in alone for i in w]
    for w in ("plain", "wordless", "x" * 300, "naïve"):
        assert coder.ids(word_batch(pa.array([w])))[0].tolist() == library.encode(" " + w, add_special_tokens=False).ids
    assert len(coder.ids(word_batch(pa.array([], pa.string())))[0]) == 0


IDS, END, FILLER = 13, 12, 13


def model(seed=0, classes=4, spread=0.5):
    rng = np.random.default_rng(seed)
    m = attention.Model(attention.Counts.from_pairs(rng.integers(0, 50, (IDS, IDS)).astype(float), classes))
    if spread:
        m.weights = {k: rng.normal(0, spread, w.shape).astype(np.float32) for k, w in m.weights.items()}
    return m


def cut(texts):
    """Windows of texts, each with its end."""
    sizes = np.array([len(t) + 1 for t in texts])
    return attention.windows(np.concatenate([np.append(t, END) for t in texts]).astype(np.int32), sizes, END, FILLER)


def by_hand(m, ids):
    """Log probabilities of a text's ids and its end, one place after another, with plain loops."""
    w, before, span, power = {k: x.astype(float) for k, x in m.weights.items()}, attention.BEFORE, attention.SPAN, attention.POWER
    f = lambda x: min(max(1 + x / power, attention.LEAST), attention.MOST) ** power
    line, out = [FILLER] * before + [END, *ids, END], []
    for goal in range(before + 1, len(line)):
        at = goal - 1  # the query
        start = (goal - before - 1) // span * span  # of the goal's window
        weights, values = [], []
        for j in range(start + 1, at + 1):
            if line[j] != FILLER:
                k = w["key"][line[j]] + w["key_before"][line[j - 1]]
                weights.append(f(w["query"][line[at]] @ k / math.sqrt(attention.WIDTH) + w["near"][at - j]))
                values.append(w["value"][line[j]])
        h = sum(a * v for a, v in zip(weights, values)) / sum(weights)
        u = np.maximum(0, w["last"][line[at]] + w["last_but_one"][line[at - 1]])
        z = np.concatenate([h, u]) @ w["out"]
        p = [min(max(float(m.root[line[at], c]) + z[c] / power, attention.LEAST), attention.MOST) ** power for c in range(len(z))]
        aim = m.classes[line[goal]]
        out.append(math.log(p[aim] / sum(p)) + m.log_id[line[at], line[goal]])
    return np.array(out)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 31, 32, 33, 100])
def test_attention_by_hand(n):
    m = model(1)
    ids = np.random.default_rng(n).integers(0, END, n)
    found = m.log_probabilities(cut([ids])[0]).ravel()
    assert np.allclose(found[: n + 1], by_hand(m, ids.tolist()), atol=1e-3) and (found[n + 1 :] == 0).all()


def test_untrained_is_the_counts():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 50, (IDS, IDS)).astype(float)
    m = attention.Model(attention.Counts.from_pairs(pairs, 4))
    overall = (pairs.sum(0) + 0.5) / (pairs.sum(0) + 0.5).sum()
    p = (pairs + 8 * overall) / (pairs.sum(1, keepdims=True) + 8)
    ids = rng.integers(0, END, 40)
    line = [END, *ids, END]
    assert np.allclose(m.log_probabilities(cut([ids])[0]).ravel()[:41], [np.log(p[a, b]) for a, b in zip(line, line[1:])], atol=1e-3)


def test_probabilities_sum_to_one():
    """Over all next ids, after any context."""
    m = model(2)
    context = np.random.default_rng(2).integers(0, END, 40)
    for n in (0, 1, 17, 31, 32, 39):
        last = [m.log_probabilities(cut([np.append(context[:n], x)])[0]).ravel()[n] for x in range(END)]
        stop = m.log_probabilities(cut([context[:n]])[0]).ravel()[n]
        assert abs(np.exp(last).sum() + np.exp(stop) - 1) < 1e-3


def test_causal_and_scored_once():
    m = model(3)
    ids = np.random.default_rng(3).integers(0, END, 100)
    a = m.log_probabilities(cut([ids])[0]).ravel()
    assert (a[:101] < 0).all() and (a[101:] == 0).all()
    other = ids.copy()
    other[60:] = (other[60:] + 1) % END
    b = m.log_probabilities(cut([other])[0]).ravel()
    assert np.allclose(a[:60], b[:60]) and not np.allclose(a[60:100], b[60:100])


def test_batches_do_not_mix():
    m = model(4)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, END, n) for n in (1, 33, 5, 64, 0, 7)]
    rows, text, _ = cut(texts)
    whole = np.bincount(text, m.log_probabilities(rows).sum(1), len(texts))
    for i, t in enumerate(texts):
        assert abs(whole[i] - m.log_probabilities(cut([t])[0]).sum()) < 1e-3


def test_gradients():
    """Against differences of the loss."""
    m = model(5, spread=0.3)
    m.weights = {k: w.astype(np.float64) for k, w in m.weights.items()}
    rng = np.random.default_rng(6)
    rows = cut([rng.integers(0, END, n) for n in (40, 3, 70)])[0]
    real = (rows[:, attention.BEFORE + 1 :] != FILLER).sum()
    loss = lambda: -m.log_probabilities(rows).sum(dtype=np.float64) / real
    whole, by_id = m.gradients(rows)
    for name, where, grad in by_id:
        whole[name] = np.zeros(m.weights[name].shape)
        np.add.at(whole[name], where.ravel(), grad.reshape(-1, whole[name].shape[1]))
    for name, g in whole.items():
        for at in rng.integers(0, g.size, 6):
            w = m.weights[name].reshape(-1)
            kept, step = w[at], 0.02
            w[at] = kept + step
            up = loss()
            w[at] = kept - step
            down = loss()
            w[at] = kept
            assert abs((up - down) / (2 * step) - g.reshape(-1)[at]) < 0.004, name


def test_training_learns_what_counts_cannot():
    """Texts that repeat three ids: the head sees far more than the last id tells."""
    rng = np.random.default_rng(5)
    texts = [np.tile(rng.permutation(END)[:3], 12) for _ in range(120)]
    m = attention.Model(attention.Counts.from_pairs(50 + rng.integers(0, 20, (IDS, IDS)).astype(float), IDS))
    rows, some = cut(texts)[0], cut(texts[:20])[0]
    before = m.log_probabilities(some).sum()
    m.train(rows, epochs=30)
    assert m.log_probabilities(some).sum() > 0.7 * before


def test_weights_in_a_line():
    a, b = model(8), model(9)
    b.unflat(a.flat())
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights)


def test_windows_drawn():
    """The share that is asked for, whatever the keys; copies under different keys are drawn apart."""
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 400)
    draw = scoring._draw(scoring._draw(keys, np.zeros(400, np.int64)).repeat(50), np.tile(np.arange(50), 400))
    assert (draw >= 0).all() and (draw < 1 << 32).all() and abs((draw < 1 << 28).mean() - 1 / 16) < 0.01
    assert len(np.unique(draw)) > 19990


def test_no_switch_by_size(odd):
    """A corpus above and one below what was a bound learn alike."""
    docs, rule = odd, F.lit(True)
    got = [sorted((r["doc_id"] or "", r["score"]) for r in scoring.score(docs, PATH, rule, **SMALL | {"least_windows": least}).select(F.col("doc_id").cast("string"), "score").collect()) for least in (1, 10**9)]
    assert got[0] == got[1]


def grouped(seed, spread=0.4):
    """A model of 13 ids in six classes, which stand in two groups, with any weights."""
    rng = np.random.default_rng(seed)
    m = attention.Model(attention.Counts.from_pairs(rng.integers(0, 50, (IDS, IDS)).astype(float), 6, groups=2))
    m.weights = {k: rng.normal(0, spread, w.shape).astype(np.float32) for k, w in m.weights.items()}
    return m


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 100])
def test_groups_by_hand(n):
    """Of two levels of output: the group's probability, by plain loops, times the class's by a model of this group alone."""
    m, flat = grouped(1), grouped(1)
    ids = np.random.default_rng(n).integers(0, END, n)
    # a model of one level whose classes are all six, with the arguments of the power that the group of the goal has
    line, power, want = [END, *ids.tolist(), END], attention.POWER, np.zeros(n + 1)
    held = {}
    rows = cut([ids])[0]
    flat._forward(rows, held)
    for i, h in enumerate(held["h"][: n + 1].astype(float)):
        last, goal = line[i], line[i + 1]
        aim = m.classes[goal]
        of_group = [min(max(float(m.root_group[last, g]) + float(h @ m.weights["out_group"][:, g]) / power, attention.LEAST), attention.MOST) ** power for g in range(2)]
        group = aim // 3
        of_class = [min(max(float(m.root[last, c]) + float(h @ m.weights["out"][:, c]) / power, attention.LEAST), attention.MOST) ** power for c in range(3 * group, 3 * group + 3)]
        want[i] = math.log(of_group[group] / sum(of_group)) + math.log(of_class[aim - 3 * group] / sum(of_class)) + m.log_id[last, goal]
    assert np.allclose(m.log_probabilities(rows).ravel()[: n + 1], want, atol=1e-3)


def test_groups_sum_to_one():
    m = grouped(2)
    context = np.random.default_rng(2).integers(0, END, 40)
    for n in (0, 17, 32):
        last = [m.log_probabilities(cut([np.append(context[:n], x)])[0]).ravel()[n] for x in range(END)]
        assert abs(np.exp(last).sum() + np.exp(m.log_probabilities(cut([context[:n]])[0]).ravel()[n]) - 1) < 1e-3


def test_groups_untrained_is_the_counts():
    pairs = np.random.default_rng(0).integers(0, 50, (IDS, IDS)).astype(float)
    flat, two = (attention.Model(attention.Counts.from_pairs(pairs, 6, groups=g)) for g in (1, 2))
    rows = cut([np.random.default_rng(1).integers(0, END, 40)])[0]
    assert np.allclose(flat.log_probabilities(rows), two.log_probabilities(rows), atol=1e-3)


def test_gradients_of_groups():
    """Against differences of the loss."""
    m = grouped(5, 0.3)
    m.weights = {k: w.astype(np.float64) for k, w in m.weights.items()}
    rng = np.random.default_rng(6)
    rows = cut([rng.integers(0, END, n) for n in (40, 3, 70)])[0]
    real = (rows[:, attention.BEFORE + 1 :] != FILLER).sum()
    whole, by_id = m.gradients(rows)
    for name, where, grad in by_id:
        whole[name] = np.zeros(m.weights[name].shape)
        np.add.at(whole[name], where.ravel(), grad.reshape(-1, whole[name].shape[1]))
    assert set(whole) == set(m.weights)
    for name, g in whole.items():
        w = m.weights[name].reshape(-1)
        for at in rng.integers(0, g.size, 6):
            kept, losses = w[at], []
            for step in (0.02, -0.02):
                w[at] = kept + step
                losses.append(-m.log_probabilities(rows).sum(dtype=np.float64) / real)
            w[at] = kept
            assert abs((losses[0] - losses[1]) / 0.04 - g.reshape(-1)[at]) < 0.004, name


def test_every_window_is_stored(documents):
    """Rows hold several windows each; together they are all windows of the training texts."""
    spark, vocabulary = documents.sparkSession, Vocabulary.load(PATH)
    end, some = len(vocabulary.tokens), documents.select("text", F.col("doc_id").alias("key")).limit(60)
    raw = scoring.gather(some, PATH, spark.sparkContext.broadcast((vocabulary.tokens, vocabulary.special)), end, 1.0, 0.0)
    stored = [bytes(r["window"]) for r in raw.where("window is not null AND draw is null").select("window").collect()]
    coder, want = Coder(vocabulary.tokens, vocabulary.special), collections.Counter()
    for r in some.collect():
        ids, sizes = scoring._ended(*coder.ids(word_batch(pa.array([r["text"]], pa.string()))), end)
        want.update(x.tobytes() for x in attention.windows(ids, sizes, end, end + 1)[0].astype("<u2"))
    size = 2 * (attention.BEFORE + attention.SPAN + 1)
    assert collections.Counter(x[at : at + size] for x in stored for at in range(0, len(x), size)) == want
    assert len(stored) < want.total() / 4
