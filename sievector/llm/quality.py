"""Quality classifier from positive and unlabelled texts.

A small network reads statistics of the text and minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss: trusted positives are rows
labelled good, the unlabelled are all texts as they come.  The class prior is estimated from those two alone: where a first
classifier ranks texts above a bar, the share of the unlabelled over the share of the positives there bounds it.

The bounds on what the driver holds are ``max_positive`` labelled rows and ``max_unlabelled`` rows to begin with, both chosen by a
hash of key and statistics; then all tasks go on side by side over all training rows as the unlabelled, and their
weights are averaged.  Every row is scored.

Defined cases: a null or empty text has the statistics of no words and gets a score like any other; a very long text is read
whole; labels that are null are ignored, rows labelled more than once take their mean; without positives every
score is 0.5; repeated rows score alike; labels, lang, source and doc_id never reach the network.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievector.llm.batches import arrow_map, pieces, texts_of
from sievector.plans.staging import stage

_CLASS = np.full(256, 7)
for _name, _bytes in enumerate([range(97, 123), range(65, 91), range(48, 58), b" \t\r\v\f", b"\n", b".,;:'?()-\"", b"#*$%&|<>!", range(128, 256)]):
    _CLASS[[*_bytes]] = _name
#: Byte classes: small, capital, digit, blank, line end, prose mark, symbol, beyond ASCII; other control bytes count with symbols.
_CLASS[[b for b in range(32) if b not in b"\t\n\r\v\f"] + [127]] = 6
_CLASS[[c for c in b"+/=@[]^_`{}~\\"]] = 5
STATISTICS = 20


def statistics(text: str) -> list[float]:
    """Shares and logarithms that do not depend on the language's vocabulary."""
    raw = text.encode("utf-8", "surrogatepass")
    by = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=8)
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    solid = max(1.0, size - by[3] - by[4])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    runs = set(zip(words, words[1:], words[2:], words[3:]))
    marked = sum(w[-1:] in b"!*#$%&|" for w in words)
    return [
        *(by[[0, 1, 2, 5, 6, 7]] / solid),
        by[3] / size,
        float(np.log1p(len(words))),
        solid / n / 10,
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(runs) / max(1, len(words) - 3) if len(words) > 3 else 0.0,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        float(np.log1p(len(lines))) / 5,
        marked / n,
        sum(w[:1].isupper() for w in words) / n,
        raw.count(b".") / n,
        raw.count(b"|") / n,
        sum(len(w) == 1 for w in words) / n,
        float(len(words) < 20),
    ]


@dataclass
class Network:
    """One hidden layer; ``score`` is the probability of a good text."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(x) @ self.w2 + self.b2, -30, 30)))


class Learner:
    """Adam on the risk of a network.

    With a prior: the non-negative risk.  Where the negative part of a batch falls below zero, its gradient is turned
    round, which takes the fit back towards a risk that an unbiased estimate allows.  Without: unlabelled against positive.
    """

    def __init__(self, net: Network, prior: float | None):
        self.net, self.prior, self.steps = net, prior, 0
        self.state = [np.zeros_like(x) for x in self.weights()]
        self.speed = [np.zeros_like(x) for x in self.weights()]

    def weights(self) -> list[np.ndarray]:
        return [self.net.w1, self.net.b1, self.net.w2, np.array([self.net.b2])]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.net.mean) / self.net.scale, -8, 8)

    def step(self, good: np.ndarray, part: np.ndarray, rate: float) -> None:
        """One step on scaled statistics of positives and of unlabelled rows."""
        net, prior = self.net, self.prior
        x = np.concatenate([good, part])
        h = np.tanh(x @ net.w1 + net.b1)
        s = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30)))
        sp, su = s[: len(good)], s[len(good) :]
        if prior is None:
            g = np.concatenate([(sp - 1) / len(good), su / len(part)])
        else:
            negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
            sign = 1.0 if negative >= 0 else -1.0
            up = sign * -prior * sp / len(good) + (prior * (sp - 1) / len(good) if sign > 0 else 0)
            g = np.concatenate([up, sign * su / len(part)])
        back = np.outer(g, net.w2) * (1 - h * h)
        self.steps += 1
        new = []
        for i, (w, grad) in enumerate(zip(self.weights(), [x.T @ back + 1e-4 * net.w1, back.sum(0), h.T @ g + 1e-4 * net.w2, np.array([g.sum()])])):
            self.state[i] = 0.9 * self.state[i] + 0.1 * grad
            self.speed[i] = 0.999 * self.speed[i] + 0.001 * grad * grad
            new.append(w - rate * (self.state[i] / (1 - 0.9**self.steps)) / (np.sqrt(self.speed[i] / (1 - 0.999**self.steps)) + 1e-8))
        net.w1, net.b1, net.w2, net.b2 = new[0], new[1], new[2], float(new[3][0])


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 16, epochs: int = 60, batch: int = 1024, rate: float = 0.01, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    start = 0.0 if prior is None else float(np.log(prior / (1 - prior)))
    learner = Learner(Network(mean, scale, rng.normal(0, 1 / np.sqrt(positive.shape[1]), (positive.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), start), prior)
    p, u = learner.scaled(positive), learner.scaled(unlabelled)
    for epoch in range(epochs):
        order = rng.permutation(len(u))
        for at in range(0, len(u), batch):
            learner.step(p[rng.integers(0, len(p), min(batch, len(p)))], u[order[at : at + batch]], rate * (1 - epoch / epochs))
    return learner.net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3, trust: float = 0.1) -> float:
    """Share of good rows among the unlabelled, from positives and unlabelled alone.

    A network is fitted to tell the halves of both apart.  Over the other halves, every bar gives
    (share of unlabelled above it) / (share of positives above it), which is the prior plus the negatives above the bar;
    the estimate is the ratio at the bar where ratio and sampling error together are least.
    """
    rng = np.random.default_rng(seed)
    positive, unlabelled = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    np_, nu = max(1, len(positive) // 2), max(1, len(unlabelled) // 2)
    net = fit_network(positive[:np_], unlabelled[:nu], None, epochs=20)
    p, u = np.sort(net.score(positive[-np_:])), np.sort(net.score(unlabelled[-nu:]))
    bars = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, bars) / len(p), 1 - np.searchsorted(u, bars) / len(u)
    error = np.sqrt(np.log(4 / trust) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    ratio = above_u / above_p
    return float(np.clip(ratio[np.argmin(ratio + error / above_p)], 0.02, 0.98))


def remainder() -> Column:
    """crc32 of the key's text, modulo four; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (the carried columns) and ``x`` (statistics of ``text``), staged: texts are read once."""
    shape = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = [statistics(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["row", "x"])

    kind = shape.schema["row"].dataType.simpleString()
    return stage(arrow_map(shape, body, f"row {kind}, x array<double>"), "statistics")


def fit(seen: DataFrame, labels: DataFrame, max_positive: int = 8000, max_unlabelled: int = 24000) -> tuple[Network | None, float]:
    """The network and the class prior, from rows whose remainder is not 2."""
    ids = seen.select(F.col("row.doc_id").alias("doc_id"), "x").where(remainder() != 2)
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good")).where(remainder() != 2).where("good")
    good, rows = marks.count(), seen.count()

    def chosen(df: DataFrame, size: int, of: int) -> DataFrame:
        """The ``size`` rows of least hash; the key is in it, so copies of a text don't stand together.  A cut at twice
        the share that is needed leaves so few rows that tasks don't each send ``size`` of them to the driver."""
        place = F.xxhash64(F.col("x"), F.col("doc_id"), F.lit(11))
        if of > 4 * size:
            df = df.where(F.pmod(place, F.lit(1 << 30)) < max(1, 2 * size * (1 << 30) // of))
        return df.orderBy(F.pmod(place, F.lit(1 << 30)), place, "doc_id").limit(size)

    trusted = chosen(ids.join(marks.select("doc_id"), "doc_id"), max_positive, good)
    web = chosen(ids, max_unlabelled, rows)
    p, u = (np.array([r["x"] for r in d.select("x").collect()], np.float64).reshape(-1, STATISTICS) for d in (trusted, web))
    if not len(p) or not len(u):
        return None, 0.5
    prior = estimate_prior(p, u)
    return refined(ids, fit_network(p, u, prior), p, prior), prior


def refined(ids: DataFrame, net: Network, positive: np.ndarray, prior: float, batch: int = 1024, rate: float = 0.001) -> Network:
    """The network after all tasks have gone on over all rows as the unlabelled, averaged by how many each had; a row of
    some hundred numbers a task is summed in the cluster."""
    shared = ids.sparkSession.sparkContext.broadcast((net, positive))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, positive = shared.value
        learner, rng, seen = Learner(Network(net.mean, net.scale, net.w1, net.b1, net.w2, net.b2), prior), np.random.default_rng(5), 0
        p = learner.scaled(positive)
        for b in batches:
            x = learner.scaled(np.asarray(b.column(0).flatten(), np.float64).reshape(-1, STATISTICS))
            for at in range(0, len(x), batch):
                if len(part := x[at : at + batch]) >= batch // 4:  # the risk of fewer rows says little
                    learner.step(p[rng.integers(0, len(p), min(batch, len(p)))], part, rate)
                    seen += len(part)
        if seen:
            line = np.concatenate([w.ravel() for w in learner.weights()]) * seen
            yield pa.RecordBatch.from_arrays([pa.array(range(len(line)), pa.int32()), pa.array(line), pa.array([seen] * len(line), pa.int64())], ["at", "sum", "n"])

    sums = arrow_map(ids.select("x"), learn, "at int, sum double, n long").groupBy("at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).collect()
    if not sums:
        return net
    # rounded, so that the order in which sums met doesn't show
    line = np.array([r["sum"] / r["n"] for r in sorted(sums)]).astype(np.float32).astype(np.float64)
    shapes, parts, at = [net.w1.shape, net.b1.shape, net.w2.shape], [], 0
    for shape in shapes:
        parts.append(line[at : at + int(np.prod(shape))].reshape(shape))
        at += int(np.prod(shape))
    return Network(net.mean, net.scale, *parts, float(line[-1]))


def scored(seen: DataFrame, net: Network | None, prior: float) -> DataFrame:
    """``row`` and ``score`` of staged statistics."""
    kind = seen.schema["row"].dataType.simpleString()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, STATISTICS)
            s = net.score(x) if net else np.full(len(x), prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["row", "score"])

    return arrow_map(seen, body, f"row {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (by default ``doc_id``), ``held_out``, ``score`` and ``predicted`` of each row."""
    seen = measured(docs, list(dict.fromkeys(["doc_id", *(carry or [])])))
    out = scored(seen, *fit(seen, labels)).select("row.*", "score")
    return out.withColumns({"held_out": remainder() == 2, "predicted": (F.col("score") >= threshold).cast("int")})


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, with all their columns.

    Statistics are staged without the texts to fit the network, and taken again as rows are filtered, so no
    copy of the table is written.
    """
    net, prior = fit(measured(docs, ["doc_id"]), labels)
    shape = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = np.array([statistics(t) for t in texts_of(batch)])
            s = net.score(x) if net else np.full(len(x), prior)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(s >= threshold))], ["row"])

    kind = shape.schema["row"].dataType.simpleString()
    return arrow_map(shape, body, f"row {kind}").select("row.*")
