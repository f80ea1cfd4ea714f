"""Quality rules under weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation over the histogram of
vote patterns (at most 3 ** len(RULES) rows, whatever the input) estimates how often each rule is
right given each class, among documents that pass the base test; a document's posterior is the naive-Bayes combination of its votes.

Defined cases: a null or blank text has no words, so it fails the base test; a very long text is measured whole, as one row; an empty table gives an
empty table; repeated rows are judged each for itself and alike; columns of the input other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievector.plans.staging import stage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Characters that are rare in prose: no letter, digit, space or everyday punctuation.
ODD = r"[^\p{L}\p{N}\s.,;:'()?-]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
PULL = 0.02


def bound(value: Column, body) -> Column:
    """``body`` of a column that is computed once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of eight words which the array holds twice or more.

    Windows are matched by hash, then word by word.  Texts without two equal hashes stop after one
    pass; the others sort their (hash, place) pairs.
    """

    def same(a: Column, b: Column) -> Column:
        test = F.lit(True)
        for j in range(WINDOW):
            test = test & (F.get(words, a + j) == F.get(words, b + j))
        return test

    def covered(places: Column) -> Column:
        spans = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x)

    def twice(pairs: Column) -> Column:
        def near(x: Column, i: Column, step: int) -> Column:
            other = F.get(pairs, i + step)
            inside = (i + step >= 0) & (i + step < F.size(pairs))
            return inside & (other["h"] == x["h"]) & same(other["p"], x["p"])

        kept = F.filter(pairs, lambda x, i: near(x, i, 1) | near(x, i, -1))
        return bound(F.sort_array(F.transform(kept, lambda x: x["p"])), covered)

    def doubled(hashes: Column, width: int) -> Column:
        """Hashes of spans of ``2 * width`` words; the last spans are short, each of another length, and so unlike all others."""
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + width)))

    def count(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(bound(pairs, twice))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    spans = bound(hashes, lambda h: bound(doubled(h, 1), lambda h2: bound(doubled(h2, 2), lambda h4: bound(doubled(h4, 4), count))))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(spans)


def measure(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Per document the counts that the rules read; columns to ``carry`` along come as a struct ``row``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = bound(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_stutters"),
        ),
    )
    of_lines = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    key = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else [F.col("doc_id")]
    return docs.select(
        *key,
        of_words.alias("w"),
        of_lines.alias("l"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(ODD)).cast("long").alias("n_odd"),
    ).select("row" if carry else "doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_odd")


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(-1))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes on the columns of ``measure``; ratios are written as products, so nothing divides by zero.

    A rule that looks for one defect abstains where it finds none; only rules on the whole text vote good.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "length": _vote(n < 30, n >= 60),
        "repeats": _vote(5 * F.col("n_repeat_words") > n),
        "symbols": _vote(10 * F.col("n_symbols") > n),
        "lines": _vote(10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "word_length": _vote((chars < 2 * n) | (chars > 15 * n), (10 * chars >= 28 * n) & (chars <= 11 * n)),
        "stutters": _vote(5 * F.col("n_stutters") > n),
        "capitals": _vote(10 * F.col("n_upper") > 4 * chars),
        "plain": _vote(8 * F.col("n_odd") > n, 50 * F.col("n_odd") <= n),
    }


@dataclass(frozen=True)
class VoteModel:
    """Probabilities of each vote given the class; ``prior`` is that of a good document."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def weights(self) -> tuple[float, list[tuple[float, float, float]]]:
        each = [tuple(math.log(g / b) for g, b in zip(x, y)) for x, y in zip(self.good, self.bad)]
        return math.log(self.prior / (1 - self.prior)), each


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 40, prior: float = 0.8) -> VoteModel:
    """Expectation-maximisation over (votes, count).

    It starts from rules of which a bad vote is rare among good documents.  Each cell has a share
    ``PULL`` of the documents as pseudo-counts around that start, so the classes keep their meaning
    and every probability stays inside (0, 1) at every input size.
    """
    start_good, start_bad = (0.02, 0.38, 0.6), (0.4, 0.35, 0.25)
    pull = PULL * max(1, sum(c for _, c in patterns))
    good, bad = [list(start_good) for _ in range(n_rules)], [list(start_bad) for _ in range(n_rules)]
    for _ in range(rounds):
        up = [[pull * x for x in start_good] for _ in range(n_rules)]
        down = [[pull * x for x in start_bad] for _ in range(n_rules)]
        mass, total = pull * 0.8, pull
        for votes, count in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[k][v + 1] / bad[k][v + 1]) for k, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            mass, total = mass + p * count, total + count
            for k, v in enumerate(votes):
                up[k][v + 1] += p * count
                down[k][v + 1] += (1 - p) * count
        prior = min(0.999, max(0.001, mass / total))
        good = [[x / sum(row) for x in row] for row in up]
        bad = [[x / sum(row) for x in row] for row in down]
    return VoteModel(prior, tuple(map(tuple, good)), tuple(map(tuple, bad)))


def posterior(model: VoteModel, names: list[str]) -> Column:
    """Probability that the class is good, from vote columns ``v_<name>``."""
    base, each = model.weights()
    odds = F.lit(base)
    for name, w in zip(names, each):
        odds = odds + F.when(F.col(f"v_{name}") < 0, w[0]).when(F.col(f"v_{name}") > 0, w[2]).otherwise(w[1])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), odds))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit(seen: DataFrame, names: list[str]) -> VoteModel:
    """The vote model of the rows that pass the base test, from their pattern counts."""
    counted = seen.where(~F.col("base_failed")).groupBy(*[f"v_{k}" for k in names]).count().collect()
    return fit_votes([(tuple(r[:-1]), r[-1]) for r in sorted(map(tuple, counted))], len(names))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Measures, votes, posterior and verdict of every document.

    Texts are read once: measures and votes go to a staged table, whose pattern counts fit the model.
    """
    votes = rules()
    names = list(votes)
    seen = stage(measure(docs).withColumns({f"v_{k}": v for k, v in votes.items()}).withColumn("base_failed", base_failed()), "rules")
    out = seen.withColumn("posterior", posterior(fit(seen, names), names))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Votes are staged without the texts to fit the model, and cast again as rows are filtered: the verdict is
    computed beside the row, so no join can multiply rows, and no copy of the table is written.
    """
    votes = rules()
    names = list(votes)
    cast = lambda df: df.withColumns({f"v_{k}": v for k, v in votes.items()}).withColumn("base_failed", base_failed())
    seen = stage(cast(measure(docs)).select("base_failed", *[f"v_{k}" for k in names]), "votes")
    model = fit(seen, names)
    return cast(measure(docs, docs.columns)).where(~F.col("base_failed") & (posterior(model, names) >= threshold)).select("row.*")
