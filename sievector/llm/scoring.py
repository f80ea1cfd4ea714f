"""Language-model scores of documents, and the word-frequency score that they are compared with.

One pass over the training texts gathers counts of words, counts of pairs of subword ids, and windows for the
attention weights; the counts meet by partial sums and a shuffle, and cover every text.  Weights are first
fitted on ``first_windows`` windows, drawn by a hash of key and place, and then by all tasks side by side, each over every
window of its own texts, and averaged.  Passes and shares are the same whatever the size of the corpus.  The most frequent ``broadcast_words`` words travel to the tasks; all
others meet their counts in a join, so no count is left out.  The ``size`` most frequent ids have numbers of their own
in the model; the others share one, and are told apart by how frequent they are.

Defined cases: a null or blank text is its end alone; a very long text is cut into windows like any other; an empty
training set gives a base score of probabilities from the constant alone and a model of even counts; rows that
repeat are scored each for itself; a null key counts as the empty text when the training rows are chosen; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievector.llm.attention import BEFORE, SPAN, Adam, Counts, Model, windows
from sievector.llm.batches import arrow_map, pieces
from sievector.llm.subwords import REMEMBERED, Vocabulary, frequent
from sievector.llm.words import Coder, Words, words
from sievector.plans.staging import stage

#: Base smoothing; a fixed value.
ADD = 0.1
#: Text bytes that a worker holds at once: windows take many times that.
PIECE = 1 << 19
#: Text bytes in a window of new ids, about; weights in a row of their table; tasks whose weights one task adds up.
BYTES, BLOCK, FAN = 80, 1 << 14, 64
#: Windows of a stored row, and of a step; rows made into windows at once; groups of the model's classes.
TOGETHER, STEP, AT_ONCE, GROUPS = 8, 512, 1280, 8

_CODERS: dict[str, Coder] = {}


def _coder(path: str, shared) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(*shared.value)
    return _CODERS[path]


def _ended(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with its end."""
    out = np.full(len(ids) + len(sizes), end, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, sizes + 1


def _draw(keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A number of 32 bits for each window, from its text's key and its place there."""
    x = keys.view(np.uint64) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.int64)


def gather(training: DataFrame, path: str, shared, end: int, share: float, first: float) -> DataFrame:
    """Staged partial counts of a task, and windows: (word, n), (pair, n), (window) and (window, draw), other columns null.

    A pair is the earlier id times 2 ** 20 plus the later; a window is 16-bit raw ids.  Rows without a draw hold up to ``TOGETHER``
    windows each, together all whose draw is within ``share``; those within ``first`` as well stand once more, each with its draw."""

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"word": pa.string(), "pair": pa.int64(), "n": pa.int64(), "window": pa.binary(), "draw": pa.int64()}
        return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], list(kinds))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, pairs = _coder(path, shared), Counter(), []

        def flush() -> Iterator[pa.RecordBatch]:
            if seen:
                yield rows(word=pa.array(list(seen), pa.string()), n=pa.array(list(seen.values()), pa.int64()))
            if pairs:
                keys, place = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
                yield rows(pair=pa.array(keys), n=pa.array(np.bincount(place, np.concatenate([c for _, c in pairs])).astype(np.int64)))
            seen.clear()
            pairs.clear()

        for batch in pieces(batches, most=PIECE):
            found = words(batch.column(0))
            seen.update(dict(zip(found.spelled(), np.bincount(found.code, minlength=len(found.distinct)).tolist())))
            ids, sizes = _ended(*coder.ids(found), end)
            line = np.concatenate([[end], ids]).astype(np.int64)
            pairs.append(np.unique(line[:-1] << 20 | line[1:], return_counts=True))
            got, text, nth = windows(ids, sizes, end, end + 1)
            draw = _draw(batch.column(1).to_numpy(), np.zeros(found.texts, np.int64))[text]
            draw = _draw(draw, nth)
            own = np.flatnonzero(draw < share * (1 << 32))
            if len(own):
                data = np.ascontiguousarray(got[own].astype("<u2"))
                ends = np.append(np.arange(0, len(own), TOGETHER), len(own)) * 2 * data.shape[1]
                yield rows(window=pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]))
                early = np.flatnonzero(draw[own] < first * (1 << 32))
                if len(early):
                    yield rows(window=pa.array([x.tobytes() for x in data[early]], pa.binary()), draw=pa.array(draw[own[early]]))
            if len(seen) > REMEMBERED or len(pairs) > 16:
                yield from flush()
        yield from flush()

    return stage(arrow_map(training.select("text", F.xxhash64("key").alias("hash")), body, "word string, pair long, n long, window binary, draw long"), "gathered")


def _rows(column: pa.Array, number: np.ndarray) -> np.ndarray:
    """Windows of model numbers from stored windows of raw ids."""
    raw = np.frombuffer(b"".join(column.to_pylist()), "<u2")
    return number.take(raw).reshape(-1, BEFORE + SPAN + 1)


def counted(raw: DataFrame, end: int, size: int, n_classes: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """The untrained model of all pair counts, each raw id's number in it (one more for filler), and the log probability
    of rare ids among themselves.  At most (size + 2) ** 2 rows of eight bytes reach the driver."""
    spark = raw.sparkSession
    pairs = stage(raw.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    later, earlier = F.col("pair").bitwiseAND(F.lit((1 << 20) - 1)), F.shiftright("pair", 20)
    count = np.zeros(end + 1)
    for r in pairs.groupBy(later.alias("id")).agg(F.sum("n").alias("n")).collect():  # at most one row an id
        count[r["id"]] = r["n"]
    ranked = [i for i in np.lexsort((np.arange(end), -count[:end])).tolist()[:size] if count[i]]
    number = np.full(end + 2, size, np.int32)
    number[ranked] = np.arange(len(ranked))
    number[end:] = size + 1, size + 2
    rare = np.flatnonzero(number == size)
    log_rare = np.zeros(end + 1)
    log_rare[rare] = np.log((count[rare] + ADD) / (count[rare] + ADD).sum()) if len(rare) else 0
    told = F.broadcast(spark.createDataFrame([(i, int(number[i])) for i in ranked] + [(end, size + 1)], "id long, number int"))
    sides = pairs.select(earlier.alias("a"), later.alias("b"), "n")
    for side, name in (("a", "x"), ("b", "y")):
        sides = sides.join(told.withColumnsRenamed({"id": side, "number": name}), side, "left")
    place = F.coalesce("x", F.lit(size)) * F.lit(size + 2) + F.coalesce("y", F.lit(size))
    got = sides.groupBy(place.alias("place")).agg(F.sum("n").cast("float").alias("n")).toArrow()
    table = np.zeros((size + 2) ** 2)
    table[got["place"].to_numpy()] = got["n"].to_numpy()
    return Model(Counts.from_pairs(table.reshape(size + 2, size + 2), n_classes, groups=math.gcd(n_classes, GROUPS))), number, log_rare


def fit(model: Model, raw: DataFrame, number: np.ndarray, first_windows: int, epochs: int, rate: float = 0.03) -> None:
    """Weights from ``first_windows`` windows on the driver, then from all windows by all tasks, averaged by how many each had.

    Tasks send their weights in blocks; blocks are added up as they stream through tasks that hold one sum a block."""
    spark = raw.sparkSession
    stored = raw.where("window is not null").select("window", "draw")
    # of more windows than are wanted, those of least draw
    first = [r["window"] for r in stored.where("draw is not null").orderBy("draw", "window").limit(first_windows).collect()]
    if not first:
        return
    model.train(_rows(pa.array(first, pa.binary()), number), epochs)
    shared = spark.sparkContext.broadcast((model, number))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        model, number = shared.value
        adam, seen, rng = Adam(copy.deepcopy(model)), 0, np.random.default_rng(4)
        for batch in batches:
            for begin in range(0, batch.num_rows, AT_ONCE):
                rows = rng.permutation(_rows(batch.column(0).slice(begin, AT_ONCE), number))
                for at in range(0, len(rows), STEP):
                    adam.step(rows[at : at + STEP], rate)
                seen += len(rows)
        if seen:
            line = adam.model.flat().astype(np.float64) * seen
            parts = [line[at : at + BLOCK].tobytes() for at in range(0, len(line), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["block", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, n, sums in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(block, [0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(sums)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s.tobytes() for _, s in held.values()], pa.binary())], ["block", "n", "sums"])

    kind = "block int, n long, sums binary"
    own = stored.where("draw is null").select("window")
    learned, tasks, blocks = arrow_map(own, learn, kind), own.rdd.getNumPartitions(), -(-len(model.flat()) // BLOCK)
    while tasks > FAN:  # a tree of sums: a task never reads more than the rows of FAN tasks
        tasks = -(-tasks // FAN)
        learned = arrow_map(learned.repartition(tasks * blocks, "block", F.pmod(F.spark_partition_id(), F.lit(tasks))), add, kind)
    by_block = sorted(arrow_map(learned.repartition(blocks, "block"), add, kind).collect())  # one row a block
    model.unflat(np.concatenate([np.frombuffer(r["sums"]) / r["n"] for r in by_block]))


def _tails(found: Words, known: np.ndarray) -> pa.ListArray:
    """Per text its words that are not ``known``, with how often each occurs."""
    rest = np.flatnonzero(~known[found.code])
    keys, n = np.unique(found.of[rest] * np.int64(max(1, len(found.distinct))) + found.code[rest], return_counts=True)
    of, code = np.divmod(keys, max(1, len(found.distinct)))
    ends = np.searchsorted(of, np.arange(found.texts + 1))
    pairs = pa.StructArray.from_arrays([found.distinct.take(pa.array(code)), pa.array(n.astype(np.int64))], ["word", "n"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def score(
    docs: DataFrame,
    vocabulary_path: str,
    training: Column,
    key: str = "doc_id",
    size: int = 2048,
    n_classes: int = 128,
    broadcast_words: int = 40_000,
    share: float = 1.0,
    least_windows: int | None = None,
    first_windows: int = 20_000,
) -> DataFrame:
    """(key, training, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are base-10 logarithms.

    Weights learn from ``share`` of the windows, by default every one; ``least_windows`` is accepted for callers of earlier versions, and unused."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(vocabulary_path)
    shared = spark.sparkContext.broadcast((vocabulary.tokens, vocabulary.special))
    end = len(vocabulary.tokens)
    if end + 1 >= 1 << 16:
        raise ValueError("ids need 16 bits")
    rows = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"), training.alias("training"))
    learned = rows.where("training")
    n_training, n_bytes = learned.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # so many windows have twice as small a draw as are wanted first, about; the cut leaves tasks little to send
    first = min(1.0, 2 * first_windows / max(1.0, n_training + n_bytes / BYTES))
    raw = gather(learned, vocabulary_path, shared, end, share, first)
    counts = stage(raw.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_training, distinct + (n_training > 0)
    below = np.log10(total + ADD * (distinct + 1))
    model, number, log_rare = counted(raw, end, size, n_classes)
    fit(model, raw, number, first_windows, 4)
    top = {r["word"]: r["c"] for r in frequent(counts, "c", broadcast_words).collect()}
    known = spark.sparkContext.broadcast((model, number, log_rare / np.log(10), {w: float(np.log10(c + ADD) - below) for w, c in top.items()}))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (lm, to_number, of_rare, often) = _coder(vocabulary_path, shared), known.value
        for batch in pieces(batches, most=PIECE):
            found = words(batch.column(1))
            logs = np.array([often.get(w, np.nan) for w in found.spelled()], np.float64)
            frequent_word = ~np.isnan(logs)
            each = np.where(frequent_word, logs, 0.0)[found.code]
            ids, sizes = coder.ids(found)
            rare = np.bincount(np.repeat(np.arange(found.texts), sizes), of_rare.take(ids), found.texts)
            got, text, _ = windows(*_ended(to_number.take(ids), sizes, size + 1), size + 1, size + 2)
            own = np.bincount(text, lm.log_probabilities(got).sum(1, dtype=np.float64), found.texts) / np.log(10) + rare
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(found.lengths() + 1, pa.int64()),
                    pa.array(np.bincount(found.of, frequent_word[found.code], found.texts).astype(np.int64)),
                    pa.array(np.bincount(found.of, each, found.texts).astype(np.float64)),
                    pa.array(own),
                    _tails(found, frequent_word),
                ],
                ["key", "training", "n_tokens", "seen", "base", "score", "tail"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    out = arrow_map(rows, body, f"key {kind}, training boolean, n_tokens long, seen long, base double, score double, tail array<struct<word: string, n: long>>")
    out = stage(out.withColumn("rid", F.monotonically_increasing_id()), "scored")
    tail = out.select("rid", F.explode("tail").alias("x")).select("rid", "x.word", "x.n").join(counts, "word", "left")
    part = F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD)) - F.lit(float(below)))
    tail = tail.groupBy("rid").agg(F.sum(part).alias("tail_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    end_log = float(np.log10(n_training + ADD) - below)
    return out.drop("tail").join(tail, "rid", "left").select(
        F.col("key").alias(key),
        "training",
        "n_tokens",
        (F.col("seen") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(n_training > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
        "score",
    )
