"""Packing of documents into sequences: shortest-pack-first over the length histogram.

A document's ids, end mark included, are cut into full sequences and one rest.  Only the histogram of
rest lengths (fewer than ``capacity`` rows) reaches the driver.  Lengths are placed longest first, each into the
pack with the fewest tokens so far that still has room; packs of the same make-up are one pattern with a count.
Patterns go back to pieces by rank: pieces of one length are numbered 0, 1, ... and each slot of a pattern owns
a range of those numbers.

Defined cases: a null or empty text is its end mark alone; a very long text is cut like any other; rows whose key repeats or is null are documents
of their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievector.llm.batch_encoder import BatchEncoder, ended
from sievector.llm.batches import arrow_map, pieces
from sievector.llm.subwords import Vocabulary, encoder_of
from sievector.plans.staging import stage


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, how often in each pack), ...]) that hold every piece of the histogram.

    ``open_at[t]`` has the unfinished patterns of ``t`` tokens.  A length takes the packs with the
    fewest tokens; it splits a pattern where it has fewer pieces than the pattern has packs, and fills
    packs several times over where it has more.
    """
    open_at: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    done: list[tuple[int, list[tuple[int, int]]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            total = min((t for t in open_at if t + length <= capacity), default=0)
            if total:
                count, slots = open_at[total].pop()
                if not open_at[total]:
                    del open_at[total]
            else:
                count, slots = left // (capacity // length), []
                if not count:  # one pack with all that are left
                    count, each = 1, left
                    _put(open_at, done, count, [(length, each)], length * each, capacity)
                    break
            if total:
                used = min(count, left)
                if used < count:
                    _put(open_at, done, count - used, slots, total, capacity)
                _put(open_at, done, used, _more(slots, length, 1), total + length, capacity)
                left -= used
            else:
                each = capacity // length
                _put(open_at, done, count, [(length, each)], length * each, capacity)
                left -= count * each
    return done + [x for found in open_at.values() for x in found]


def _more(slots: list[tuple[int, int]], length: int, each: int) -> list[tuple[int, int]]:
    if slots and slots[-1][0] == length:
        return [*slots[:-1], (length, slots[-1][1] + each)]
    return [*slots, (length, each)]


def _put(open_at, done, count, slots, total, capacity) -> None:
    if total == capacity:
        done.append((count, slots))
    else:
        open_at.setdefault(total, []).append((count, slots))


def slot_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, packs, slots in a pack, first pack, offset of the first slot), by length and rank.

    Pieces of one length go to a pattern's packs in turn: rank r - first = slot * packs + pack.
    """
    given: dict[int, int] = {}
    rows, pack = [], 0
    for count, slots in patterns:
        offset = 0
        for length, each in slots:
            first = given.get(length, 0)
            rows.append((length, first, count, each, pack, offset))
            given[length] = first + count * each
            offset += length * each
        pack += count
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def cut(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int, key: str = "doc_id") -> DataFrame:
    """Pieces of each document: (key, start, length, ids_crc32, doc_tokens, task, row).

    ``task`` and ``row`` number the pieces within the writing task, for ranks that need no global sort.
    """
    vocabulary = Vocabulary.load(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.tokens, vocabulary.ranks, vocabulary.special))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(("pack", vocabulary_path), lambda: BatchEncoder(Vocabulary(*shared.value)))
        for batch in pieces(batches):
            ids, sizes = ended(*encoder.encode(batch.column(1)), end_id)
            spans = -(-sizes // capacity)
            at = np.repeat(np.arange(len(sizes)), spans)
            start = (np.arange(len(at)) - np.repeat(np.cumsum(spans) - spans, spans)) * capacity
            length = np.minimum(capacity, sizes[at] - start)
            begin, data = (np.cumsum(sizes) - sizes)[at] + start, memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(begin.tolist(), (begin + length).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in (start, length, crc, sizes[at]))], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("key"), "text"), body, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; every id of every document lies in exactly one piece."""
    cuts = stage(cut(docs, vocabulary_path, capacity, end_id, key).withColumn("task", F.spark_partition_id()), "pieces")
    histogram = {r[0]: r[1] for r in cuts.where(F.col("length") < capacity).groupBy("length").count().collect()}
    patterns = shortest_pack_first(histogram, capacity)
    table = slot_table(patterns)
    packs = sum(c for c, _ in patterns)

    # A rank within a length: pieces of earlier tasks first, then those of the own task, in a fixed order.
    # Full pieces are sequences of their own and are ranked as the length ``capacity``.
    order = Window.partitionBy("length", "task").orderBy("key", "start", "ids_crc32", "doc_tokens")
    within = cuts.withColumn("rank", F.row_number().over(order) - 1)
    sums = cuts.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = within.join(firsts, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["key", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rank ranges of one length abut, so (length, rank) finds its slot by one search
        wide = int(table[:, 1].max(initial=0)) + 1
        firsts = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in ("length", "rank"))
            sequence, offset = packs + rank, np.zeros_like(rank)
            if (rest := np.flatnonzero(length < capacity)).size:
                r = rank[rest]
                row = table[np.searchsorted(firsts, length[rest] * wide + np.minimum(r, wide - 1), "right") - 1]
                nth = r - row[:, 1]
                sequence[rest] = row[:, 4] + nth % row[:, 2]
                offset[rest] = row[:, 5] + nth // row[:, 2] * length[rest]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(ranked.select(*names, "rank"), place, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)
