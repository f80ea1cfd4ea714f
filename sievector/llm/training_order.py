"""Training order: a keyed permutation gives every sequence its slot, and slots are written to shards.

Documents are encoded, ended, and cut into sequences of at most ``length`` ids.  A first pass encodes and keeps only how many
sequences each task has, so all n are numbered 0..n-1 and no ids are kept in between.  A second pass encodes
again; a balanced Feistel network over the next even power of two permutes the numbers, values of n or
more walk on along their cycle, and the image is the sequence's slot.  Tasks own ranges of slots and write
them in order: slot s stands in shard s // per_shard at place s % per_shard, and every shard but the last is full.
Records have a fixed stride (a 16-bit count and ``length`` 16-bit ids), so a reader computes where a slot is and resumes there.

Defined cases: a null or empty text is its end mark alone; a very long text is as many sequences as it fills; rows whose key
repeats or is null are documents of their own; an empty table writes no shard; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievector.llm.batch_encoder import BatchEncoder, ended
from sievector.llm.batches import arrow_map, pieces
from sievector.sources.files import open_fs, put_in_place
from sievector.llm.subwords import Vocabulary, encoder_of
from sievector.plans.staging import fresh_path, stage

#: Shards that a task writes, at most.
SHARDS = 8


class Permutation:
    """A keyed bijection of 0..n-1."""

    ROUNDS = 6

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        with np.errstate(over="ignore"):
            self.keys = [_stir(np.array([key * self.ROUNDS + r + 1], np.uint64))[0] for r in range(self.ROUNDS)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys:
            left, right = right, left ^ (_stir(right ^ k) & self.mask)
        return left << np.uint64(self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ (_stir(left ^ k) & self.mask), left
        return left << np.uint64(self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x).astype(np.uint64))
        while (far := out >= np.uint64(max(1, self.n))).any():
            out[far] = step(out[far])
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self._once)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._back)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steady(docs: DataFrame) -> DataFrame:
    """``docs`` if it is split alike whenever it is read, as files are; else a staged copy."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    nodes = re.findall(r"^[ :+-]*([A-Z]\w*)", plan.toString(), re.M)
    return docs if plan.deterministic() and set(nodes) <= {"Project", "Filter", "Relation", "RelationV2", "LocalRelation", "LogicalRDD", "Range"} else stage(docs, "documents")


def _cutter(path: str, shared):
    return encoder_of(("order", path), lambda: BatchEncoder(Vocabulary(*shared.value)))


def numbered(docs: DataFrame, path: str, shared, length: int) -> tuple[dict[int, tuple[int, int]], int]:
    """(first number, sequences) of each task that has any, and the sum; one row a task reaches the driver."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = 0
        for batch in pieces(batches):
            _, sizes = _cutter(path, shared).encode(batch.column(1))
            n += int((-(-(sizes + 1) // length)).sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["task", "n"])

    found, total = {}, 0
    for task, n in sorted(map(tuple, arrow_map(docs, body, "task int, n long").collect())):
        found[task] = (total, n)
        total += n
    return found, total


def materialise(docs: DataFrame, vocabulary_path: str, seed: int = 17, length: int = 512, per_shard: int = 16384, end_id: int = 50256, key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Write the shards and return (key, part, n, slot, shard, offset, path, ids_crc32), one row a sequence.

    A task writes whole shards under names of their own and moves them into place, so a task that runs again
    leaves the same files.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "shards")
    vocabulary = Vocabulary.load(vocabulary_path)
    if len(vocabulary.tokens) > 1 << 16:
        raise ValueError("ids need 16 bits")
    own = steady(docs.select(F.col(key).alias("key"), "text"))
    shared = spark.sparkContext.broadcast((vocabulary.tokens, vocabulary.ranks, vocabulary.special))
    tasks, total = numbered(own, vocabulary_path, shared, length)
    told, order = spark.sparkContext.broadcast(tasks), Permutation(total, seed)
    shards = max(1, -(-total // per_shard))
    each = max(1, min(SHARDS, shards // int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, there = told.value.get(TaskContext.get().partitionId(), (0, 0))
        number = first
        for batch in pieces(batches):
            ids, sizes = ended(*_cutter(vocabulary_path, shared).encode(batch.column(1)), end_id)
            spans = -(-sizes // length)
            at = np.repeat(np.arange(len(sizes)), spans)
            part = np.arange(len(at)) - np.repeat(np.cumsum(spans) - spans, spans)
            start = (np.cumsum(sizes) - sizes)[at] + part * length
            size = np.minimum(length, sizes[at] - part * length)
            slot = order.slot(number + np.arange(len(at)))
            number += len(at)
            # rows of the same bytes, one after another: offsets into one buffer
            if number - first > there:
                break
            data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(2 * start, 2 * len(ids)).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(part), pa.array(size), pa.array(slot), data], ["key", "part", "n", "slot", "ids"])
        if number - first != there:
            raise RuntimeError("the documents were split otherwise than in the first pass")

    kind = docs.schema[key].dataType.simpleString()
    placed = arrow_map(own, cut, f"key {kind}, part long, n long, slot long, ids binary")
    by_task = F.floor(F.col("slot") / F.lit(per_shard * each)).cast("int")
    ranged = placed.repartitionById(-(-shards // each), by_task).sortWithinPartitions("slot")
    stride = 2 + 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_fs(folder)
        files.create_dir(base, recursive=True)
        held, stream, temporary = None, None, ""

        def close() -> None:
            stream.close()
            put_in_place(files, temporary, f"{base}/shard-{held:08d}.bin")

        for batch in batches:
            by = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            shard, crc = (by["slot"].to_numpy() // per_shard).tolist(), []
            for to, n, ids in zip(shard, by["n"].to_pylist(), by["ids"].to_pylist()):
                if to != held:
                    if stream:
                        close()
                    held, temporary = to, f"{base}/.shard-{to:08d}-{uuid.uuid4().hex}"
                    stream = files.open_output_stream(temporary)
                stream.write(n.to_bytes(2, "little") + ids + b"\0" * (2 * length - len(ids)))
                crc.append(zlib.crc32(ids))
            paths = [f"{folder}/shard-{x:08d}.bin" for x in shard]
            offset = by["slot"].to_numpy() % per_shard * stride
            yield pa.RecordBatch.from_arrays(
                [by["key"], by["part"], by["n"], by["slot"], pa.array(shard, pa.int64()), pa.array(offset), pa.array(paths, pa.string()), pa.array(crc, pa.int64())],
                ["key", "part", "n", "slot", "shard", "offset", "path", "ids_crc32"],
            )
        if stream:
            close()

    index = arrow_map(ranged, write, f"key {kind}, part long, n long, slot long, shard long, offset long, path string, ids_crc32 long")
    return stage(index, "shard-index").withColumnRenamed("key", key)


def read(folder: str, slot: int, count: int, length: int = 512, per_shard: int = 16384) -> Iterator[np.ndarray]:
    """Ids of ``count`` slots from ``slot`` on, in order; stops at the last slot."""
    files, base = open_fs(folder)
    stride = 2 + 2 * length
    while count > 0:
        path, place = f"{base}/shard-{slot // per_shard:08d}.bin", slot % per_shard
        if files.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return
        with files.open_input_file(path) as f:
            if f.size() <= place * stride:
                return
            f.seek(place * stride)
            data = f.read(min(count, per_shard - place) * stride)
        for at in range(0, len(data), stride):
            n = int.from_bytes(data[at : at + 2], "little")
            yield np.frombuffer(data, "<u2", n, at + 2)
        slot, count = slot + len(data) // stride, count - len(data) // stride
