"""Near-duplicate documents: circulant MinHash, banding, and Jaccard on full shingle sets.

Shingles are hashed to 64 bits.  One permutation maps them into a ring of 2 ** 32 places; coordinate k
of the signature is the least image under a second permutation of the places shifted by k.  Texts with
equal sets are one class from the start.  Classes that agree in a band share a bucket; within buckets the
sets are compared exactly, in blocks, and each block gives a spanning forest of its links instead of
the links.  Components of the forests are those of the links.

Defined cases: a null or wordless text has an empty set and is a component of its own; a very long text is compared whole; a text of fewer
words than a shingle has its whole sequence as one; rows with equal ids are documents of their own;
an id that is null never names a component that has other ids; extra columns are carried, not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievector.llm.batches import arrow_map, pieces, texts_of
from sievector.plans.components import connected_components
from sievector.plans.staging import stage

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Most classes in a block, and shingles about; a larger bucket is compared block by block.
BLOCK, BLOCK_SHINGLES = 1024, 2 << 20
#: Cells of the dense part of a block's incidence matrix that are held at once.
CELLS = 16 << 20


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words, ASCII capitals folded."""
    words = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    flat = np.empty(total, object)
    flat[:] = [w for ws in words for w in ws]
    one = pd.util.hash_array(flat, categorize=True) if total else np.empty(0, np.uint64)
    runs = np.full(max(0, total - width + 1), np.uint64(width))
    for j in range(width):
        runs = _stir(runs * _MIX + one[j : total - width + 1 + j]) if len(runs) else runs
    out, start = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(runs[start : start + n - width + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for j in range(n):
                short = _stir(short * _MIX + one[start + j])
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
        start += n
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: a row of 32-bit minima for each."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    ring = (_stir(np.concatenate(sets) * _MIX) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), coordinates), np.uint32)
    v, w = np.empty_like(ring), np.empty_like(ring)
    for k in range(coordinates):
        np.add(ring, np.uint32(k), out=v)  # the circular shift
        np.right_shift(v, np.uint32(16), out=w)
        v ^= w
        v *= np.uint32(0x85EBCA6B)
        np.right_shift(v, np.uint32(13), out=w)
        v ^= w
        v *= np.uint32(0xC2B2AE35)
        np.right_shift(v, np.uint32(16), out=w)
        v ^= w
        out[:, k] = np.minimum.reduceat(v, starts)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    keys = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        keys = _stir(keys * _MIX + signature[:, r::rows][:, :bands].astype(np.uint64) + np.uint64(r + 1))
    return keys.view(np.int64)


def sketch(docs: DataFrame, width: int, bands: int, rows: int, key: str) -> DataFrame:
    """Staged (rid, key, mark, n_shingles, set_a, set_b, bands) of every row.

    ``mark`` tells equal keys with other texts apart; (n_shingles, set_a, set_b) names the set.
    """
    shape = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(texts_of(batch), width)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full, bands * rows), bands)) if full else iter(())
            names = [(np.bitwise_xor.reduce(_stir(s)), np.bitwise_xor.reduce(_stir(s * _MIX))) if len(s) else (0, 0) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([a for a, _ in names], np.uint64).view(np.int64)),
                    pa.array(np.array([b for _, b in names], np.uint64).view(np.int64)),
                    pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                ["key", "mark", "n_shingles", "set_a", "set_b", "bands"],
            )

    kind = shape.schema["key"].dataType.simpleString()
    out = arrow_map(shape, body, f"key {kind}, mark long, n_shingles long, set_a long, set_b long, bands array<long>")
    return stage(out.withColumn("rid", F.monotonically_increasing_id()), "sketch")


def _forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, cross: np.ndarray | None) -> list[tuple[int, int]]:
    """Spanning forest of the links 100 * common >= percent * union among the sets.

    ``cross`` (0 or 1 a set) limits pairs to those between its two sides.
    """
    n = len(ids)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if 100 * common >= percent * (sizes.sum() - common) else []
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = seen[column] > 1  # a shingle of one set alone is common to no two
    number = np.cumsum(seen > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    width = int(number[-1]) + 1 if len(number) else 0
    common = np.zeros((n, n), np.float32)
    span = max(1, CELLS // n)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, width, span):
        a, b = np.searchsorted(column, (lo, lo + span))
        part = np.zeros((n, min(span, width - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    whole = common.astype(np.int64)
    linked = 100 * whole >= percent * (sizes[:, None] + sizes[None, :] - whole)
    if cross is not None:
        linked &= cross[:, None] != cross[None, :]
    left, found = np.ones(n, bool), []
    for root in range(n):  # breadth first over rows of the matrix
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            found.extend((int(ids[at]), int(ids[x])) for x in new)
            front.extend(new.tolist())
    return found


def links(cells: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of forests; ``cells`` has (bucket, low, high, side, cid, set), rows of a block pair adjacent."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, {}

        def close() -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            ids = np.array(list(rows), np.int64)
            sets = [np.frombuffer(s, np.uint64) for s, _ in rows.values()]
            sides = np.array([x for _, x in rows.values()])
            return _forest(ids, sets, percent, sides if held[1] != held[2] else None)

        def edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            found = []
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "low", "high", "side", "cid", "set")}
            for bucket, low, high, side, cid, own in zip(*columns.values()):
                if held != (bucket, low, high):
                    found += close() if held else []
                    held, rows = (bucket, low, high), {}
                rows[cid] = (own, side)
            yield edges(found)
        if held:
            yield edges(close())

    return arrow_map(cells, body, "a long, b long")


def components(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, key: str = "doc_id") -> DataFrame:
    """(rid, key, mark, n_shingles, component, keeper) of every row.

    ``component`` is the smallest key of the component and ``keeper`` the rid of the row that stands for
    it: the one of smallest (key, rid), null keys last.  ``bands`` * ``rows`` coordinates find a pair of
    similarity s with probability 1 - (1 - s ** rows) ** bands.
    """
    spark = docs.sparkSession
    seen = sketch(docs, width, bands, rows, key)
    name = ["n_shingles", "set_a", "set_b"]
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid")).alias("first")
    classes = stage(seen.where("n_shingles > 0").groupBy(*name).agg(first), "classes").select(*name, "first", F.col("first.rid").alias("cid"))
    banded = seen.join(classes.select(F.col("cid").alias("rid")), "rid").select(F.col("rid").alias("cid"), "mark", "key", "n_shingles", F.posexplode("bands").alias("band", "value"))
    cells = stage(banded, "cells")

    # Buckets of two or more classes; of buckets with the same members one is enough.
    sums = cells.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    chosen = stage(sums.groupBy("n", "held", "x", "y").agg(F.min(F.struct("band", "value")).alias("at")).select("at.*", F.least(parts, "n").cast("int").alias("parts"), F.xxhash64("at.band", "at.value").alias("bucket")), "buckets")
    members = stage(cells.join(chosen, ["band", "value"]).select("bucket", "parts", "cid", "key", "mark"), "members")
    needed = members.select("cid", F.col("key").alias("n_key"), F.col("mark").alias("n_mark")).distinct()
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    # what grows with the corpus is never broadcast, however small it may look
    wanted = texts.join(needed.hint("merge"), F.col("key").eqNullSafe(F.col("n_key")) & (F.col("mark") == F.col("n_mark"))).select("cid", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(texts_of(batch), width)], pa.binary())], ["cid", "set"])

    sets = stage(arrow_map(wanted, full, "cid long, set binary"), "sets")
    own = members.withColumn("part", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("parts")).cast("int"))
    spread = own.select("bucket", "cid", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = spread.select("bucket", "cid", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pairs.join(sets, "cid").repartition(shuffles, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    roots = connected_components(stage(links(blocks, percent), "links").distinct())

    # Smallest key and its row for each component, then for each class, then for each row.
    rooted = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(*name, "first", F.coalesce("root", "cid").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    known = stage(rooted.join(best, "root").select(*name, "best"), "known")
    shown = seen.select("rid", "key", "mark", *name).join(known, name, "left")
    return shown.select(
        "rid", "key", "mark", "n_shingles",
        F.when(F.col("best").isNull(), F.col("key")).otherwise(F.col("best.key")).alias("component"),
        F.coalesce("best.rid", "rid").alias("keeper"),
    )


def keep(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns.

    Rows go back to documents by key and text; of rows that repeat both, the one stays whose columns, written as JSON, come first.
    """
    found = components(docs, key=key, **how)
    stay = found.where("rid = keeper").select(F.col("key").alias("to_key"), F.col("mark").alias("to_mark")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(key).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    out = rows.join(stay.hint("merge"), F.col("key").eqNullSafe(F.col("to_key")) & (F.col("mark") == F.col("to_mark")))
    if found.groupBy("key", "mark").count().where("count > 1").limit(1).count():
        out = out.groupBy("key", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.select("row.*")
