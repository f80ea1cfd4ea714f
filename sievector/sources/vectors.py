"""Vector files: records of a 32-bit dimension and that many elements, little-endian.

``.fvecs`` holds 32-bit floats, ``.bvecs`` unsigned bytes, ``.ivecs`` 32-bit integers.  The reader is a Spark data source
whose partitions are row ranges of one file, on a path or in a store that every machine sees.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievector.sources.files import open_fs, put_in_place, read_bytes, size_of

#: Element types by suffix; fixed values of the format.
KINDS = {".fvecs": ("<f4", "float"), ".bvecs": ("u1", "smallint"), ".ivecs": ("<i4", "int")}


class VectorFileError(ValueError):
    """A vector file that breaks the format."""


@dataclass(frozen=True)
class VectorFile:
    path: str
    dtype: str
    sql: str
    num: int
    dim: int

    @property
    def stride(self) -> int:
        return 4 + self.dim * np.dtype(self.dtype).itemsize


def inspect(path: str) -> VectorFile:
    """Rows and dimension from the header and the size; fails on a bad header or a size that isn't whole records."""
    suffix = os.path.splitext(path)[1]
    if suffix not in KINDS:
        raise VectorFileError(f"unknown vector file type {suffix!r}")
    dtype, sql = KINDS[suffix]
    size = size_of(path)
    if size < 4:
        raise VectorFileError(f"{path} is empty")
    dim = int(np.frombuffer(read_bytes(path, 0, 4), "<i4")[0])
    if dim <= 0:
        raise VectorFileError(f"{path} has dimension {dim}")
    found = VectorFile(path, dtype, sql, 0, dim)
    if size % found.stride:
        raise VectorFileError(f"{path} is cut short or has records of several sizes")
    return VectorFile(path, dtype, sql, size // found.stride, dim)


def read_rows(file: VectorFile, start: int, end: int) -> np.ndarray:
    """Rows [start, end) by one seek; fails where a record's dimension differs."""
    raw = np.frombuffer(read_bytes(file.path, start * file.stride, (end - start) * file.stride), np.uint8).reshape(-1, file.stride)
    if (raw[:, :4].copy().view("<i4") != file.dim).any():
        raise VectorFileError(f"{file.path} has records of several dimensions")
    return raw[:, 4:].copy().view(file.dtype)


class _Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class VectorReader(DataSourceReader):
    def __init__(self, options):
        self.file = inspect(options["path"])
        self.rows = max(1, int(options.get("rowsPerPartition", 1 << 18)))
        self.start = max(0, int(options.get("start", 0)))
        self.end = min(self.file.num, int(options.get("end", self.file.num)))

    def partitions(self):
        return [_Rows(i, min(i + self.rows, self.end)) for i in range(self.start, max(self.start + 1, self.end), self.rows)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        kind = {"float": pa.float32(), "smallint": pa.int16(), "int": pa.int32()}[self.file.sql]
        for at in range(partition.start, partition.end, 8192):
            rows = read_rows(self.file, at, min(at + 8192, partition.end))
            if len(rows):
                offsets = pa.array(np.arange(0, rows.size + 1, self.file.dim), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), kind))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(rows)), pa.int64()), lists], ["vec_id", "embedding"])


class VectorSource(DataSource):
    """``spark.read.format("vecs").load(path)``; options start, end and rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return f"vec_id bigint, embedding array<{inspect(self.options['path']).sql}>"

    def reader(self, schema) -> DataSourceReader:
        return VectorReader(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(VectorSource)
    return spark.read.format("vecs").options(**options).load(path)


def write(rows: DataFrame, path: str) -> int:
    """Write (vec_id, embedding) as one vector file in order of id, row by row from the sorted partitions;
    returns the rows.  A single file is the format's nature, so use it for query and ground-truth sets."""
    dtype, _ = KINDS[os.path.splitext(path)[1]]
    count = 0
    files, to = open_fs(path)
    with files.open_output_stream(to, compression=None) as f:
        for r in rows.orderBy("vec_id").select("embedding").toLocalIterator(prefetchPartitions=True):
            values = np.asarray(r[0]).astype(dtype)
            f.write(np.int32(len(values)).tobytes() + values.tobytes())
            count += 1
    return count


def write_parts(rows: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Write vector files from all tasks, one a partition, into a folder that all machines share; (path, first, num)."""
    dtype, _ = KINDS[suffix]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = open_fs(folder)
        name = f"part-{context.partitionId():05d}{suffix}"
        partial, first, count = f"{base}/.{name}.{context.taskAttemptId()}", None, 0
        files.create_dir(base, recursive=True)
        with files.open_output_stream(partial, compression=None) as f:
            for b in batches:
                for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    first = key if first is None else first
                    values = np.asarray(v).astype(dtype)
                    f.write(np.int32(len(values)).tobytes() + values.tobytes())
                    count += 1
        put_in_place(files, partial, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([first], pa.int64()), pa.array([count], pa.int64())], ["path", "first", "num"])

    return rows.select("vec_id", "embedding").mapInArrow(body, "path string, first long, num long")
