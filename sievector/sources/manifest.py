"""Encoded attributes on disk: the manifest, bucket numbers and bitmaps in their binary layout."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievector.functions.filters import Attribute
from sievector.sources.files import read_bytes, size_of, write_bytes


def write(path: str, attributes: list[Attribute], n_elements: int, dimension: int, buckets: int, factors: dict[str, int] | None = None) -> None:
    """The manifest as JSON, with paths relative to its folder."""
    items = []
    for a in attributes:
        used = len(a.categories) if not a.numeric else a.usable_bins
        item = {"key": a.key, "encoding": "numeric_minmax_quantized" if a.numeric else "categorical_sorted", "numeric": a.numeric, "used_bins": used, "usable_bins": a.usable_bins}
        item |= {"min_value": a.min_value, "max_value": a.max_value} if a.numeric else {"category_map": a.categories}
        items.append(item | {"fid_file": f"{a.key}.fid", "tb_file": f"{a.key}.tb"})
    text = json.dumps({"n_elements": n_elements, "nfilters": buckets, "dimension": dimension, **(factors or {}), "attributes": items}, indent=1)
    write_bytes(path, text.encode())


def write_log(path: str, steps: list[tuple[str, float, int]]) -> None:
    """The build log: one line a step with its name, seconds and rows, and their sum at the end."""
    lines = [f"{name}: {seconds:.3f} s, {rows} rows" for name, seconds, rows in steps]
    write_bytes(path, "\n".join([*lines, f"total: {sum(s for _, s, _ in steps):.3f} s", ""]).encode())


def read(path: str) -> tuple[dict, list[Attribute], dict[str, tuple[str, str]]]:
    """(header, attributes, files by key).  A missing key or file name is an error; category numbers that are no
    integers are skipped."""
    raw = json.loads(read_bytes(path))
    out, files, folder = [], {}, os.path.dirname(path if "://" in path else os.path.abspath(path))
    for item in raw.pop("attributes"):
        for need in ("key", "fid_file", "tb_file"):
            if not item.get(need):
                raise ValueError(f"an attribute of {path} has no {need}")
        names = {k: v for k, v in item.get("category_map", {}).items() if isinstance(v, int)}
        bins = item.get("usable_bins", max(1, raw["nfilters"] - 1))
        out.append(Attribute(item["key"], bool(item.get("numeric")), bins, item.get("min_value"), item.get("max_value"), names))
        files[item["key"]] = tuple(os.path.join(folder, item[n]) for n in ("fid_file", "tb_file"))
    return raw, out, files


def write_fid(path: str, buckets: np.ndarray) -> None:
    write_bytes(path, len(buckets).to_bytes(8, "little"), np.asarray(buckets, np.uint8).tobytes())


def read_fid(path: str) -> np.ndarray:
    data = np.frombuffer(read_bytes(path, 8), np.uint8)
    if len(data) != (n := int.from_bytes(read_bytes(path, 0, 8), "little")):
        raise ValueError(f"{path} should have {n} bytes, not {len(data)}")
    return data


def write_tb(path: str, bits: np.ndarray) -> None:
    """``bits`` is a boolean matrix, nodes by 256 buckets; bit b is in byte b // 8, place b % 8."""
    write_bytes(path, len(bits).to_bytes(8, "little"), np.packbits(bits, axis=1, bitorder="little").tobytes())


def read_tb(path: str) -> np.ndarray:
    data = np.frombuffer(read_bytes(path, 8), np.uint8)
    if len(data) != 32 * (n := int.from_bytes(read_bytes(path, 0, 8), "little")):
        raise ValueError(f"{path} should have {32 * n} bytes, not {len(data)}")
    return np.unpackbits(data.reshape(n, 32), axis=1, bitorder="little").astype(bool)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class BucketReader(DataSourceReader):
    """Byte ranges of a bucket file (one byte a row) or a bitmap file (32 bytes a row), each read by one task."""

    def __init__(self, options):
        self.path, self.width = options["path"], int(options["width"])
        self.rows = int.from_bytes(read_bytes(self.path, 0, 8), "little")
        if size_of(self.path) != 8 + self.rows * self.width:
            raise ValueError(f"{self.path} should have {self.rows * self.width} bytes, not {size_of(self.path) - 8}")
        self.each = max(1, int(options.get("rowsPerPartition", 1 << 20)))

    def partitions(self):
        return [_Range(i, min(i + self.each, self.rows)) for i in range(0, max(1, self.rows), self.each)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        for at in range(partition.start, partition.end, 1 << 16):
            end = min(at + (1 << 16), partition.end)
            data = np.frombuffer(read_bytes(self.path, 8 + at * self.width, (end - at) * self.width), np.uint8)
            if self.width == 1:
                row, bucket = np.arange(at, end), data
            else:
                row, bucket = np.nonzero(np.unpackbits(data.reshape(-1, self.width), axis=1, bitorder="little"))
                row = row + at
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(bucket.astype(np.int32))], ["vec_id", "bucket"])


class BucketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "buckets"

    def schema(self) -> str:
        return "vec_id bigint, bucket int"

    def reader(self, schema) -> DataSourceReader:
        return BucketReader(self.options)


def _table(spark: SparkSession, path: str, width: int, options: dict) -> DataFrame:
    spark.dataSource.register(BucketSource)
    return spark.read.format("buckets").options(width=width, **options).load(path)


def fid_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """(vec_id, bucket) of a bucket file, read by byte ranges."""
    return _table(spark, path, 1, options)


def tb_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """(vec_id, bucket) of the set bits of a bitmap file, read by byte ranges."""
    return _table(spark, path, 32, options)
