"""Arrow batches in pieces of bounded size, for operators that run numpy or Python code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

#: Rows and text bytes that a worker holds at once.
MAX_ROWS, MAX_BYTES = 2048, 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``MAX_ROWS`` rows and, single rows apart, ``most`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, held = 0, 0
        at = batch.schema.get_field_index(column)
        sizes = [0] * batch.num_rows if at < 0 else pa.compute.binary_length(batch.column(at)).to_pylist()
        for i, size in enumerate(sizes):
            size = size or 0
            if i > start and (held + size > most or i - start >= MAX_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def arrow_map(df: DataFrame, body: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(body, schema)
