"""Distances between arrays, as columns and as numpy blocks.  All sums are in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; no root is taken."""
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    """One minus the dot product."""
    return F.lit(1.0) - _fold(a, b, lambda x, y: x * y)


def l2_sq_int(a: Column, b: Column) -> Column:
    """Squared distance of integer vectors (bytes read as small integers), in whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


COLUMNS = {"l2": l2_sq, "ip": inner_product, "l2_int": l2_sq_int}


def block(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all pairs of a block, by one matrix product; near zero the identity loses digits,
    so callers recompute what they keep with ``pairs``."""
    out = queries @ rows.T
    if metric == "ip":
        return np.subtract(1.0, out, out=out)
    out *= -2
    out += (queries * queries).sum(1)[:, None]
    out += (rows * rows).sum(1)[None, :]
    return out


def rounding(queries: np.ndarray, rows: np.ndarray) -> float:
    """How far ``block`` may be off: a share of the largest value that it can have or sum up."""
    most = lambda x: float((x * x).sum(1).max(initial=0.0))
    return 1e-9 * (1 + 2 * (most(queries) + most(rows)))


def pairs(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``."""
    return 1.0 - (a * b).sum(-1) if metric == "ip" else ((a - b) ** 2).sum(-1)
