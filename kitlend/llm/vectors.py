"""Whole-number vectors for operators 11 and 12: their components, read from
Arrow list columns as matrices, and the size check that keeps 64-bit sums exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a block of rows that a task works on at once.
BLOCK_NUMBERS = 1 << 18


def usable(x: Column) -> Column:
    """Whether a vector is there and holds neither null nor non-finite components."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad, F.lit(False))


def floored(x: Column, scale: int) -> Column:
    """The components as floor(scale * x); beyond 32 bits is an error."""
    def one(v: Column) -> Column:
        y = F.floor(v.cast("double") * scale)
        return F.when(F.abs(v.cast("double")) * scale < 2 ** 31, y.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component is beyond 2^31 / {scale}")).cast("int"))
    return F.transform(x, one)


def extent(q: DataFrame) -> tuple[int, int]:
    """The largest length and the largest absolute component of column q."""
    top = F.array_max(F.transform("q", lambda v: F.abs(v.cast("long"))))
    row = q.agg(F.max(F.size("q")).alias("width"), F.max(top).alias("top")).first()
    return int(row["width"] or 0), int(row["top"] or 0)


def check_exact(width: int, top: int) -> None:
    """Squared distances of vectors of this extent must fit into 63 bits."""
    if width * (2 * top + 1) ** 2 >= 2 ** 63:
        raise ValueError(f"{width} components of up to {top}: squared distances would leave 64 bits")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix, missing trailing components 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == n * width:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        if (sizes == width).all():
            return flat.astype(np.int64).reshape(n, width)
    out = np.zeros((n, width), np.int64)
    at = 0
    for i, size in enumerate(column.value_lengths().to_pylist()):
        out[i, :size] = flat[at:at + size]
        at += size
    return out


def row_blocks(n: int, width: int):
    """Ranges of rows with at most BLOCK_NUMBERS numbers each (one row at least)."""
    step = max(1, BLOCK_NUMBERS // max(width, 1))
    return ((a, min(a + step, n)) for a in range(0, n, step))
