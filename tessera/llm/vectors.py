"""Integer vectors of the exact vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a list of doubles has neither null nor non-finite components."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component x, as double, of the rows whose vector is sound."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where("e is not null")
    return rows.where(sound(F.col("e"))).select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """Lists of longs as rows, padded with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix of longs as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).reshape(-1)))
