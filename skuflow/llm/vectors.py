"""Integer vectors of the embedding operators: floor(256 * x) of whole, finite vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def finite(vector: Column) -> Column:
    """True where the vector is there and none of its components is null, NaN or infinite."""
    top = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < top))


def integers(df: DataFrame, vector: str, limit: int, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; a component beyond ``limit`` is an error, as sums would leave a long."""
    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) <= limit, y.cast("long")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond {limit}")).cast("long"))
    return F.transform(df[vector], one)


def limit_for(terms: int) -> int:
    """Largest m with terms * m * m in a long."""
    return math.isqrt((2 ** 63 - 1) // max(terms, 1))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(flat) == len(column) * width:      # the same total is the same length each only if none is longer
        sizes = np.diff(column.offsets.to_numpy())
        if not len(sizes) or (sizes == width).all():
            return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(len(column)), sizes)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = flat
    return out


def exact(a: np.ndarray, terms: int, *others: np.ndarray) -> type:
    """float64 where sums of ``terms`` products of entries are exact in it, else int64."""
    top = max([int(np.abs(x).max(initial=0)) for x in (a, *others)])
    return np.float64 if terms * (2 * top) ** 2 < 2 ** 53 else np.int64
