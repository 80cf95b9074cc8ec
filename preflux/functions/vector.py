"""Dense vectors in array<double> columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def unit(a: Column) -> Column:
    """Divided by the norm; a zero vector stays."""
    n = F.sqrt(squared_norm(a))
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.greatest(squared_norm(a) + squared_norm(b) - 2 * dot(a, b), F.lit(0.0))


def rbf(a: Column, b: Column, length_scale: float, variance: float) -> Column:
    if length_scale <= 0 or variance <= 0:
        raise ValueError("length_scale and variance must be positive")
    return variance * F.exp(-squared_distance(a, b) / (2.0 * length_scale**2))


def hash_unit(*parts: Column, place: int = 1) -> Column:
    """A number in (0, 1) from the hex digits of an md5 at ``place``: the same under any partitioning."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), place, 8)
    return (F.conv(digits, 16, 10).cast("double") + 1) / 4294967297.0


def hash_normal(*parts: Column) -> Column:
    """A standard normal number by Box and Muller from two hash numbers."""
    return F.sqrt(-2 * F.ln(hash_unit(*parts))) * F.cos(2 * F.pi() * hash_unit(*parts, place=9))


def batch_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix, without a copy of each row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)
