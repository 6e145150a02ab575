"""Vectors of integers and exact products of them.

A float64 product of integers is exact while every partial sum stays below 2**53. Wider integers are cut into limbs of so few bits that this
holds for each pair of limbs; the products of the limbs are shifted and added as 64-bit integers, or as Python integers where the result
doesn't fit them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest double below 2**63: components outside are moved to the border.
_FAR = float(2**63 - 1024)


def finite(vector: Column) -> Column:
    """Whether the vector is there, not empty, and has neither null nor non-finite components."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def floors(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a long, x as a double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.least(F.greatest(F.floor(x * F.lit(float(scale))).cast("double"), F.lit(-_FAR)), F.lit(_FAR)).cast("long"))


def common_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length, the smaller of equals; 0 without rows."""
    sizes = vectors.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).first()
    return sizes["d"] if sizes else 0


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    """Lists of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def largest(x: np.ndarray) -> int:
    """The largest magnitude; the smallest long has none of its own kind."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """x is the sum of limb i times 2**(bits * i); the last limb is signed, the others lie in 0 to 2**bits - 1."""
    out, mask = [], (1 << bits) - 1
    while largest(x) > mask:
        out.append((x & mask).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products of the rows of x with the rows of y, exactly: 64-bit where every one must fit, else Python integers."""
    depth = max(1, x.shape[1])
    bits = (52 - depth.bit_length()) // 2
    bound = depth * largest(x) * largest(y)
    wide = bound >= 1 << 62
    total = np.zeros((len(x), len(y)), object if wide else np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(y, bits)):
            part = (a @ b.T).astype(np.int64)
            shift = bits * (i + j)
            total += part.astype(object) * (1 << shift) if wide else part << shift
    return total


def to_long(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers; what doesn't fit becomes the nearest that does."""
    return x if x.dtype == np.int64 else np.clip(x, -(2**63), 2**63 - 1).astype(np.int64)
