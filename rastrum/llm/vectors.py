"""What both vector operators need: usable vectors, and the same for Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_rule(vectors: DataFrame) -> Column:
    """Which rows of (vec_id, embedding) take part: no null, NaN or infinite component, not all zero, a
    non-null id, and the commonest length (the largest of equally common ones). Never null itself."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False)))
    some = F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    good = F.coalesce(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & some, F.lit(False))
    sizes = vectors.where(good).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good & F.coalesce(F.size(v) == (sizes["d"] if sizes else 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray | list, kind: type = np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
        return flat.astype(kind).reshape(len(column), -1)
    return np.stack([np.asarray(x, kind) for x in column])


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision times powers of two, which changes no cosine, so that no square over- or underflows."""
    x = x.astype(np.float64)
    power = np.frexp(np.abs(x).max(1, initial=0))[1]
    return x if not len(x) or np.abs(power).max() < 400 else np.ldexp(x, -power[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = scaled(a), scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
