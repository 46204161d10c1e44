"""Which embeddings take part, shared by the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """True unless the vector is null, empty, zero, or holds null or non-finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length, in double precision."""
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def norms(rows: np.ndarray) -> np.ndarray:
    """Lengths; scaled first, so that tiny and huge components neither vanish nor overflow."""
    top = np.abs(rows).max(axis=1, initial=0)
    return top * np.sqrt(((rows / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / norms(rows)[:, None]


def typed(df: DataFrame, vec: str) -> DataFrame:
    """``df`` with ``vec`` as array<double>, or array<float> where it is one already."""
    return df if dict(df.dtypes)[vec] == "array<float>" else df.withColumn(vec, F.col(vec).cast("array<double>"))
