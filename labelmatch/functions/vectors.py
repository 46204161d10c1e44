"""Vectors as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision; the small path, and the check of the block path."""
    return 1 - dot(a, b) / (norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    length = F.greatest(norm(v), F.lit(1e-9))
    return F.transform(v, lambda x: x / length)


def average_views(views: DataFrame, key: str, vec: str) -> DataFrame:
    """One unit vector for each key: the mean of its views, left as it is where the mean is zero."""
    mean = views.select(key, F.posexplode(vec)).groupBy(key, "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    joined = mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vec))
    return joined.withColumn(vec, F.when(norm(F.col(vec)) > 0, F.transform(vec, lambda x: x / norm(F.col(vec)))).otherwise(F.col(vec)))


def check_dimension(df: DataFrame, vec: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the right length, and the rest."""
    good = F.coalesce(F.size(vec) == dim, F.lit(False))
    return df.where(good), df.where(~good)


def embed_in_batches(df: DataFrame, embed: Callable[[list], np.ndarray], source: str, dim: int, to: str = "embedding", batch: int = 32) -> DataFrame:
    """A caller's model over chunks of ``batch`` rows; its vectors are normalised, and their length is checked."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            items = part.column(part.schema.get_field_index(source)).to_pylist()
            out = []
            for at in range(0, len(items), batch):
                rows = np.asarray(embed(items[at : at + batch]), float)
                if rows.shape != (len(items[at : at + batch]), dim):
                    raise ValueError(f"the model gave {rows.shape}, not vectors of {dim}")
                out += (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).tolist()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float64()))], names=[*part.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.DoubleType()))]))


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length as a matrix of unit rows."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
