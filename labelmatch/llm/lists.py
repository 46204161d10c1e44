"""Inverted lists dealt out over tasks: a long list as pairs of chunks, none held whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmatch.functions.storage import written


def deal(rows: DataFrame, keys: list[str], member: str, chunk: int, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` by list, each list together and in order: ``keys``, then the chunks ``c`` and ``d``.

    A list of up to ``chunk`` rows is one piece. A longer one is cut into n chunks by a hash of ``member``, and each
    pair of chunks is a piece of its own; ``mine`` tells the rows of the first chunk, so that a piece of two
    chunks compares across them only. ``sizes(*keys, count)`` are the lists' numbers of rows, where they are known already.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(*keys).count() if sizes is None else sizes
    long = written(sizes.where(F.col("count") > chunk), "long-lists")
    cut = rows.join(long, keys, "left").withColumn("n", F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int")).drop("count")
    paired = cut.withColumn("m", F.pmod(F.xxhash64(member), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = paired.withColumns({"c": F.least("m", "other"), "d": F.greatest("m", "other"), "mine": F.col("m") <= F.col("other")}).drop("n", "m", "other")
    by = [*keys, "c", "d"]
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)


def walk(batches: Iterator[pa.RecordBatch], keys: list[str], handle: Callable[[pa.Table, list[tuple[int, int]]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``handle(rows, bounds)`` for whole pieces: their rows are ``rows[start:stop]`` for each of the bounds. One piece waits at a time."""
    held: list[pa.RecordBatch] = []
    names = [*keys, "c", "d"]

    def columns(part: pa.Table) -> list[np.ndarray]:
        return [part.column(k).to_numpy() if pa.types.is_integer(part.schema.field(k).type) else np.array(part.column(k).to_pylist(), object) for k in names]

    def whole(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in columns(part)], axis=0)) + 1
        bounds = list(zip([0, *change.tolist()], [*change.tolist(), len(part)], strict=True))
        yield from handle(part, [(s, e) for s, e in bounds if e - s > 1])

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        part = pa.Table.from_batches(held)
        cols = columns(part)
        same = np.all([k == k[-1] for k in cols], axis=0)
        cut = len(part) - int(same.sum())
        if cut:
            yield from whole(part.slice(0, cut))
        held = part.slice(cut).to_batches()
    if held:
        yield from whole(pa.Table.from_batches(held))


def sides(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to compare with each other: all with all where a piece is one chunk, else those of one chunk with those of the other."""
    every = np.arange(len(mine))
    return (every, every) if mine.all() else (every[mine], every[~mine])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n places that each is connected with by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the pairs (a, b) of n places, fewer than n, that connect what all of them connect."""
    reached = roots(n, a, b) == np.arange(n)
    keep_a, keep_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    while True:
        new = np.flatnonzero(reached[a] & ~reached[b])
        if not len(new):
            return np.concatenate(keep_a), np.concatenate(keep_b)
        _, first = np.unique(b[new], return_index=True)
        new = new[first]
        keep_a.append(a[new])
        keep_b.append(b[new])
        reached[b[new]] = True
