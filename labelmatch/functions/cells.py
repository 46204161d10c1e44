"""Vectors in cells around a few of them, and which cells a vector can have near ones in.

Between unit vectors the distance d = sqrt(2 - 2 cosine) is a metric. Every vector belongs to the nearest of
some reference vectors, and a cell has as radius the largest distance in it. By the triangle inequality a vector x has no
vector within b in a cell of center c and radius r if d(x, c) - r > b, so x need not visit that cell. Centers and radii are
known to all tasks: their number grows with the square root of the vectors' and is bounded.

Vectors that visit a cell are sent to it, where they stream past the cell's own vectors; a cell of more than
PIECE vectors is dealt out in pieces, so a place where a third of all vectors lie is no single task's. Pieces lie together
in lots of up to LOT vectors: a vector is sent once to each lot, whatever cells it visits there, so what is moved grows
with the lots and not with the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmatch.functions.storage import written
from labelmatch.functions.vectors import unit_rows

#: Vectors in a piece of a cell, vectors that stream past it at once, and the bound of the centers in number and bytes.
PIECE, SLICE, CENTERS, CENTER_BYTES = 2048, 1024, 16_384, 64 << 20
#: Vectors and bytes of a lot at most; shares of visiting vectors for each core, so that few lots keep all cores busy.
LOT, LOT_BYTES, SHARES = 32_768, 16 << 20, 4
#: Rows that a visiting vector's batch makes at once, and the room for rounding in distances.
MADE, ROOM = 50_000, 1e-6


def usable(df: DataFrame, vec: str, *ids: str) -> DataFrame:
    """The rows whose ids are not null and whose vector is neither null nor empty nor holds null or non-finite components."""
    good = F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    for i in ids:
        good = good & F.col(i).isNotNull()
    return df.where(good)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _apart(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of unit vectors; a zero vector is at distance zero of all."""
    return np.where(rows.any(axis=1)[:, None], np.sqrt(np.maximum(0.0, 2 - 2 * (rows @ centers.T))), 0.0)


class Cells:
    """``rows(lot, cell, id, grp, vec)`` with unit vectors, and the cells' centers, radii, sizes and pieces. Zero vectors have the last cell, which all visit."""

    def __init__(self, refs: DataFrame, id_col: str, group_col: str, vec_col: str):
        spark = refs.sparkSession
        source = usable(refs.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).cast("long").alias("grp"), F.col(vec_col).cast("array<double>").alias("vec")), "vec", "id", "grp")
        n, dim = source.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
        source = source.where(F.size("vec") == dim)
        number = max(1, min(int(np.ceil(np.sqrt(n) / 2)), CENTERS, CENTER_BYTES // (8 * dim)))
        drawn = source.where(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("id", F.lit("cells")), "id").limit(number).select("vec").toArrow()  # at most CENTERS
        self.dim = dim
        self.centers = np.unique(unit_rows(drawn.column("vec").combine_chunks()), axis=0) if len(drawn) else np.zeros((1, dim))
        shared = spark.sparkContext.broadcast(self.centers)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers = shared.value
            step = max(1, MADE * 20 // len(centers))
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    rows = unit_rows(part.column(2))
                    apart = _apart(rows, centers)
                    cell = np.where(rows.any(axis=1), apart.argmin(axis=1), len(centers))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(apart.min(axis=1)), part.column(0), part.column(1), _lists(rows)], names=["cell", "apart", "id", "grp", "vec"])

        held = written(source.mapInArrow(assign, "cell int, apart double, id long, grp long, vec array<double>"), "cells")
        told = held.groupBy("cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).toArrow().to_pylist()  # a row for each cell
        self.radii, self.sizes = np.full(len(self.centers) + 1, -np.inf), np.zeros(len(self.centers) + 1, np.int64)
        for row in told:
            self.radii[row["cell"]], self.sizes[row["cell"]] = row["radius"], row["n"]
        self.pieces = -(-self.sizes // PIECE)
        cores = spark.sparkContext.defaultParallelism
        most = max(PIECE, min(LOT, LOT_BYTES // (8 * dim), -(-n // (2 * cores))))
        self.lots = self._dealt(most)  # of the pieces, in order
        self.shares = max(1, -(-SHARES * cores // (int(self.lots.max(initial=0)) + 1)))
        ends = np.cumsum(self.pieces)
        lots = [(c, self.lots[end - k : end].tolist()) for c, (k, end) in enumerate(zip(self.pieces.tolist(), ends.tolist(), strict=True)) if k]
        held = held.join(F.broadcast(spark.createDataFrame(lots, "cell int, lots array<int>")), "cell")
        piece = F.pmod(F.xxhash64("id", "grp", "vec"), F.size("lots")).cast("int")
        self.rows = held.select(F.get("lots", piece).alias("lot"), "cell", "id", "grp", "vec")

    def _dealt(self, most: int) -> np.ndarray:
        """The lot of each piece: pieces that follow each other, of about ``most`` vectors together, one piece at least."""
        held = np.repeat(self.sizes // np.maximum(self.pieces, 1), self.pieces)
        lots, lot, room = [], -1, 0
        for n in held.tolist():
            lot, room = (lot, room - n) if n <= room else (lot + 1, most - n)
            lots.append(lot)
        return np.array(lots, np.int32)

    def visits(self, asked: DataFrame, need: float | None = None, beyond: float | None = None) -> DataFrame:
        """``asked(id, grp, bound, vec)`` once for each lot to visit, with ``lot`` and ``cells``, a cell for each of its pieces there; ``bound`` is a cosine distance, or null.

        With ``need``, the nearest cells that together hold so many vectors. Else all that can have a vector within the bound; of
        these, with ``beyond``, only those that are not among the nearest by ``need=beyond``, and where ``grp`` is
        0 or above, only cells from that number on.
        """
        shared = asked.sparkSession.sparkContext.broadcast((self.centers, self.radii, self.sizes, self.pieces, self.lots))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers, radii, sizes, pieces, lots = shared.value
            begins = np.cumsum(pieces) - pieces
            step = max(1, min(MADE // (int(lots.max(initial=0)) + 1), MADE * 20 // len(radii)))
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    rows = unit_rows(part.column(3))
                    apart = _apart(rows, centers)
                    near = np.zeros((len(rows), len(radii)), bool)
                    within = need if need is not None else beyond
                    if within is not None:
                        order = np.argsort(apart, axis=1, kind="stable")
                        before = np.cumsum(sizes[order], axis=1) - sizes[order]
                        np.put_along_axis(near, order, before < within, axis=1)
                    if need is None:
                        bound = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                        least = np.maximum(0.0, apart - radii[:-1] - ROOM)
                        can = np.isnan(bound)[:, None] | (least**2 / 2 <= bound[:, None]) | ~rows.any(axis=1)[:, None]
                        can = np.concatenate([can, np.ones((len(rows), 1), bool)], axis=1)
                        near = can & ~near
                        near &= np.arange(len(radii)) >= part.column(1).to_numpy(zero_copy_only=False)[:, None]
                    i, cell = np.nonzero(near & (sizes > 0))
                    several = pieces[cell]
                    i, cell = np.repeat(i, several), np.repeat(cell, several)
                    piece = np.arange(len(cell)) - np.repeat(np.cumsum(several) - several, several)
                    lot = lots[begins[cell] + piece]
                    starts = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (lot[1:] != lot[:-1]))) if len(i) else i
                    listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(i)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                    i = i[starts]
                    at_rows = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(lot[starts]), listed, *(part.column(c).take(at_rows) for c in (0, 1, 2)), _lists(rows[i])], names=["lot", "cells", "id", "grp", "bound", "vec"])

        source = usable(asked.select(F.col("id").cast("long").alias("id"), F.col("grp").cast("long").alias("grp"), F.col("bound").cast("double").alias("bound"), F.col("vec").cast("array<double>").alias("vec")), "vec", "id").where(F.size("vec") == self.dim)
        return source.mapInArrow(run, "lot int, cells array<int>, id long, grp long, bound double, vec array<double>")

    def meet(self, visits: DataFrame, pick: Callable, schema: str) -> DataFrame:
        """``pick(cell, ids, groups, bounds, row ids, row groups, similarities)`` for slices of the vectors that visit a cell; it gives arrays for ``schema``."""
        parts = int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        names = [part.split()[0] for part in schema.split(", ")]
        every = F.explode(F.sequence(F.lit(0), F.lit(self.shares - 1)))
        held = self.rows.select("lot", every.alias("share"), F.lit(0).alias("kind"), "cell", F.lit(None).cast("array<int>").alias("cells"), "id", "grp", F.lit(None).cast("double").alias("bound"), "vec")
        share = F.pmod(F.xxhash64("id", "vec"), F.lit(self.shares)).cast("int")
        came = visits.select("lot", share.alias("share"), F.lit(1).alias("kind"), F.get("cells", F.lit(0)).alias("cell"), "cells", "id", "grp", "bound", "vec")
        dealt = held.unionByName(came).repartition(parts, "lot", "share").sortWithinPartitions("lot", "share", "kind", "cell")

        def met(part: pa.RecordBatch, own: tuple[np.ndarray, ...]) -> Iterator[list[np.ndarray]]:
            ids, groups, bounds = part.column(5).to_numpy(), part.column(6).to_numpy(zero_copy_only=False), part.column(7).to_numpy(zero_copy_only=False).astype(float)
            vecs, cells, at = _matrix(part.column(8)), part.column(4).flatten().to_numpy(), np.repeat(np.arange(len(part)), part.column(4).value_lengths().to_numpy())
            order = np.argsort(cells, kind="stable")
            cells, at = cells[order], at[order]
            for c in np.unique(cells).tolist():
                start, stop = np.searchsorted(own[0], [c, c + 1])
                rows = np.unique(at[slice(*np.searchsorted(cells, [c, c + 1]))])
                if start < stop:
                    yield pick(c, ids[rows], groups[rows], bounds[rows], own[1][start:stop], own[2][start:stop], vecs[rows] @ own[3][start:stop].T)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, kept, own = None, [], None
            for batch in batches:
                marks = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
                edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
                for start, stop in zip(edges, edges[1:], strict=False):
                    if start == stop:
                        continue
                    *now, kind = marks[start].tolist()
                    if now != key:
                        key, kept, own = now, [], None
                    if not kind:
                        kept.append(batch.slice(start, stop - start))
                        continue
                    if own is None and kept:
                        whole = pa.Table.from_batches(kept).combine_chunks()
                        own = whole.column("cell").to_numpy(), whole.column("id").to_numpy(), whole.column("grp").to_numpy(), _matrix(whole.column("vec").combine_chunks())
                        kept = []
                    if own is None:
                        continue
                    for at in range(start, stop, SLICE):
                        for found in met(batch.slice(at, min(SLICE, stop - at)), own):
                            if len(found[0]):
                                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

        return dealt.mapInArrow(run, schema)
