"""Embedding near-duplicates with a pivot-permutation index.

A bounded sample of vectors that are not like each other serves as pivots, twice the square root of the
vectors in number, so that lists stay short as a table grows. Each distinct vector is described by its nearest
pivots in order; the inverted lists are kept for pairs of pivots of which one is among the first LEAD in the
vector's order. So two vectors meet in a list if they share two of their nearest pivots and each has one of
these in front. Every list is verified by cosine in double precision; a pair counts in the first list it
shares only. Lists above ``CHUNK`` rows are dealt out as pairs of chunks, and a list yields, for each of its
vectors, how many links it has there and one edge to the smallest vector it is connected with: rows stay
linear in the vectors however large a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.functions.storage import written
from labelmatch.llm.lists import deal, roots, sides, walk
from labelmatch.llm.vectors import matrix, typed, unit, usable
from labelmatch.operators.components import connected_components

#: Pivots at least and at most, nearest pivots of a vector, how many of them lead, rows of a list that one task takes.
FEWEST, MOST, NEAREST, LEAD, CHUNK = 64, 8192, 7, 3, 2000
#: Cosine from which a sampled vector is too like a pivot to be one.
ALIKE = 0.8


def choose(rows: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` unit rows that are not like one before."""
    kept, free = [], np.ones(len(rows), bool)
    for i in range(len(rows)):
        if free[i] and len(kept) < n:
            kept.append(i)
            free[i + 1 :] &= rows[i + 1 :] @ rows[i] < ALIKE
    return rows[kept]


def describe(rows: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of each unit row, in order of nearness (ties: smaller number)."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :nearest]


def pairs_of(near: np.ndarray, lead: int) -> np.ndarray:
    """(rows, pairs, 2): the pairs of each row's pivots of which one is among its first ``lead``, the smaller pivot first."""
    i, j = np.triu_indices(near.shape[1], 1)
    i, j = i[i < lead], j[i < lead]
    return np.sort(np.stack([near[:, i], near[:, j]], axis=2), axis=2)


def _canonical(left: np.ndarray, right: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether the list ``here`` is the first that both are in; rows of ``left`` and ``right`` are numbers of lists in order."""
    first = np.ones(len(left), bool)
    for c in range(left.shape[1]):
        open_ = np.flatnonzero(first & (left[:, c] < here))  # like vectors share most of their lists, so few stay open
        if not len(open_):
            break
        first[open_] = ~(right[open_] == left[open_, c, None]).any(axis=1)
    return first


#: Rows of a list up to which many lists are looked at together.
FEW = 48


def _verify(part: pa.Table, bounds: list[tuple[int, int]], limit: float, lead: int) -> Iterator[pa.RecordBatch]:
    """For each vector of these lists: its links here, and the least vector it is connected with."""
    mine = part.column("mine").to_numpy(zero_copy_only=False)
    ids, mult = part.column("id").to_numpy(), part.column("mult").to_numpy()
    dims = part.column("vec").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def look(bounds: list[tuple[int, int]]) -> None:
        """Lists of vectors of one length, one after the other."""
        begin, end = bounds[0][0], bounds[-1][1]
        piece = part.slice(begin, end - begin)
        rows = unit(matrix(piece.column("vec").combine_chunks()))
        near = matrix(piece.column("near").combine_chunks()).astype(np.int64)
        pairs = pairs_of(near, lead) if near.shape[1] > 1 else np.repeat(near, 2, axis=1)[:, None, :]
        lists = np.sort(pairs[:, :, 0] << 32 | pairs[:, :, 1], axis=1)
        here = piece.column("p").to_numpy().astype(np.int64) << 32 | piece.column("q").to_numpy()

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            for at in range(0, len(i), 100_000):
                x, y = i[at : at + 100_000], j[at : at + 100_000]
                good = _canonical(lists[x], lists[y], here[x])
                out_a.append(x[good] + begin)
                out_b.append(y[good] + begin)

        ends, whole = np.zeros(end - begin, np.int64), np.zeros(end - begin, bool)
        for s, e in bounds:
            s, e = s - begin, e - begin
            if e - s <= FEW:
                ends[s:e], whole[s:e] = e, mine[begin + s : begin + e].all()
                continue
            left, right = sides(mine[begin + s : begin + e])
            i, j = np.nonzero(rows[s + left] @ rows[s + right].T >= limit)
            i, j = left[i], right[j]
            once = i < j if mine[begin + s : begin + e].all() else i != j
            keep(s + i[once], s + j[once])
        for d in range(1, FEW):  # each row of a short list with the next, the one after that, and so on
            i = np.flatnonzero(np.arange(end - begin) + d < ends)
            if not len(i):
                break
            i = i[whole[i] | (mine[begin + i] != mine[begin + i + d])]
            i = i[(rows[i] * rows[i + d]).sum(axis=1) >= limit]
            keep(i, i + d)

    at = 0
    while at < len(bounds):
        stop = at + 1
        while stop < len(bounds) and dims[bounds[stop][0]] == dims[bounds[at][0]]:
            stop += 1
        look(bounds[at:stop])
        at = stop
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    if len(a):
        every, at = np.unique(ids, return_inverse=True)
        found = np.bincount(at[a], mult[b], len(every)) + np.bincount(at[b], mult[a], len(every))
        root = roots(len(every), at[a], at[b])
        hit = found > 0
        yield pa.RecordBatch.from_arrays([pa.array(every[hit]), pa.array(every[root[hit]]), pa.array(found[hit].astype(np.int64))], names=["u", "v", "links"])


def links(reps: DataFrame, limit: float, n_pivots: int | None = None, nearest: int = NEAREST, lead: int = LEAD, chunk: int = CHUNK) -> DataFrame:
    """``reps(id, label string, mult, vec)`` of distinct vectors -> ``(u, v, links)``: links of u found in a list, and an edge u - v.

    ``n_pivots``: by default twice the square root of the vectors of a length, FEWEST to MOST; beyond MOST lists grow, and long ones are dealt out in chunks.
    """
    spark = reps.sparkSession
    sizes = reps.groupBy(F.size("vec").alias("dim")).count().collect()  # a row for each length of vector
    pivots = {}
    for row in sizes:
        n = n_pivots or int(min(MOST, max(FEWEST, 2 * row["count"] ** 0.5)))
        sample = reps.where(F.size("vec") == row["dim"]).select("vec").orderBy(F.xxhash64("id", F.lit("pivots")), "id").limit(2 * n).toArrow()
        pivots[row["dim"]] = choose(unit(matrix(sample.column("vec").combine_chunks())), n)
    shared = spark.sparkContext.broadcast(pivots)  # MOST vectors of each length at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec")
            lengths = vecs.value_lengths().to_numpy(zero_copy_only=False)
            near: list = [None] * len(batch)
            lists: list = [None] * len(batch)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                found = describe(unit(matrix(vecs.take(pa.array(at)))), shared.value[dim], nearest)
                pairs = pairs_of(found, lead) if found.shape[1] > 1 else np.repeat(found, 2, axis=1)[:, None, :]  # one pivot: one list of all
                for i, row, mine in zip(at.tolist(), found.tolist(), pairs.tolist(), strict=True):
                    near[i], lists[i] = row, [{"p": a, "q": b} for a, b in mine]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32())), pa.array(lists, kind)], names=[*batch.schema.names, "near", "pq"])

    kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32())]))
    schema = T.StructType([*reps.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType())), T.StructField("pq", T.ArrayType(T.StructType().add("p", "integer").add("q", "integer")))])
    described = written(reps.mapInArrow(place, schema), "pivot-described")
    posted = described.withColumn("pq", F.explode("pq")).select("label", "pq.p", "pq.q", "id", "mult", "near", "vec")
    keys = ["label", "p", "q"]
    return deal(posted, keys, "id", chunk).mapInArrow(lambda b: walk(b, keys, lambda part, bounds: _verify(part, bounds, limit, lead)), "u long, v long, links long")


def near_duplicates(vectors: DataFrame, limit: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", **index) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for each row of ``vectors``.

    Vectors are compared if their labels are equal and not null, and their lengths equal. Rows
    with a null label, or a vector that is null, zero or holds null or non-finite components,
    link with nothing. Exact copies, repeated rows among them, are linked with each other and
    searched once. A null id is a component of its own; no rows give no rows; further columns are ignored.
    """
    rows = typed(vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec")), "vec")
    able = rows.where(usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("label", F.concat_ws("/", F.size("vec").cast("string"), "label"))
    keyed = able.withColumn("copy", F.md5(F.concat_ws(" ", "label", F.col("vec").cast("string"))))
    reps = written(keyed.groupBy("copy").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("vec").alias("vec")), "pivot-reps")
    found = written(links(reps.select("id", "label", "mult", "vec"), limit, **index), "pivot-links")
    totals = found.groupBy("u").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("u", "v"))
    known = reps.select("copy", "id", "mult").join(totals, F.col("id") == F.col("u"), "left").join(parts, F.col("id") == F.col("node"), "left")
    named = known.select("copy", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = keyed.select("id", "copy").join(named, "copy").select("id", "n_links", "component_id")
    able_too = usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull()
    alone = rows.where(~able_too).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op7_near_embeddings(vectors: DataFrame) -> DataFrame:
    out = near_duplicates(vectors)
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), "kept")


