"""Near-duplicate products: pairs above a similarity, clusters, and an audit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmatch import config as C
from labelmatch.functions.cells import Cells, usable
from labelmatch.functions.storage import written
from labelmatch.functions.vectors import l2_normalize
from labelmatch.operators.components import connected_components


def _close(cell, own_ids, own_cells, ids, sims, least):
    """Which pairs of a visit are similar enough; within a cell each pair is met once, from the smaller id, and a row of the same id is no partner."""
    mask = sims >= least
    i, j = np.nonzero(mask)  # few: the ids of the others are not looked at
    mask[i, j] = np.where(own_cells[i] == cell, own_ids[i] < ids[j], own_ids[i] != ids[j])
    return mask


def _visits(cells: Cells, least: float) -> DataFrame:
    """Each vector visits the cells from its own on that can hold one of the similarity."""
    return cells.visits(cells.rows.select("id", F.col("cell").alias("grp"), F.lit(1 - least).alias("bound"), "vec"))


def _cells(refs: DataFrame) -> Cells:
    return Cells(refs.where(F.exists("vec", lambda x: x != 0)), "product_id", "product_id", "vec")


def similar_pairs(refs: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """``refs(product_id, vec)`` -> ``(p1, p2, similarity)`` with p1 < p2 and similarity >= least, exact; by the triangle inequality cells without such pairs are skipped.

    With ``most``, pairs of a visit that can't be among so many most similar ones are left out. Null ids and vectors, and
    those with null or non-finite components or zeros only, have no pairs.
    """

    def pick(cell, own_ids, own_cells, _, ids, __, sims):
        i, j = np.nonzero(_close(cell, own_ids, own_cells, ids, sims, least))
        values = sims[i, j]
        if most is not None and len(values) > most:
            kept = np.flatnonzero(values >= np.partition(values, -most)[-most])
            i, j, values = i[kept], j[kept], values[kept]
        return np.minimum(own_ids[i], ids[j]), np.maximum(own_ids[i], ids[j]), values

    cells = _cells(refs)
    return cells.meet(_visits(cells, least), pick, "p1 long, p2 long, similarity double")


def spanning(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``mask`` that connect the rows and columns which all of its places connect, without a ring."""
    rows, cols = mask.any(axis=1), mask.any(axis=0)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while rows.any():
        front = np.flatnonzero(rows)[:1]
        rows[front] = False
        while len(front):
            new = np.flatnonzero(cols & mask[front].any(axis=0))
            a.append(front[mask[np.ix_(front, new)].argmax(axis=0)])
            b.append(new)
            cols[new] = False
            front = np.flatnonzero(rows & mask[:, new].any(axis=1))
            a.append(front)
            b.append(new[mask[np.ix_(front, new)].argmax(axis=1)] if len(front) else new[:0])
            rows[front] = False
    return np.concatenate(a), np.concatenate(b)


def linking_pairs(refs: DataFrame, least: float) -> DataFrame:
    """Some of ``similar_pairs``: enough to connect all that these connect, and the most similar one of each product.

    Products of equal vectors are one vector, its copies linked to the smallest of them: k copies give k - 1 pairs. A visit
    gives pairs without rings, and each vector's most similar partner, so no more than three for each of its vectors.
    """

    def pick(cell, own_ids, own_cells, _, ids, __, sims):
        mask = _close(cell, own_ids, own_cells, ids, sims, least)
        u, v = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        own_ids, ids, mask, sims = own_ids[u], ids[v], mask[np.ix_(u, v)], sims[np.ix_(u, v)]
        i, j = spanning(mask)
        if len(u):
            best = np.where(mask, sims, -np.inf)
            i, j = np.concatenate([i, np.arange(len(u)), best.argmax(axis=0)]), np.concatenate([j, best.argmax(axis=1), np.arange(len(v))])
        return np.minimum(own_ids[i], ids[j]), np.maximum(own_ids[i], ids[j]), sims[i, j]

    known = usable(refs.select(F.col("product_id").cast("long").alias("product_id"), F.col("vec").cast("array<double>").alias("vec")), "vec", "product_id").where(F.exists("vec", lambda x: x != 0))
    first = written(known.groupBy("vec").agg(F.min("product_id").alias("first"), F.count("*").alias("n")), "twin-vectors")
    copies = known.join(first.where("n > 1"), "vec").where("product_id <> first").select(F.col("first").alias("p1"), F.col("product_id").alias("p2"), F.lit(1.0).alias("similarity"))
    cells = _cells(first.select(F.col("first").alias("product_id"), "vec"))
    return cells.meet(_visits(cells, least), pick, "p1 long, p2 long, similarity double").unionByName(copies)


def cells_skipped(refs: DataFrame, least: float) -> DataFrame:
    """``(vectors, cells, visits, skipped)``: of all vectors with the cells from their own on, how many visits the triangle inequality leaves, and the share it spares."""
    cells = _cells(refs)
    made = _visits(cells, least).agg(F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("visits"))
    number = np.arange(len(cells.sizes))
    every = int((cells.sizes * np.array([cells.pieces[c:].sum() for c in number])).sum())
    return made.select(F.lit(int(cells.sizes.sum())).alias("vectors"), F.lit(int((cells.sizes > 0).sum())).alias("cells"), "visits", (1 - F.col("visits") / max(1, every)).alias("skipped"))


def twin_pairs(refs: DataFrame, least: float = C.TWIN_SIMILARITY, limit: int = C.TWIN_LIMIT) -> DataFrame:
    """The ``limit`` most similar pairs, ties by their ids."""
    if not 0 < least <= 0.999 or not 10 <= limit <= 5000:
        raise ValueError("least must be in (0, 0.999], limit 10 to 5000")
    return similar_pairs(refs, least, limit).orderBy(F.desc("similarity"), "p1", "p2").limit(limit)


def twin_clusters(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """Connected products: ``(cluster_id, size, max_similarity, manufacturer, members)``.

    ``pairs`` need only connect each cluster and hold its most similar pair (``linking_pairs``). The id is the smallest member. Members without a product are dropped, then clusters below two.
    The manufacturer is the one most members share, ties to the first by name; members are in order of title.
    """
    parts = connected_components(pairs.select(F.col("p1").alias("u"), F.col("p2").alias("v")))
    known = parts.join(products.select(F.col("product_id").alias("node"), "title", "manufacturer"), "node")
    best = pairs.join(parts, F.col("p1") == F.col("node")).groupBy("component").agg(F.max("similarity").alias("similarity"))
    makers = known.groupBy("component", "manufacturer").count()
    maker = makers.groupBy("component").agg(F.min(F.struct((-F.col("count")).alias("n"), "manufacturer")).alias("m"))
    named = known.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("title", "node"))), lambda s: s["node"].cast("string")), ",").alias("members"))
    joined = named.where("size >= 2").join(best, "component").join(maker, "component")
    top = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("similarity"))), 4)
    return joined.select(F.col("component").alias("cluster_id"), "size", top.alias("max_similarity"), F.coalesce("m.manufacturer", F.lit("unknown")).alias("manufacturer"), "members")


def twin_members(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """``(cluster_id, product_id, title, manufacturer)``, a row for each member of a cluster of two or more: no cluster is gathered."""
    known = connected_components(pairs.select(F.col("p1").alias("u"), F.col("p2").alias("v"))).join(products.select(F.col("product_id").alias("node"), "title", "manufacturer"), "node")
    large = known.groupBy("component").count().where("count >= 2").select("component")
    return known.join(large, "component").select(F.col("component").alias("cluster_id"), F.col("node").alias("product_id"), "title", "manufacturer")


def near_duplicate_audit(refs: DataFrame, products: DataFrame, least: float = C.AUDIT_SIMILARITY) -> DataFrame:
    """All pairs at or above ``least`` of each product's first vector, with whether they share a manufacturer."""
    first = refs.groupBy("product_id").agg(F.min(F.struct("vector_id", "vec")).alias("v")).select("product_id", "v.vec")
    pairs = similar_pairs(first, least)
    side = lambda n: products.select(F.col("product_id").alias(f"p{n}"), F.col("title").alias(f"title{n}"), F.col("manufacturer").alias(f"maker{n}"))
    return pairs.join(side(1), "p1").join(side(2), "p2").withColumn("same_manufacturer", F.col("maker1").eqNullSafe(F.col("maker2")))


#: Most vectors of a bucket on one side of a comparison, and vectors of a group of buckets.
PIECE, LOT = 2048, 8192
#: Comparisons in a matrix product that cost as much as a vector on its way through a shuffle: in columns, sorted, on disk and over the network.
MOVED = 4000


def signature_plan(n: int, least: float, recall: float = 0.95, most_bits: int = 40) -> tuple[int, int]:
    """(bits, tables) of sign signatures that bring a pair of similarity ``least`` together with probability ``recall`` at the least cost for ``n`` vectors; no bits where comparing all costs less.

    A plane parts two vectors with probability angle / pi. A table costs its n rows, each moved with its vector (about MOVED comparisons) as often as its buckets have pieces, and the pairs of unlike vectors that meet in it, n^2 / 2^(bits + 1).
    """
    same = 1 - np.arccos(np.clip(least, -1, 1)) / np.pi
    plans = [(n * n / 2.0, 0, 1)]
    for bits in range(1, most_bits + 1):
        together = min(same**bits, 1 - 1e-12)
        tables = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-together))))
        plans.append((tables * (MOVED * n * np.ceil(max(1.0, n / 2.0**bits / PIECE)) + n * n / 2.0 ** (bits + 1)), bits, tables))
    return min(plans)[1:]


def approx_twin_pairs(refs: DataFrame, least: float, recall: float = 0.95, seed: int = 1) -> DataFrame:
    """The pairs of ``similar_pairs`` by signatures: those that agree in all signs of some table meet, cosine decides; a pair may be missed with probability 1 - ``recall`` at most.

    For similarities of 0.8 and more: few tables of many bits do then. Below about 0.6 nearly unlike vectors meet too, and so many tables are
    needed that moving the vectors into them costs more than comparing all: where ``signature_plan`` says so, all pairs are found.
    Null ids and vectors, and those with null or non-finite components or zeros only, have no pairs; all vectors have one length.
    """
    known = usable(refs.select(F.col("product_id").cast("long").alias("product_id"), F.col("vec").cast("array<double>").alias("vec")), "vec", "product_id").where(F.exists("vec", lambda x: x != 0))
    rows = written(known.select("product_id", l2_normalize(F.col("vec")).alias("vec")), "twin-units")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    bits, tables = signature_plan(size.n, least, recall)
    if not bits:
        return similar_pairs(rows, least).groupBy("p1", "p2").agg(F.max("similarity").alias("similarity"))

    def sign(parts):
        planes = np.random.default_rng(seed).standard_normal((size.dim or 0, tables * bits))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for part in parts:
            keys = ((np.stack(part["vec"]) @ planes > 0).reshape(len(part), tables, bits) * weights).sum(axis=2) if len(part) else []
            part["keys"] = list(keys)
            yield part

    signed = written(rows.mapInPandas(sign, "product_id long, vec array<double>, keys array<long>").select("product_id", "vec", F.posexplode("keys").alias("t", "key")), "twin-signatures")
    pieces = F.ceil(F.col("count") / PIECE)
    sizes = written(signed.groupBy("t", "key").count().where("count > 1").withColumn("pieces", pieces), "twin-buckets")
    lots = -(-(sizes.agg(F.sum(F.col("count") * F.col("pieces"))).first()[0] or 1) // LOT)
    dealt = signed.join(sizes, ["t", "key"]).withColumn("a", F.pmod(F.xxhash64("product_id"), "pieces")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    cells = dealt.select("product_id", "vec", "t", "key", "a", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))

    def meet(part):
        part = part.sort_values(["t", "key", "low", "high"], kind="stable")
        cell = part[["t", "key", "low", "high"]].to_numpy()
        ends = np.flatnonzero(np.append((cell[1:] != cell[:-1]).any(axis=1), True)) + 1
        ids, vecs, piece = part["product_id"].to_numpy(), np.stack(part["vec"]), part["a"].to_numpy()
        out = [np.empty((2, 0), np.int64)], [np.empty(0)]
        for begin, end in zip(np.append(0, ends[:-1]), ends):
            at = np.arange(begin, end)
            one, two = at[piece[at] == cell[begin, 2]], at[piece[at] == cell[begin, 3]]
            sims = vecs[one] @ vecs[two].T
            i, j = np.nonzero((sims >= least) & ((ids[one][:, None] < ids[two][None, :]) if cell[begin, 2] == cell[begin, 3] else (ids[one][:, None] != ids[two][None, :])))
            found = np.stack([ids[one][i], ids[two][j]])
            out[0].append(np.stack([found.min(axis=0), found.max(axis=0)]))
            out[1].append(sims[i, j])
        pairs = np.concatenate(out[0], axis=1)
        return pd.DataFrame({"p1": pairs[0], "p2": pairs[1], "similarity": np.concatenate(out[1])})

    met = cells.withColumn("lot", F.pmod(F.xxhash64("t", "key", "low", "high"), F.lit(lots))).groupBy("lot").applyInPandas(meet, "p1 long, p2 long, similarity double")
    return met.groupBy("p1", "p2").agg(F.max("similarity").alias("similarity"))


def twin_recall(refs: DataFrame, least: float, recall: float = 0.95) -> DataFrame:
    """``(least, exact, found, recall)``: how many of the exact pairs the signatures find; null recall where there are none."""
    pairs = lambda df: df.select("p1", "p2").distinct()
    exact = pairs(similar_pairs(refs, least)).join(pairs(approx_twin_pairs(refs, least, recall)).withColumn("met", F.lit(1)), ["p1", "p2"], "left")
    return exact.agg(F.count("*").alias("exact"), F.count("met").alias("found")).select(F.lit(least).alias("least"), "exact", "found", (F.col("found") / F.nullif("exact", F.lit(0))).alias("recall"))
