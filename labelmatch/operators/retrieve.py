"""Exact nearest neighbours of all queries: best vector a product, votes, scopes, similarities.

``queries(query_id, vec)`` and ``refs(vector_id, product_id, vec)``; ids are longs. References lie in cells around some of
them. In a first round each query visits the nearest cells, whose vectors give a distance that its k-th best can't exceed;
in a second one only the cells that can hold something within that distance. Each visit keeps the best vector of each
product, so what is shuffled is one row for each query, product and visited piece at most.

Queries and references with null ids or vectors, or null or non-finite components, and those of another length than the longest
references', take no part (``check_dimension`` finds them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.functions.cells import SLICE, Cells
from labelmatch.functions.storage import written
from labelmatch.functions.vectors import unit_rows


def _open(q_ids, bounds, v_ids, sims):
    """Similarities without a query's own vector and what lies beyond its bound."""
    out = (q_ids[:, None] == v_ids[None, :]) | (1 - sims > np.where(np.isnan(bounds), np.inf, bounds + 1e-9)[:, None])
    return np.where(out, -np.inf, sims)


def _best_in_cell(_, q_ids, __, bounds, v_ids, products, sims):
    """The nearest vector of each product for each query, ties to the smaller vector id."""
    sims = _open(q_ids, bounds, v_ids, sims)
    order = np.lexsort((v_ids, products))
    products, v_ids, sims = products[order], v_ids[order], sims[:, order]
    starts = np.flatnonzero(np.append(True, products[1:] != products[:-1]))
    best = np.maximum.reduceat(sims, starts, axis=1)
    first = np.where(sims == np.repeat(best, np.diff(np.append(starts, len(products))), axis=1), np.arange(len(products)), len(products))
    at = np.minimum.reduceat(first, starts, axis=1)
    q, p = np.nonzero(best > -np.inf)
    return q_ids[q], products[starts][p], v_ids[at[q, p]], 1 - best[q, p]


_FOUND = "query_id long, product_id long, vector_id long, distance double"


def _nearest_in_cell(pool: int):
    """The ``pool`` nearest vectors of each query, ties to the smaller vector id."""

    def pick(_, q_ids, __, bounds, v_ids, products, sims):
        sims = _open(q_ids, bounds, v_ids, sims)
        order = np.lexsort((np.broadcast_to(v_ids, sims.shape), -sims), axis=1)[:, :pool]
        q = np.repeat(np.arange(len(q_ids)), order.shape[1])
        v = order.reshape(-1)
        keep = sims[q, v] > -np.inf
        q, v = q[keep], v[keep]
        return q_ids[q], products[v], v_ids[v], 1 - sims[q, v]

    return pick


def _best(found: DataFrame) -> DataFrame:
    best = F.min(F.struct("distance", "vector_id")).alias("best")
    return found.groupBy("query_id", "product_id").agg(best).select("query_id", "product_id", "best.vector_id", "best.distance")


class Search:
    """Queries against the cells of ``refs``."""

    def __init__(self, queries: DataFrame, refs: DataFrame):
        self.cells = Cells(refs, "vector_id", "product_id", "vec")
        self.asked = queries.select(F.col("query_id").cast("long").alias("id"), F.lit(-1).alias("grp"), F.lit(None).cast("double").alias("bound"), "vec")

    def rounds(self, need: int, bounds_of: Callable[[DataFrame], DataFrame], pick: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
        """The visits of the second round, and what both rounds found; ``bounds_of`` what the first one found is ``(query_id, bound)``."""
        first = written(self.cells.meet(self.cells.visits(self.asked, need=need), pick, schema), "first-round")
        bounds = bounds_of(first).select(F.col("query_id").alias("id"), "bound")
        visits = self.cells.visits(self.asked.drop("bound").join(bounds, "id", "left"), beyond=need)
        return visits, first.unionByName(self.cells.meet(visits, pick, schema))


def _kth(found: DataFrame, k: int) -> DataFrame:
    """``(query_id, bound)``: the distance of the last of ``found``'s k rows; null where there are fewer."""
    return found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))


def _room(k: int) -> int:
    """Vectors in the cells of the first round: enough for k products in most cases."""
    return 8 * k + 64


def best_per_product(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """``(query_id, product_id, vector_id, distance)``: the nearest vector of each product, whatever its distance."""
    search = Search(queries, refs)
    return _best(search.cells.meet(search.cells.visits(search.asked), _best_in_cell, _FOUND))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each query, with their rank."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def nearest_products(queries: DataFrame, refs: DataFrame, k: int, without: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest products, each by its nearest vector; ties to the smaller product id; those of ``without(query_id, product_id)`` are left out."""

    def first(found: DataFrame) -> DataFrame:
        best = _best(found)
        if without is not None:
            best = best.join(without, ["query_id", "product_id"], "left_anti")
        return top(best, k, "distance", "product_id")

    return first(Search(queries, refs).rounds(_room(k), lambda found: _kth(first(found), k), _best_in_cell, _FOUND)[1])


def cells_visited(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """``(query_id, first, second, cells)``: how many cells each query visits for its ``k`` nearest products, of how many."""
    search = Search(queries, refs)
    second, _ = search.rounds(_room(k), lambda found: _kth(top(_best(found), k, "distance", "product_id"), k), _best_in_cell, _FOUND)
    count = lambda visits, name: visits.select(F.col("id").alias("query_id"), F.explode("cells").alias("cell")).groupBy("query_id").agg(F.countDistinct("cell").alias(name))
    both = count(search.cells.visits(search.asked, need=_room(k)), "first").join(count(second, "second"), "query_id", "full")
    return both.select("query_id", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("second", F.lit(0)).alias("second"), F.lit(int((search.cells.sizes > 0).sum())).cast("long").alias("cells"))


def nearest_vectors(queries: DataFrame, refs: DataFrame, pool: int) -> DataFrame:
    """The ``pool`` nearest vectors of each query, whatever their products."""
    first = lambda found: top(found, pool, "distance", "vector_id")
    return first(Search(queries, refs).rounds(_room(pool), lambda found: _kth(first(found), pool), _nearest_in_cell(pool), _FOUND)[1])


def _votes(pool: DataFrame) -> DataFrame:
    best = F.min(F.struct("distance", "vector_id")).alias("best")
    return pool.groupBy("query_id", "product_id").agg(F.count("*").alias("votes"), best).select("query_id", "product_id", "votes", "best.*")


def nearest_with_votes_pool(queries: DataFrame, refs: DataFrame, k: int, pool: int) -> DataFrame:
    """Products inside the pool of nearest vectors only, by their nearest vector, with their number of vectors in it."""
    return top(_votes(nearest_vectors(queries, refs, pool)), k, "distance", "product_id")


def nearest_with_votes(queries: DataFrame, refs: DataFrame, k: int, pool: int, scope: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest products, with their votes in the pool, 1 for a product outside it.

    ``scope(product_id)`` limits both to its products; an empty scope gives no rows, none gives all.
    """
    if scope is not None:
        refs = refs.join(scope.select("product_id").distinct(), "product_id", "left_semi")

    def pick(*found):
        """Both in one pass: a vector that is the best of its product and among the nearest is there twice."""
        near, best = _nearest_in_cell(pool)(*found), _best_in_cell(*found)
        return [np.concatenate(x) for x in zip((*near, np.ones(len(near[0]), bool)), (*best, np.zeros(len(best[0]), bool)), strict=True)]

    pooled = lambda found: top(found.where("near"), pool, "distance", "vector_id")
    ranked = lambda found: top(_best(found), k, "distance", "product_id")

    def bounds(found: DataFrame) -> DataFrame:
        """The farther of the last product and the last vector of the pool; none unless there are enough of both."""
        both = _kth(ranked(found), k).withColumnRenamed("bound", "a").join(_kth(pooled(found), pool).withColumnRenamed("bound", "b"), "query_id")
        return both.select("query_id", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest("a", "b")).alias("bound"))

    found = written(Search(queries, refs).rounds(_room(max(k, pool)), bounds, pick, f"{_FOUND}, near boolean")[1], "votes")
    votes = _votes(pooled(found)).select("query_id", "product_id", "votes")
    return ranked(found).join(votes, ["query_id", "product_id"], "left").withColumn("votes", F.coalesce("votes", F.lit(1)))


#: References of one product that one task holds at a time.
HELD = 8192


def max_similarity_by_product(queries: DataFrame, refs: DataFrame, candidates: DataFrame, shared: list[str] | None = None, own: list[str] | None = None) -> DataFrame:
    """``(query_id, product_id, *shared, *own, similarity)`` for the candidates ``(query_id, product_id)`` only.

    Each query meets the vectors of its candidates, not those of other products. ``shared`` columns (a model) must be
    equal in ``queries`` and ``refs``; ``own`` ones (a view) are of the queries. The vectors of a product lie together, in pieces of
    HELD at most; the queries stream past them in slices, so that a pair costs a product of two matrices its share and is no row.
    """
    shared, own = shared or [], own or []
    by, keys = ["product_id", *shared], ["query_id", "product_id", *shared, *own]
    sizes = written(refs.groupBy(*by).agg(F.ceil(F.count("*") / HELD).cast("int").alias("pieces")), "product-sizes")
    wanted = candidates.select("query_id", "product_id").distinct().join(queries.select("query_id", *shared, *own, "vec"), "query_id")
    asked = wanted.join(sizes, by).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    held = refs.where("vector_id is not null").join(candidates.select("product_id").distinct(), "product_id", "left_semi").join(sizes, by).withColumn("piece", F.pmod(F.xxhash64("vector_id"), "pieces").cast("int"))
    place = [*by, "piece"]
    held = held.select(*place, F.lit(0).alias("kind"), F.col("vector_id").alias("query_id"), *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in own], "vec")
    dealt = held.unionByName(asked.select(*place, F.lit(1).alias("kind"), "query_id", *own, "vec"))
    dealt = dealt.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), *place).sortWithinPartitions(*place, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, ids, rows = None, [], None, None
        for batch in batches:
            marks = [batch.column(c).to_pylist() for c in [*place, "kind"]]
            edges = [0, *(i for i in range(1, len(batch)) if any(m[i] != m[i - 1] for m in marks)), len(batch)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                *key, kind = (m[start] for m in marks)
                if key != now:
                    now, kept, ids = key, [], None
                if not kind:
                    kept.append(batch.slice(start, stop - start))
                    continue
                if ids is None and kept:
                    ids = np.concatenate([k.column("query_id").to_numpy() for k in kept])
                    rows = np.concatenate([unit_rows(k.column("vec")) for k in kept])
                for at in range(start, stop if kept else start, SLICE):
                    part = batch.slice(at, min(SLICE, stop - at))
                    mine = unit_rows(part.column("vec"))
                    sims = np.where(part.column("query_id").to_numpy()[:, None] == ids[None, :], -np.inf, mine @ rows.T)
                    best = sims.argmax(axis=1)
                    # The value by its own two vectors, whatever stands around them: equal vectors have equal similarities.
                    value = (mine * rows[best]).sum(axis=1)
                    some = pa.array(sims[np.arange(len(part)), best] > -np.inf)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(value, pa.float64())], names=[*keys, "similarity"]).filter(some)

    kinds = [dealt.schema[k] for k in keys]
    scored = dealt.mapInArrow(run, T.StructType([*kinds, T.StructField("similarity", T.DoubleType())]))
    return scored.groupBy(*keys).agg(F.max("similarity").alias("similarity"))


def vote_ratio(votes: str, pool: int):
    return F.round(F.col(votes) / max(1, pool), 4)
