"""Hard negatives by Kronecker-packed products.

Vectors are integers: each component x becomes floor(scale * x). Anchors meet all rows in blocks, a group of
anchors and a share of the rows in each. There the components of several rows at one dimension, made non-negative
by a bias, become separated fields of one wide integer, of as many bytes as hold the largest sum of products.
For an anchor, each of its (biased) components multiplies its dimension's wide integer once; the sum of these
products holds in its fields the products of all the packed rows, from which the biases are taken off again. All
of it is integer arithmetic, so scores are exact at any magnitude.

One pass finds each anchor's positives, where only rows of its label are packed; with their scores known, a
second pass finds the rows of other labels within each positive's band.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch.functions.storage import written
from labelmatch.llm.vectors import typed

#: Anchors that a task holds at a time, about, and rows that are packed at once.
ANCHORS, PACKED = 1024, 4096
#: Scores beyond the range of a long stay at its ends.
TOP = (1 << 63) - 1


class Fields:
    """Rows packed for products with anchors whose components lie from ``low`` to ``high``, both ends with zero."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.n, self.dims = rows.shape
        self.low = low
        self.bias = min(int(rows.min(initial=0)), 0)
        span = int(rows.max(initial=0)) - self.bias
        bits = (self.dims * span * (high - low)).bit_length()
        self.bytes = 4 if bits <= 32 else 8 if bits < 64 else -(-bits // 64) * 8
        unsigned = (rows.view(np.uint64) - np.array([self.bias], np.int64).view(np.uint64)).T  # a difference of longs may need all 64 bits
        if self.bytes <= 8:
            fields = np.ascontiguousarray(unsigned.astype(f"<u{self.bytes}")).view(np.uint8)
        else:
            fields = np.zeros((self.dims, self.n, self.bytes), np.uint8)
            fields[:, :, :8] = np.ascontiguousarray(unsigned.astype("<u8")).view(np.uint8).reshape(self.dims, self.n, 8)
        self.wide = [int.from_bytes(f.tobytes(), "little") for f in fields]
        self.sums = rows.sum(axis=1) if self.bytes <= 8 else [sum(r) for r in rows.tolist()]

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner product of ``anchor`` with each row, as longs."""
        total = sum(map(operator.mul, [x - self.low for x in anchor], self.wide))
        held = total.to_bytes(self.n * self.bytes, "little")
        fixed = self.bias * sum(anchor) - self.dims * self.low * self.bias
        if self.bytes <= 8:
            return np.frombuffer(held, f"<u{self.bytes}").astype(np.int64) + self.low * self.sums + fixed
        each = (int.from_bytes(held[at : at + self.bytes], "little") for at in range(0, len(held), self.bytes))
        return np.array([max(-TOP, min(TOP, x + self.low * s + fixed)) for x, s in zip(each, self.sums, strict=True)], np.int64)


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, largest first, equal ones in their order."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return near[np.argsort(-scores[near], kind="stable")][:k]
    return np.argsort(-scores, kind="stable")


def _matrix(column: pa.Array, dims: int = 0) -> np.ndarray:
    """A list column of longs as rows of one length; missing components are zero."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    dims = max(dims, int(sizes.max(initial=0)))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


class Anchors:
    """The anchors of one block."""

    def __init__(self, parts: list[pa.RecordBatch]):
        held = pa.Table.from_batches(parts).combine_chunks()
        column = lambda name: held.column(name).combine_chunks()
        self.row, self.id, self.label = (column(c).to_numpy() for c in ("row", "id", "label"))
        rows = _matrix(column("vec"))
        self.dims, self.low, self.high = rows.shape[1], min(int(rows.min(initial=0)), 0), max(int(rows.max(initial=0)), 0)
        self.vectors, self.positives = rows.tolist(), column("positives").to_pylist()

    def packed(self, rows: np.ndarray) -> Fields:
        return Fields(rows, self.low, self.high)

    def vector(self, i: int, dims: int) -> list[int]:
        return self.vectors[i] + [0] * (dims - self.dims)


def _blocks(batches: Iterator[pa.RecordBatch], visit: Callable[[Anchors, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """``visit(anchors, ids, labels, vectors)`` for slices of the rows of each block, in the order of ids; its tuples of longs."""
    key, parts, anchors = None, [], None
    for batch in batches:
        marks = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("r", "k", "kind")], axis=1)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for start, stop in zip(edges, edges[1:], strict=False):
            if start == stop:
                continue
            r, k, kind = marks[start].tolist()
            if (r, k) != key:
                key, parts, anchors = (r, k), [], None
            if not kind:
                parts.append(batch.slice(start, stop - start))
                continue
            if not parts:
                continue
            anchors = anchors or Anchors(parts)
            for at in range(start, stop, PACKED):
                piece = batch.slice(at, min(PACKED, stop - at))
                ids = piece.column(piece.schema.get_field_index("id")).to_numpy()
                order = np.argsort(ids, kind="stable")
                labels = piece.column(piece.schema.get_field_index("label")).to_numpy()
                rows = _matrix(piece.column(piece.schema.get_field_index("vec")), anchors.dims)
                found = list(visit(anchors, ids[order], labels[order], rows[order]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)


def _positives(k: int) -> Callable:
    def visit(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        for label in np.intersect1d(anchors.label, labels):
            at = np.flatnonzero(labels == label)
            own, packed = ids[at], anchors.packed(rows[at])
            for i in np.flatnonzero(anchors.label == label).tolist():
                others = np.flatnonzero(own != anchors.id[i])
                scores = packed.scores(anchors.vector(i, packed.dims))[others]
                for j in first(scores, k).tolist():
                    yield int(anchors.row[i]), int(own[others[j]]), int(scores[j])

    return visit


def _negatives(k: int, low: int, high: int) -> Callable:
    def visit(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        packed = anchors.packed(rows)
        for i, positives in enumerate(anchors.positives):
            bands = [(p, -(-low * s // 100), high * s // 100) for p, s in enumerate(x["score"] for x in positives)]
            bands = [(p, a, b) for p, a, b in bands if a <= b]
            if not bands:
                continue
            scores = packed.scores(anchors.vector(i, packed.dims))
            near = np.flatnonzero((labels != anchors.label[i]) & (scores >= min(a for _, a, _ in bands)) & (scores <= max(b for _, _, b in bands)))
            near = near[np.argsort(-scores[near], kind="stable")]
            ranked = scores[near]
            for p, a, b in bands:
                begin = int(np.searchsorted(-ranked, -b))
                for j in range(begin, min(begin + k, len(near))):
                    if ranked[j] < a:
                        break
                    yield int(anchors.row[i]), p, int(ids[near[j]]), int(ranked[j])

    return visit


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on ``id``. An anchor's positives are its first ``positives`` other rows of the same
    label; for each, the first ``negatives`` rows of other labels that satisfy
    ``low * positive_score <= 100 * negative_score <= high * positive_score``. Larger scores come first, ties by smaller id.

    Rows with a null id, label or vector, or any null or non-finite component, take no part. Components and scores
    beyond the range of a long stay at its ends. Vectors of unequal length are compared as if the shorter ended in zeros.
    Other rows are those of another id; repeated rows are rows of their own, as anchors too. Without an anchor, a
    positive or a row within the band there is no row; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = typed(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec")), "vec")
    good = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(good)
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("vec")), "negatives-rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-rows.where(is_anchor).count() // ANCHORS))
    shares = max(1, -(-2 * parts // groups))
    none = F.lit(None).cast("array<struct<id: long, score: long>>").alias("positives")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = rows.select(every(groups).alias("r"), F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int").alias("k"), F.lit(1).alias("kind"), "row", "id", "label", "vec", none)

    def met(anchors: DataFrame, visit: Callable, names: list[str]) -> DataFrame:
        """Anchors are repeated for the shares, whose number goes with the tasks, and rows for the groups of anchors."""
        asked = anchors.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("r"), every(shares).alias("k"), F.lit(0).alias("kind"), "row", "id", "label", "vec", "positives")
        dealt = asked.unionByName(held).repartition(parts, "r", "k").sortWithinPartitions("r", "k", "kind")
        return dealt.mapInArrow(lambda b: _blocks(b, visit, names), ", ".join(f"{c} long" for c in names))

    best = lambda found, by, k: found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    anchors = rows.where(is_anchor)
    near = best(met(anchors.select("*", none), _positives(positives), ["row", "id", "score"]), ["row"], positives)
    listed = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))  # ``positives`` at most
    known = written(anchors.join(listed, "row"), "negatives-anchors")
    found = best(met(known, _negatives(negatives, low, high), ["row", "p", "id", "score"]), ["row", "p"], negatives).withColumnRenamed("id", "negative_id")
    out = found.join(known.select("row", F.col("id").alias("anchor_id"), "positives"), "row").withColumn("positive", F.expr("positives[int(p)]"))
    return out.select("anchor_id", F.col("positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_negatives(vectors: DataFrame) -> DataFrame:
    """The query's anchors are the ids divisible by 50; labels of ids divisible by 7 move on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 50 == 0)


def oracle_sql(embeddings: str = "embeddings") -> str:
    return f"""
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM {embeddings} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS alike, coalesce(list_dot_product(a.vec, b.vec), 0)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
