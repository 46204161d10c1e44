"""Nearest neighbours by a hash-prefix forest over all rows (after LSH Forest, Bawa et al., 2005).

Every tree gives a vector a string of SYMBOLS symbols of SYMBOL bits: a symbol is the one of PLANES orthogonal directions that the
vector lies along most, with its sign. A tree is its strings in order, with places of the vectors; the vectors stay in shards.
Trees are cut into lists by so many first symbols that a list is of bounded size, mostly none.

A query first descends in every tree to the rows that share the longest prefix with it, which tells how many rows share how
many symbols. The largest length that brings enough rows from all trees together is where it begins. From there
all trees ascend at once, one symbol at a time: the rows that share so many symbols, and no more, are compared with the query by
cosine in double precision. A query ends when a row as near as its k-th best so far would be missed in all trees with
probability ``miss`` at most. Length 0 is every row: a query whose neighbours are that far is answered by all shards.

Lists and shards are written once, in buckets; a step moves the open queries and what is asked for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch.functions.storage import bucketed, written
from labelmatch.llm.vectors import matrix, norms, typed, usable

#: Directions of a symbol, the bits of one, symbols of a string, and functions that give symbols, of which each tree takes its own.
PLANES, SYMBOL, SYMBOLS, POOL = 16, 5, 12, 256
#: Trees, vectors in a shard, strings in a list, and the probability that a row is missed.
TREES, SHARD, CHUNK, MISS, SEED = 128, 8192, 65_536, 0.3, 7


class Hashes:
    """The strings of vectors of one length."""

    def __init__(self, dim: int, trees: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.planes = min(PLANES, dim)
        self.directions = np.concatenate([np.linalg.qr(rng.standard_normal((dim, self.planes)))[0] for _ in range(POOL)], axis=1).astype(np.float32)
        # The first and second symbols of the trees are functions of their own as far as there are enough; the others are drawn.
        order = np.concatenate([rng.permutation(POOL) for _ in range(-(-2 * trees // POOL))])
        self.chosen = np.concatenate([order[: 2 * trees].reshape(2, trees).T, rng.integers(0, POOL, (trees, SYMBOLS - 2))], axis=1)

    def strings(self, rows: np.ndarray) -> np.ndarray:
        """(rows, trees) strings, the first symbol highest."""
        out = np.zeros((len(rows), len(self.chosen)), np.int64)
        for at in range(0, len(rows), 512):
            part = rows[at : at + 512]
            along = (part / np.abs(part).max(axis=1, keepdims=True)).astype(np.float32) @ self.directions
            along = along.reshape(len(part), POOL, self.planes)
            best = np.abs(along).argmax(axis=2)
            signs = np.take_along_axis(along, best[:, :, None], axis=2)[:, :, 0] > 0
            symbols = (best << 1 | signs).astype(np.int64)
            for j in range(SYMBOLS):
                out[at : at + 512] = out[at : at + 512] << SYMBOL | symbols[:, self.chosen[:, j]]
        return out


def thresholds(trees: int, miss: float, seed: int) -> list[float]:
    """For the lengths 1 to SYMBOLS: the least cosine at which a row is missed, with no prefix so long shared in any tree, with probability ``miss`` at most."""
    rng = np.random.default_rng(seed)
    cosines, at = np.linspace(0, 1, 41), np.arange(8000)
    a, more = rng.standard_normal((8000, PLANES)), rng.standard_normal((8000, PLANES))
    agree = []
    for c in cosines:
        b = c * a + np.sqrt(1 - c * c) * more
        i, j = np.abs(a).argmax(axis=1), np.abs(b).argmax(axis=1)
        agree.append(np.mean((i == j) & (a[at, i] * b[at, j] > 0)))
    agree = np.maximum.accumulate(agree)
    return [float(np.interp((1 - miss ** (1 / trees)) ** (1 / x), agree, cosines)) for x in range(1, SYMBOLS + 1)]


def _batched(out: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of neighbouring rows with equal keys."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if len(batch) else np.empty(0, int)
        for s, e in zip([0, *change.tolist()], [*change.tolist(), len(batch)], strict=True):
            if e > s:
                yield tuple(c[s].item() for c in cols), batch.slice(s, e - s)


def _number(batches: Iterator[pa.RecordBatch], trees: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows by shard: each gets its number in the shard and its strings."""
    now, n, hashes = None, 0, {}
    for (shard, dim), part in _runs(batches, ["shard", "dim"]):
        n = 0 if shard != now else n
        now = shard
        if dim not in hashes:
            hashes[dim] = Hashes(dim, trees, seed)
        found = hashes[dim].strings(matrix(part.column(part.schema.get_field_index("vec"))))
        held = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, trees), pa.int32()), pa.array(found.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.arange(n, n + len(part)), pa.int32()), held], names=[*part.schema.names, "slot", "strings"])
        n += len(part)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each list, whose rows come in order, as one row of arrays."""
    now, held = None, []

    def row() -> pa.RecordBatch:
        s, shard, slot = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([now]), *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((s, "<i8"), (shard, "<i4"), (slot, "<i4")))], names=["list", "s", "shard", "slot"])

    for batch in batches:
        keys = batch.column(0)
        change = np.flatnonzero(keys.dictionary_encode().indices.to_numpy()[1:] != keys.dictionary_encode().indices.to_numpy()[:-1]) + 1
        for start, stop in zip([0, *change.tolist()], [*change.tolist(), len(batch)], strict=True):
            if start == stop:
                continue
            key = keys[start].as_py()
            if key != now and held:
                yield row()
                held = []
            now = key
            held.append([batch.column(c).slice(start, stop - start).to_numpy() for c in (1, 2, 3)])
    if held:
        yield row()


def _opened(lists: pa.Table) -> list[np.ndarray]:
    """A list's strings, in order, their shards and slots."""
    return [np.frombuffer(lists.column(c)[0].as_py(), t) for c, t in (("s", "<i8"), ("shard", "<i4"), ("slot", "<i4"))]


def _bounds(strings: np.ndarray, asked: np.ndarray, symbols: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Between which places of a list the strings share so many first symbols with the asked ones."""
    cut = SYMBOL * (SYMBOLS - symbols)
    low = asked >> cut << cut
    return np.searchsorted(strings, low, "left"), np.searchsorted(strings, low + (np.int64(1) << cut) - 1, "right")


def _descend(lists: pa.Table, asked: pa.Table) -> pa.Table:
    """How many rows of a list share 1, 2, ... symbols with each query."""
    out = []
    if len(lists) and len(asked):
        strings, s, q = _opened(lists)[0], asked.column("s").to_numpy(), asked.column("q").to_numpy()
        for x in range(1, SYMBOLS + 1):
            low, high = _bounds(strings, s, x)
            some = np.flatnonzero(high > low)
            out.append((q[some], np.full(len(some), x), (high - low)[some]))
            if not len(some):
                break
    q, x, n = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else [(), (), ()]))
    return pa.table([pa.array(q.astype(np.int64)), pa.array(x.astype(np.int32)), pa.array(n.astype(np.int64))], names=["q", "symbols", "n"])


_ASKED = [("shard", pa.int32()), ("q", pa.int64()), ("slots", pa.binary())]


def _ascend(lists: pa.Table, asked: pa.Table) -> pa.Table:
    """By shard, the rows of a list that share ``level`` symbols with each query, without those that share ``seen`` or more."""
    out = []
    if len(lists) and len(asked):
        strings, shards, slots = _opened(lists)
        s, level, seen = asked.column("s").to_numpy(), asked.column("level").to_numpy().astype(np.int64), asked.column("seen").to_numpy().astype(np.int64)
        low, high = _bounds(strings, s, level)
        known = seen <= SYMBOLS
        inner_low, inner_high = _bounds(strings, s, np.minimum(seen, SYMBOLS))
        inner_low, inner_high = np.where(known, inner_low, low), np.where(known, inner_high, low)
        for q, a, b, c, d in zip(asked.column("q").to_pylist(), low.tolist(), inner_low.tolist(), inner_high.tolist(), high.tolist(), strict=True):
            at = np.concatenate([np.arange(a, b), np.arange(c, d)])
            if len(at):
                order = at[np.argsort(shards[at], kind="stable")]
                where, begin = np.unique(shards[order], return_index=True)
                out += [(int(w), q, p.tobytes()) for w, p in zip(where, np.split(slots[order], begin[1:]), strict=True)]
    return pa.Table.from_batches([_batched(out, _ASKED)])


def _verify(k: int):
    """What is asked of a shard -> how many rows each query was compared with, and the ``k`` best of them."""
    kinds = [("q", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("compared", pa.int64())]

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(held) and len(asked):
            held = held.sort_by("slot")
            ids, rows, slots = held.column("id").to_numpy(), matrix(held.column("vec").combine_chunks()), held.column("slot").to_numpy()
            lengths, vectors = norms(rows), matrix(asked.column("vec").combine_chunks())
            shard = held.column("shard")[0].as_py()
            for i, (q, own, length) in enumerate(zip(asked.column("q").to_pylist(), asked.column("id").to_pylist(), norms(vectors).tolist(), strict=True)):
                wanted = asked.column("slots")[i].as_py()
                at = np.arange(len(ids)) if wanted is None else np.unique(np.frombuffer(b"".join(wanted), "<i4"))
                at = at[ids[at] != own]
                cosines = (rows[at] * vectors[i]).sum(axis=1) / (lengths[at] * length)
                compared = len(at)
                if len(at) > k:
                    best = np.flatnonzero(cosines >= np.partition(cosines, -k)[-k])
                    at, cosines = at[best], cosines[best]
                best = np.lexsort((ids[at], -cosines))[:k]
                out += [(q, shard << 32 | r, j, c, compared) for r, j, c in zip(slots[at[best]].tolist(), ids[at[best]].tolist(), cosines[best].tolist(), strict=True)]
        return pa.Table.from_batches([_batched(out, kinds)])

    return run


class Forest:
    """Lists and shards of all rows, and the queries among them."""

    def __init__(self, vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, shard: int, trees: int, seed: int, chunk: int):
        self.spark, self.k, self.trees = vectors.sparkSession, k, trees
        self.parts = parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = typed(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")), "vec").where(usable("vec") & F.col("id").isNotNull())
        # Of equal rows no more than k can be among the k best of a query, so a large group of them is not moved.
        same = rows.groupBy("id", "vec").agg(F.count("*").alias("n")).withColumn("dim", F.size("vec"))
        same = same.select("dim", "id", "vec", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k + 1)).cast("int"))).alias("copy"))
        same = written(same, "forest-rows")
        sizes = {r["dim"]: r["count"] for r in same.groupBy("dim").count().orderBy("dim").collect()}  # a row for each length of vector
        shards, first = F.lit(0), 0
        for dim, n in sizes.items():
            count = -(-n // shard)
            shards = F.when(F.col("dim") == dim, first + F.pmod(F.xxhash64("id", "vec", "copy"), F.lit(count))).otherwise(shards)
            first += count
        named = same.withColumn("shard", shards.cast("int")).drop("copy").repartition(max(first, parts), "shard").sortWithinPartitions("shard", "id")
        kinds = f"dim int, id long, vec {dict(named.dtypes)['vec']}, shard int, slot int, strings array<long>"
        index = written(named.mapInArrow(lambda b: _number(b, trees, seed), kinds), "forest-index")
        self.shards = bucketed(index.select("shard", "slot", "dim", "id", "vec"), "forest_shards", "shard", parts)
        queries = index.where(is_query).groupBy("dim", "id").agg(F.min(F.struct("shard", "slot", "vec", "strings")).alias("m"))
        self.queries = written(queries.select(F.shiftleft(F.col("m.shard").cast("long"), 32).bitwiseOR(F.col("m.slot").cast("long")).alias("q"), "dim", "id", "m.vec", "m.strings"), "forest-queries")
        # Symbols that name a list, by length of vector: as many as leave about ``chunk`` strings.
        self.named = {dim: max(0, int(np.log(max(1, n / chunk)) / np.log(2 * min(PLANES, dim)))) for dim, n in sizes.items()}
        at = F.coalesce(*[F.when(F.col("dim") == dim, F.lit(x)) for dim, x in self.named.items()], F.lit(0))
        part = F.when(at > 0, F.expr(f"shiftright(s, {SYMBOL} * ({SYMBOLS} - at))")).otherwise(0)
        placed = index.select("dim", "shard", "slot", F.posexplode("strings").alias("tree", "s")).withColumn("at", at).withColumn("part", part).drop("at")
        key = ["dim", "tree", "part"]
        self.large = written(placed.groupBy(*key).count().where(F.col("count") > 2 * chunk).select(*key, F.ceil(F.col("count") / chunk).cast("int").alias("pieces")), "forest-large")
        piece = F.pmod(F.xxhash64("shard", "slot"), F.coalesce("pieces", F.lit(1)))
        listed = placed.join(self.large, key, "left").select(F.concat_ws(":", *key, piece).alias("list"), "s", "shard", "slot")
        packed = listed.repartition(parts, "list").sortWithinPartitions("list", "s").mapInArrow(_pack, "list string, s binary, shard binary, slot binary")
        self.lists = bucketed(packed, "forest_lists", "list", parts)

    def ask(self, level: Column, steps: DataFrame | None = None) -> DataFrame:
        """``(list, q, s, ...)``: the lists that hold the strings which share ``level`` symbols with a query's, or as many as name a list."""
        rows = self.queries.select("dim", "q", F.posexplode("strings").alias("tree", "s"))
        rows = rows.withColumns({"level": F.lit(SYMBOLS), "seen": F.lit(SYMBOLS + 1)}) if steps is None else rows.join(steps.where("level > 0"), "q")
        at = F.coalesce(*[F.when(F.col("dim") == dim, F.lit(x)) for dim, x in self.named.items()], F.lit(0))
        rows = rows.withColumn("at", at).withColumn("short", F.greatest(F.lit(0), F.col("at") - level))
        begin = F.when(F.col("at") > 0, F.expr(f"shiftleft(shiftright(s, {SYMBOL} * ({SYMBOLS} - at + short)), {SYMBOL} * short)")).otherwise(0)
        last = begin + F.expr(f"shiftleft(1L, {SYMBOL} * short)") - 1
        rows = rows.withColumn("part", F.explode(F.sequence(begin, last)))
        pieces = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece")
        key = ["dim", "tree", "part"]
        return rows.join(self.large, key, "left").select(*key, pieces, "q", "s", "level", "seen").select(F.concat_ws(":", *key, "piece").alias("of"), "q", "s", "level", "seen")

    def begin(self) -> DataFrame:
        """``(q, level, seen)``: the largest number of symbols that ``k`` other rows share with a query for certain, as a tree has each row once; 0 where no number is."""
        told = self.lists.groupBy("list").cogroup(self.ask(F.lit(SYMBOLS)).groupBy("of")).applyInArrow(_descend, "q long, symbols int, n long")
        enough = told.groupBy("q", "symbols").agg(F.sum("n").alias("n")).where(F.col("n") >= (self.k + 1) * self.trees)
        deepest = enough.groupBy("q").agg(F.max("symbols").alias("level"))
        return written(self.queries.select("q").join(deepest, "q", "left").select("q", F.coalesce("level", F.lit(0)).alias("level"), F.lit(SYMBOLS + 1).alias("seen")), "forest-steps")

    def step(self, steps: DataFrame) -> DataFrame:
        """``(q, row, id, score, compared)`` of the rows at the queries' levels; at level 0 all rows of the query's length."""
        asked = self.ask(F.col("level"), steps)
        found = self.lists.groupBy("list").cogroup(asked.groupBy("of")).applyInArrow(_ascend, "shard int, q long, slots binary")
        wanted = found.groupBy("shard", "q").agg(F.collect_list("slots").alias("slots"))  # at most one a list
        every = self.shards.select("dim", "shard").distinct()
        whole = steps.where("level = 0").join(self.queries.select("q", "dim"), "q").join(every, "dim").select("shard", "q", F.lit(None).cast("array<binary>").alias("slots"))
        sent = wanted.unionByName(whole).join(self.queries.select("q", "id", "vec"), "q").withColumnRenamed("shard", "of")
        return self.shards.drop("dim").groupBy("shard").cogroup(sent.groupBy("of")).applyInArrow(_verify(self.k), "q long, row long, id long, score double, compared long")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, miss: float = MISS, trees: int = TREES, seed: int = SEED, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``nearest``, and ``(query_id, symbols, compared)``: at how many symbols each query ended, and with how many rows it was compared."""
    forest = Forest(vectors, is_query, k, id_col, vec_col, shard, trees, seed, chunk)
    ends = F.array(*[F.lit(t) for t in thresholds(trees, miss, seed)])
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", "row")
    steps, found, done = forest.begin(), None, None
    for _ in range(SYMBOLS + 1):
        new = written(forest.step(steps), "forest-new")
        rows = new.drop("compared") if found is None else new.drop("compared").unionByName(found)
        found = written(rows.dropDuplicates(["q", "row"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "forest-found")
        last = found.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("last"))
        compared = new.groupBy("q", F.shiftright("row", 32).alias("shard")).agg(F.max("compared").alias("n")).groupBy("q").agg(F.sum("n").alias("compared"))
        state = steps.join(last, "q", "left").join(compared, "q", "left").withColumn("ends", (F.col("level") == 0) | F.coalesce(F.col("last") >= F.get(ends, F.col("level") - 1), F.lit(False)))
        state = written(state.select("q", "level", F.coalesce("compared", F.lit(0)).alias("compared"), "ends"), "forest-state")
        done = state if done is None else done.unionByName(state)
        steps = state.where("not ends").select("q", (F.col("level") - 1).alias("level"), F.col("level").alias("seen"))
        if steps.isEmpty():
            break
    named = forest.queries.select("q", F.col("id").alias("query_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).join(named, "q").select("query_id", "rank", "id", "score")
    told = done.groupBy("q").agg(F.min("level").alias("symbols"), F.sum("compared").alias("compared")).join(named, "q").select("query_id", "symbols", "compared")
    return ranked, told


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` rows of largest cosine that each query finds, ties to the smaller id.

    ``is_query`` is a condition on ``id``. A query's own id is no candidate. Vectors that are null, zero, or hold null
    or non-finite components, and null ids, take no part; vectors are compared with vectors of their length; repeated
    rows are candidates of their own, and a repeated query is one query; no rows give no rows; further columns are ignored.
    """
    return search(vectors, is_query, k, id_col, vec_col, **options)[0]


def op10_nearest(vectors: DataFrame) -> DataFrame:
    out = nearest(vectors, F.col("id") % 50 == 0)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
