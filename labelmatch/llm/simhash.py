"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits over word shingles, linked at two or fewer differing bits. Each is cut
into two segments of 32 bits, and a table for each segment maps its value to the fingerprints
that have it. Two differing bits leave one segment with at most one of them, so each fingerprint
looks up the ball of radius 1 around each of its segments and verifies the complete distance of
what it finds. Where one bit differs, one of the two fingerprints has it set: only set bits are
flipped, which halves the ball and finds each pair once. A table value with more than ``LONG``
owners is not listed: its owners enumerate the ball around the other segment instead and meet
at equal keys, which at most 65 fingerprints can share, so no list is hot and no pair is lost.

The corpus pipeline's stage asks for the similarity of shingle sets, which no fingerprint decides: it links
by fingerprints first, and finds by the openings of ordered sets what two bits don't reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.functions.storage import written
from labelmatch.llm.lists import deal, sides, spanning, walk
from labelmatch.llm.tokens import in_characters, trimmed
from labelmatch.operators.components import connected_components

SEED = 42
#: Owners of a segment's value above which it is split.
LONG = 64


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half the shingle hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \\x20 and \\x09-\\x0D split
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return bits_of(np.array([digest(g, SEED) for g in grams], dtype="<u8"))


def bits_of(hashes: np.ndarray) -> int:
    """Signed 64 bits, each 1 if it is set in over half the hashes; 0 without any."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id_col, fp long)``, one row for each row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([simhash(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def links(distinct_fps: DataFrame, long: int | None = None) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` that connect all pairs at two or fewer bits; values with more than ``long`` owners are split."""
    segments = "array(fp & 4294967295L, shiftrightunsigned(fp, 32) + 4294967296L)"  # the second table's keys are above all of the first's
    table = distinct_fps.select(F.expr(f"explode({segments})").alias("key"), F.col("fp").alias("v"))
    hot = table.groupBy("key").count().where(F.col("count") > (LONG if long is None else long)).select("key", F.lit(True).alias("hot"))
    hot = written(hot, "simhash-long")
    listed = table.join(hot, "key", "left_anti").select("key", "v", F.lit(False).alias("hot")).unionByName(hot.select("key", F.lit(None).cast("long").alias("v"), "hot"))
    ball = f"transform({segments}, k -> struct(k as key, filter(transform(sequence(0, 31), i -> k & ~shiftleft(1L, i)), x -> x <> k) as near))"
    seen = distinct_fps.select(F.col("fp").alias("u"), F.expr(f"explode({ball})").alias("b")).select("u", F.expr("explode(concat(array(struct(b.key as key, true as own)), transform(b.near, x -> struct(x as key, false as own))))").alias("p"))
    probes = seen.select("u", "p.*")
    # A plan takes the size of the balls for that of the fingerprints, so it would send all of them to the driver where these are few.
    met = written(probes.join(listed.hint("merge"), "key").where("hot or (if(own, u > v, true) and bit_count(u ^ v) <= 2)"), "simhash-met")
    other = "if(key < 4294967296L, shiftrightunsigned(u, 32), u & 4294967295L)"
    around = f"if(own, concat(array({other}), transform(sequence(0, 31), i -> {other} ^ shiftleft(1L, i))), array({other}))"
    shared = met.where("hot").select("key", "u", F.expr(f"explode({around})").alias("x")).groupBy("key", "x").agg(F.min("u").alias("v"), F.collect_set("u").alias("us"))  # at most 65
    split = shared.where("size(us) > 1").select(F.explode("us").alias("u"), "v").where("u <> v and bit_count(u ^ v) <= 2")
    return met.where("not hot").select("u", "v").unionByName(split).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp long, component_id)`` for each row of ``docs``.

    component_id is the smallest id reachable over links of two or fewer differing bits, itself
    included. Null and empty texts have fingerprint zero and are linked like any other; repeated
    rows give repeated rows; null ids never become a component_id unless a component has no
    other; no rows give no rows; further columns are ignored; a text of any length counts whole.
    """
    marks = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    first = written(marks.groupBy("fp").agg(F.min("id").alias("first")), "simhash-fp")
    found = connected_components(links(first.select("fp")))
    named = first.join(found, first.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    lowest = named.groupBy("c").agg(F.min("first").alias("component_id"))
    labels = named.join(lowest, "c").select("fp", "component_id")
    return marks.join(labels, "fp").select("id", "fp", "component_id")


#: Words of 64 bits in the sketch of a text's shingles; shingles up to which all of them are in it.
WORDS, WHOLE = 8, 256
#: Rows of a list that are compared at once, and copies of one text that are; longer lists are dealt out in chunks.
SHORT, STAR = 2000, 400
#: Characters of texts whose shingles are held at once.
BLOCK_CHARS = 1_000_000
#: Texts that are looked at for frequent shingles; how many of them hold one; how many shingles are kept.
SAMPLE, FREQUENT, KEPT = 20_000, 20, 100_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes, in order, of the runs of ``shingle`` words; one for all words of a shorter text, none without words."""
    words = (text or "").encode().lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] * bool(words)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in grams], dtype="<u8"))


def level_of(n: np.ndarray) -> np.ndarray:
    """0 up to WHOLE shingles, one more with each doubling: on level k about one shingle of 2 ** k is in the sketch."""
    return np.ceil(np.log2(np.maximum(n, WHOLE) / WHOLE)).astype(np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    """WORDS signed words: which cells hold an odd number of the set's hashes; the first half those that the next level has too."""
    level = np.uint64(level_of(np.array(len(h))))
    mine = h[(h >> np.uint64(40)) & ((np.uint64(1) << level) - np.uint64(1)) == 0]
    half = WORDS * 32
    cells = (mine >> np.uint64(20)) % np.uint64(half) + np.uint64(half) * ((mine >> (np.uint64(40) + level)) & np.uint64(1))
    return np.packbits((np.bincount(cells.astype(np.int64), minlength=2 * half) & 1).astype(np.uint8), bitorder="little").view("<i8")


class Sketches:
    """Sizes and sketches of sets, and whether two sets can have a similarity.

    Two sets differ in at least as many shingles as their sketches in bits, those of a level or of two neighbouring ones.
    On level 0 the test never turns away a pair of the similarity; above it the sketch is a sample of the shingles by
    their hashes, and the test leaves so much room that a pair is turned away with a probability below 1e-10.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, similarity: float):
        self.n, self.words, self.most = sizes, words, (1 - similarity) / (1 + similarity)
        self.level, self.folded = level_of(sizes), words[:, : WORDS // 2] ^ words[:, WORDS // 2 :]

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        differ = self.most * (self.n[i] + self.n[j])  # shingles in one of the two sets only, at most
        k = np.maximum(self.level[i], self.level[j])
        drawn = differ / (1 << k)
        limit = drawn + np.where(k > 0, 7 * np.sqrt(drawn) + 8, 1e-6)
        alike = self.level[i] == self.level[j]
        bits = np.zeros(np.broadcast_shapes(i.shape, j.shape), np.int32)
        for w in range(WORDS // 2):
            first = lambda x: np.where(alike | (self.level[x] < k), self.words[x, w], self.folded[x, w])  # noqa: E731, B023
            bits += np.bitwise_count(first(i) ^ first(j))
            bits += np.where(alike, np.bitwise_count(self.words[i, w + WORDS // 2] ^ self.words[j, w + WORDS // 2]), 0)
        return (bits <= limit) & (np.abs(self.n[i] - self.n[j]) <= differ + 1e-6)


def opening(h: np.ndarray, similarity: float, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The hashes of a set by which it is looked up; zero without shingles.

    All sets are put in one order: shingles that are not in ``frequent`` (sorted) by hash, then those by ``times``. Two sets
    of at least the similarity s share one of the first n - ceil(s n) + 1 of their n shingles, whatever the order is.
    """
    if not len(h):
        return np.zeros(1, "<u8")
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        h = h[np.lexsort((h, np.where(frequent[at] == h, times[at], 0)))]
    return h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def frequent_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that many texts of a sample hold, and their numbers. They decide what is fast, not what is found."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    text = F.col(text_col).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py(), shingle).view("<i8"))], names=["h"])

    chosen = docs.select(text.alias("text")).where(F.xxhash64("text", F.lit("simhash")) / 2.0**64 + 0.5 < share)
    counts = chosen.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "h").limit(KEPT).toArrow()  # of fixed size
    h = found.column("h").to_numpy().view("<u8")
    order = np.argsort(h)
    return h[order], found.column("n").to_numpy()[order]


_SKETCH = [f"f{i}" for i in range(WORDS)]


def _columns(part: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, Sketches]:
    words = np.stack([part.column(f).to_numpy() for f in _SKETCH], axis=1).view(np.uint64)
    return part.column("node").to_numpy(), part.column("mine").to_numpy(zero_copy_only=False), Sketches(part.column("size").to_numpy(), words, similarity)


def _pairs(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs ``(u, v)``, the greater node first."""
    a, b = np.concatenate([np.empty(0, np.int64), *u]), np.concatenate([np.empty(0, np.int64), *v])
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[a != b], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["u", "v"])


def close_sets(reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(u, v)``, u > v, of nodes of ``reps(node, size, f0.., opening)`` whose sets may have the similarity: enough to connect all that do.

    Each hash of the openings has a list of its owners. Owners of one list are a candidate if, by the numbers of their
    shingles and by their sketches, their sets can be so similar.
    """
    owned = reps.select("node", F.explode("opening").alias("h"))
    sizes = written(owned.groupBy("h").count().where("count > 1"), "simhash-lists")  # counted in the tasks first: a shingle that many texts hold is no task's alone
    rows = owned.join(sizes.select("h"), "h", "left_semi").join(reps.select("node", "size", *_SKETCH), "node")
    few = 48

    def verify(part: pa.Table, bounds: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        ids, mine, sets = _columns(part, similarity)
        # Many short lists at once: each row with the next, the one after that, and so on.
        ends, whole = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
        for s, e in bounds:
            if e - s <= few:
                ends[s:e] = e
                whole[s:e] = mine[s:e].all()
            else:
                left, right = sides(mine[s:e])
                a, b = [], []
                for at in range(0, len(left), 256):
                    block = left[at : at + 256]
                    i, j = np.nonzero(sets.close(s + block[:, None], s + right[None, :]))
                    a.append(block[i])
                    b.append(right[j])
                    i, j = spanning(e - s, np.concatenate(a), np.concatenate(b))
                    a, b = [i], [j]  # no more pairs than rows are held
                yield _pairs([ids[s:e][a[0]]], [ids[s:e][b[0]]])
        us, vs = [], []
        for d in range(1, few):
            i = np.flatnonzero(np.arange(len(part)) + d < ends)
            if not len(i):
                break
            i = i[whole[i] | (mine[i] != mine[i + d])]
            i = i[sets.close(i, i + d)]
            us.append(ids[i])
            vs.append(ids[i + d])
        yield _pairs(us, vs)

    dealt = deal(rows, ["h"], "node", SHORT, sizes)
    return dealt.mapInArrow(lambda b: walk(b, ["h"], verify), "u long, v long").distinct()


def unsettled(members: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links ``(u, v)``, u > v, of the similarity within a list of ``members(list, node, known, size, f0.., text)`` but not within one ``known`` component; enough to connect all that have it.

    The texts of a piece are compared where they lie, and two that a chain of links joins already are not compared, so a piece gives fewer links than it has rows.
    """

    def look(part: pa.Table, bounds: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        ids, mine, sets = _columns(part, similarity)
        known, texts = part.column("known").to_numpy(), part.column("text")
        for s, e in bounds:
            left, right = sides(mine[s:e])
            held: dict[int, np.ndarray] = {}
            _, group = np.unique(known[s:e], return_inverse=True)
            us, vs = [], []

            def hashes(i: int) -> np.ndarray:
                if i not in held:
                    held[i] = shingle_hashes(texts[s + i].as_py(), shingle)  # noqa: B023
                return held[i]

            for i in left:
                js = right[(group[right] != group[i]) & sets.close(np.array([s + i]), s + right)]
                for j in js:
                    if group[i] == group[j]:
                        continue
                    a, b = hashes(i), hashes(j)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    every = len(a) + len(b) - both
                    if not every or both / every >= similarity:
                        us.append(ids[s + i : s + i + 1])
                        vs.append(ids[s + j : s + j + 1])
                        group[group == group[j]] = group[i]
            yield _pairs(us, vs)

    return deal(members, ["list"], "node", STAR).mapInArrow(lambda b: walk(b, ["list"], look), "u long, v long").distinct()


def similar(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The ``pairs(u, v)`` whose texts, of ``texts(node, text)``, have shingle sets of the Jaccard similarity; without words both count as 1.

    Each v meets its partners in stars of STAR of them, so that its text is moved once a star and not once a pair.
    """
    large = written(pairs.groupBy("v").count().where(F.col("count") > STAR), "large-stars")
    stars = pairs.join(large, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce(F.ceil(F.col("count") / STAR), F.lit(1))).cast("int").alias("c"))
    ends = stars.select("v", "c", F.col("u").alias("node"), F.lit(False).alias("head"))
    heads = stars.select("v", "c").distinct().select("v", "c", F.col("v").alias("node"), F.lit(True).alias("head"))
    rows = ends.unionByName(heads).join(texts.hint("merge"), "node").withColumn("d", F.lit(0))  # like texts take little room in a table and much in memory
    by = ["v", "c", "d"]
    dealt = rows.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, F.desc("head"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, "<u8")
        for batch in batches:
            us, vs = [], []
            for node, v, head, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("node", "v", "head", "text")), strict=True):
                h = shingle_hashes(text.as_py(), shingle)
                if head.as_py():  # the first of its star
                    at, own = v.as_py(), h
                    continue
                both = len(np.intersect1d(own, h, assume_unique=True))
                every = len(own) + len(h) - both
                if at == v.as_py() and (not every or both / every >= similarity):
                    us.append(node.as_py())
                    vs.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(trimmed(compare), "u long, v long")


def fingerprint_pairs(reps: DataFrame) -> DataFrame:
    """Pairs ``(u, v)``, u > v, of nodes of ``reps(node, fp)`` by multi-index hashing: of one fingerprint, or of two at two or fewer differing bits; enough to connect all that are."""
    owners = written(reps.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "simhash-prints")
    same = reps.select("node", "fp").join(owners.where("n > 1"), "fp").where("node > least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    end = lambda n: owners.select(F.col("fp").alias(n), F.col("least").alias(f"n{n}"))
    near = links(owners.select("fp")).join(end("u"), "u").join(end("v"), "v")
    return written(same.unionByName(near.select(F.greatest("nu", "nv").alias("u"), F.least("nu", "nv").alias("v"))), "simhash-bits")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one of each group stays: that of least id.

    Texts are linked if the Jaccard similarity of their shingle sets is ``similarity`` or more. Fingerprints of the sets link
    the closest first, by multi-index hashing, and the sets decide. Two bits don't reach all pairs of the similarity: openings of the ordered
    sets and sketches find the other candidates; of each group of candidates, every text is compared with the first it may be
    linked with, and what that leaves apart is compared within its pieces, so that no link between groups is lost.

    Texts of equal sets are one text. Null and empty texts are linked with each other; of rows with one id in a
    group, repeated rows among them, one stays, and of those with one id and text the first by its other columns; a group of null ids keeps one; no rows give no rows; further columns
    are carried along; a text of any length is compared whole.
    """
    row_key = lambda a, b: [F.xxhash64(F.lit(7), a, b).alias("k1"), F.xxhash64(F.lit(11), b, a).alias("k2")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), *row_key(F.col(id_col), F.col(text_col)))
    frequent, times = frequent_shingles(docs, text_col, shingle)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, times))  # at most KEPT
    names = ["id", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_characters(batch, 1, BLOCK_CHARS):
                sets = [shingle_hashes(t.as_py(), shingle) for t in part.column(1)]
                keys = [pa.array([xxhash.xxh64_intdigest(h.tobytes(), seed) for h in sets], pa.uint64()).view(pa.int64()) for seed in (3, 5)]
                sizes = pa.array([len(h) for h in sets], pa.int64())
                words = np.array([sketch(h) for h in sets])
                prints = pa.array([bits_of(h) for h in sets], pa.int64())
                openings = pa.array([opening(h, similarity, *shared.value).view("<i8") for h in sets], pa.list_(pa.int64()))
                kept = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *keys, sizes, *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)), prints, openings], names=[*names, "s1", "s2", "size", *_SKETCH, "fp", "opening"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("k1", "k2", "s1", "s2", "size", *_SKETCH, "fp")], T.StructField("opening", T.ArrayType(T.LongType()))])
    marks = written(keyed.mapInArrow(trimmed(run), schema), "simhash-rows")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")).alias("first")
    # Equal sets, merged before the shuffle.
    texts = marks.groupBy("s1", "s2").agg(least, *[F.first(c).alias(c) for c in ("size", *_SKETCH, "fp", "opening")])
    reps = written(texts.select(F.monotonically_increasing_id().alias("node"), "first", "size", *_SKETCH, "fp", "opening"), "simhash-texts")
    bits = fingerprint_pairs(reps)
    pairs = written(close_sets(reps, similarity).unionByName(bits), "simhash-pairs")
    near = written(connected_components(pairs).withColumnRenamed("component", "list"), "simhash-near")
    row = docs.select(F.col(text_col).cast("string").alias("text"), *row_key(F.col(id_col), F.col(text_col)))
    candidates = near.join(reps, "node").select("node", "first.k1", "first.k2").join(row, ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text"))
    candidates = written(candidates, "simhash-candidates")
    by_bits = written(similar(bits, candidates, similarity, shingle), "simhash-by-bits")
    apart = connected_components(by_bits)
    settled = apart.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v")  # connects what by_bits does
    root = lambda n: apart.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))
    pairs = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left").where("cu is null or cv is null or cu <> cv").select("u", "v")
    links = written(settled.unionByName(similar(pairs.groupBy("u").agg(F.min("v").alias("v")), candidates, similarity, shingle)), "simhash-links")
    linked = connected_components(links)
    known = near.join(linked, "node", "left").select("node", "list", F.coalesce("component", "node").alias("known"))
    apart = known.groupBy("list").agg(F.min("known").alias("a"), F.max("known").alias("b")).where("a <> b").select("list")
    left = known.join(apart, "list").join(reps.select("node", "size", *_SKETCH), "node")
    more = unsettled(left.join(candidates.hint("merge"), "node"), similarity, shingle)
    # Components are joined by what links them: their own links are settled.
    group = lambda n: known.select(F.col("node").alias(n), F.col("known").alias(f"k{n}"))
    joined = connected_components(more.join(group("u"), "u").join(group("v"), "v").select(F.col("ku").alias("u"), F.col("kv").alias("v")).distinct())
    named = reps.join(linked, "node", "left").select("first", F.coalesce("component", "node").alias("known"))
    joined = joined.select(F.col("node").alias("known"), F.col("component").alias("g"))
    kept = named.join(joined, "known", "left").groupBy(F.coalesce("g", "known").alias("g")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(F.col(id_col), F.col(text_col)))
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in (id_col, text_col)]))
    numbered = whole.join(kept, ["k1", "k2"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(others)))
    return numbered.where("n = 1").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_simhash(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
