"""Product names in texts: the longest one inside, else the most like one by matching blocks.

Names are dealt into chunks of bounded size. A task holds a chunk as an automaton that finds all of its names in one pass
over a text, and as counts of letters in the order of their length, and texts of any length stream past it. Two strings
whose matching blocks make up ``least`` of both have lengths within a factor, and as many letters in common; the names
left by these bounds are compared in their order until no better one is possible.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.operators.features import norm

#: Bytes of names in a chunk, and counters of letters a name has.
CHUNK_BYTES, LETTERS = 4_000_000, 64


class Names:
    """A chunk of distinct names, with the product and the length as shown of each."""

    def __init__(self, names: list[str], products: list[int], sizes: list[int], shortest: int):
        order = sorted(range(len(names)), key=lambda i: (len(names[i]), names[i]))
        self.names, self.products, self.sizes = ([x[i] for i in order] for x in (names, products, sizes))
        self.lengths = np.array(list(map(len, self.names)), np.int64)
        self.counts = np.array([letters(n) for n in self.names], np.int32).reshape(-1, LETTERS)
        self.inside = ahocorasick.Automaton()
        for i, n in enumerate(self.names):
            if len(n) >= shortest:
                self.inside.add_word(n, i)
        self.inside.make_automaton()

    def longest(self, text: str) -> int | None:
        """The place of the longest name inside ``text``, ties to the smaller product."""
        if not len(self.inside):
            return None
        hits = {i for _, i in self.inside.iter(text)}
        return min(hits, key=lambda i: (-self.sizes[i], self.products[i]), default=None)

    def closest(self, text: str, least: float) -> tuple[int, float] | None:
        """The place and ratio of the name most like ``text``, ties to the last by alphabet; none below ``least``."""
        n = len(text)
        lo, hi = (int(np.searchsorted(self.lengths, x, side)) for x, side in ((n * least / (2 - least) - 1e-9, "left"), (n * (2 - least) / least + 1e-9, "right")))
        if lo >= hi:
            return None
        most = 2 * np.minimum(self.counts[lo:hi], np.array(letters(text), np.int32)).sum(axis=1) / np.maximum(1, n + self.lengths[lo:hi])
        match = SequenceMatcher()
        match.set_seq2(text)
        best = None
        for i in np.argsort(-most, kind="stable").tolist():
            if most[i] < least or best and most[i] < best[0]:
                break
            match.set_seq1(self.names[lo + i])
            ratio = match.ratio()
            if ratio >= least and (best is None or (ratio, self.names[lo + i]) > best[:2]):
                best = ratio, self.names[lo + i], lo + i
        return best and (best[2], best[0])


def letters(text: str) -> list[int]:
    """How many letters fall to each counter: equal letters to equal ones, so common ones are never counted too low."""
    return np.bincount(np.array([ord(c) % LETTERS for c in text], np.int64), minlength=LETTERS).tolist()


def name_lookup(texts: DataFrame, products: DataFrame, key: str, text: str, least: float = 0.6, shortest: int = 6) -> DataFrame:
    """``(key, product_id, similarity, inside)``: for each text of ``texts`` the longest name of ``products(product_id, title)``, of ``shortest`` letters or more, inside it.

    Without one, the name that is most like the text without its punctuation: twice the letters of their matching blocks by the
    letters of both, ``least`` or more. Both are compared in lower case; of products of one name the smallest id counts. Texts
    are read whole; null texts and null titles match nothing; of rows of one key the best match is that key's; no rows give no rows.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = products.where(F.col("title").isNotNull() & F.col("product_id").isNotNull()).select(norm(F.col("title")).alias("text"), F.col("product_id").cast("long").alias("p"), F.length("title").alias("size"))
    known = known.groupBy("text").agg(F.min(F.struct("p", "size")).alias("m")).select("text", "m.*")
    chunks = max(1, -(-known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // CHUNK_BYTES))
    kind = texts.schema[key].dataType
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt_to = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    held = known.select(dealt_to(chunks, "text").alias("chunk"), every(parts, "share"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("key"), "text", "p", "size")
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), norm(F.col(text)).alias("text"))
    came = rows.select(every(chunks, "chunk"), dealt_to(parts, "text", F.lit("share")).alias("share"), F.lit(1).alias("kind"), "key", "text", F.lit(None).cast("long").alias("p"), F.lit(None).cast("int").alias("size"))
    dealt = held.unionByName(came).repartition(parts, "chunk", "share").sortWithinPartitions("chunk", "share", "kind")
    fields = ["key", "inside", "rank", "name", "p", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, names = None, ([], [], []), None
        for batch in batches:
            places, out = [], []
            for at, (chunk, share, kind, said, p, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5, 6)), strict=True)):
                if (chunk, share) != now:
                    now, kept, names = (chunk, share), ([], [], []), None
                if not kind:
                    for x, v in zip(kept, (said, p, size), strict=True):
                        x.append(v)
                    continue
                names = names or Names(*kept, shortest)
                i = names.longest(said)
                found = (i, 1.0) if i is not None else names.closest(re.sub(r"[^\w\s]", "", said), least)
                if found:
                    places.append(at)
                    j, ratio = found
                    out.append((i is not None, float(names.sizes[j]) if i is not None else ratio, "" if i is not None else names.names[j], names.products[j], ratio))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.bool_(), pa.float64(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(places, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=fields)

    schema = T.StructType([T.StructField("key", kind), *T.StructType.fromDDL("inside boolean, rank double, name string, p long, similarity double").fields])
    best = F.max(F.struct("inside", "rank", "name", (-F.col("p")).alias("q"), "similarity")).alias("m")
    found = dealt.mapInArrow(run, schema).groupBy("key").agg(best)
    return found.select(F.col("key").alias(key), (-F.col("m.q")).alias("product_id"), "m.similarity", "m.inside")
