"""Language identification by words first, then ever shorter character n-grams.

A word known from training scores by its log frequency in each language. An unseen word falls
back to its 4-grams, if any is known, then to 3-, 2- and 1-grams (word ends marked), and scores
by their mean log frequency. A text's score is the posterior over the learned languages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.llm.tokens import coded_blocks

LONGEST = 4
BLOCK_CHARS = 4_000_000
#: Distinct words whose scores a task keeps at a time.
KEPT_WORDS = 300_000
LETTERS = r"\p{L}+"


def _grams(word: str, n: int) -> list[str]:
    held = f"_{word}_" if n > 1 else word
    return [held[i : i + n] for i in range(len(held) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    #: By n-gram length, 0 for whole words: the log share of each language's mentions.
    tables: list[dict[str, np.ndarray]]

    def word(self, word: str) -> np.ndarray:
        """Log posterior of the languages given this word alone."""
        found = self.tables[0].get(word)
        if found is None:
            for n in range(LONGEST, 0, -1):
                known = [self.tables[n][g] for g in _grams(word, n) if g in self.tables[n]]
                if known:
                    found = np.mean(known, axis=0)
                    break
            else:
                return np.zeros(len(self.langs))
        return found - np.logaddexp.reduce(found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = regex.compile(LETTERS).findall
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, k in Counter(find((text or "").lower())).items():
                counts[lang, 0, word] += k
                for n in range(1, LONGEST + 1):
                    for gram in _grams(word, n):
                        counts[lang, n, gram] += k
        keys = list(zip(*counts, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "n", "gram", "k"])


def fit(docs: DataFrame, per_lang: int = 2000, least: int = 2, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Learn from ``docs`` with a language and a text.

    ``per_lang`` bounds the sample: about so many rows of each language, chosen by a hash of the
    id, so the model's size has a bound whatever the corpus. Words and n-grams met fewer than
    ``least`` times are left to the back-off. No such rows give a model without languages.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.lit("langid")).alias("h")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Model([], [{} for _ in range(LONGEST + 1)])
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))])
    sample = rows.where((F.col("h") / 2.0**64 + 0.5) < share[F.col("lang")])
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, n int, gram string, k long")
    kept = counts.groupBy("lang", "n", "gram").agg(F.sum("k").alias("k")).where(F.col("k") >= least).toPandas()
    langs = sorted(sizes)
    place = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict[str, np.ndarray]] = []
    for n in range(LONGEST + 1):
        part = kept[kept["n"] == n]
        names, at = np.unique(part["gram"].to_numpy(dtype=object), return_inverse=True)
        grid = np.full((len(names), len(langs)), 0.5)
        np.add.at(grid, (at, part["lang"].map(place).to_numpy(dtype=np.int64)), part["k"].to_numpy(dtype=float))
        logs = np.log(grid / grid.sum(axis=0)).astype(np.float32) if len(names) else grid
        tables.append(dict(zip(names.tolist(), logs, strict=True)))
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for each row of ``docs``.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned. Ties go
    to the first language by name. Repeated rows give repeated rows; no rows give no rows; further columns
    are ignored; a text of any length counts whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        letters = regex.compile(LETTERS).findall
        find = lambda text: letters(text.lower())
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            names, scores = [], []
            for start, stop, counts, codes, words in coded_blocks(batch, find, BLOCK_CHARS):
                if not model.langs or not len(codes):
                    names += ["und"] * (stop - start)
                    scores += [0.0] * (stop - start)
                    continue
                if len(known) > KEPT_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = model.word(w)
                each = np.array([known[w] for w in words])[codes]
                sums = np.add.reduceat(np.vstack([each, np.zeros((1, each.shape[1]))]), np.cumsum(counts) - counts)
                sums = sums / np.sqrt(np.maximum(counts, 1))[:, None]
                post = np.exp(sums - np.logaddexp.reduce(sums, axis=1)[:, None])
                best = post.argmax(axis=1)
                names += [model.langs[b] if n else "und" for b, n in zip(best.tolist(), counts.tolist(), strict=True)]
                scores += np.where(counts > 0, post.max(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op2_langid(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 3 is not 1, predict all; a null doc_id is neither learned from nor held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs.where(fold != 1))
    out = predict(docs, model)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")
