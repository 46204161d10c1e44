"""Toxicity by a linear-chain conditional random field over words.

Two states: O (other) and T (toxic). A word's features are itself, its prefixes and its suffix,
hashed into a table of fixed size. No table labels words; the chain learns from labels derived
from those of the documents: in a document marked toxic, a word is T if it, or a prefix of it, is
many times as frequent in toxic documents as in clean ones. With two states, forward and backward
messages are one ratio each, so a whole block of documents moves forward a word at a time. The
marginals of T give spans, and their largest
value and sum give the document's score by a logistic fit on the training documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.functions.storage import written
from labelmatch.llm.tokens import coded_blocks, trimmed

WORDS = r"[\p{L}\p{N}\p{M}]+"
FEATURES = 1 << 18
PREFIXES = (3, 4, 5, 6)
#: Characters of text that are scored at once.
BLOCK_CHARS = 1_000_000
#: Words of a sequence after which it is cut into segments.
SEGMENT = 64
#: A word is labelled T if it is so many times as frequent in toxic documents, and the G statistic of that is so high.
RATIO, SIGNIFICANT = 8.0, 18.0
#: Words in a training sequence.
SEQUENCE = 40


def _guilty(toxic: np.ndarray, n: int, clean: np.ndarray, m: int) -> np.ndarray:
    """Which keys stand in so many of n toxic and so few of m clean documents that they mark toxic words."""
    share = (toxic + clean) / (n + m)
    g = np.zeros(len(toxic))
    for x, e in ((toxic, n * share), (n - toxic, n * (1 - share)), (clean, m * share), (m - clean, m * (1 - share))):
        g += 2 * np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(e, 1e-12)), 0)
    return ((toxic + 0.5) * (m + 1) / ((clean + 0.5) * (n + 1)) >= RATIO) & (g >= SIGNIFICANT)


def _features(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the numbers of the words that have it, and their places in the table."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    kinds = [("word", words, 1), ("suffix", pc.utf8_slice_codeunits(words, start=-3), 1), *((f"prefix {n}", pc.utf8_slice_codeunits(words, start=0, stop=n), n) for n in PREFIXES)]
    for name, part, least in kinds:
        have = np.flatnonzero(size >= least)
        hashed = hash_array(part.to_numpy(zero_copy_only=False)[have], hash_key=name.ljust(16, "-"), categorize=False)
        yield have, (hashed % np.uint64(FEATURES)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    #: Scores of O->O, O->T, T->O, T->T, and of T at the start.
    moves: np.ndarray
    #: Of the document's score: constant, largest log odds, log1p of the sum of marginals, log of their share of the words.
    document: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(words))
        for have, at in _features(pa.array(words, pa.string())):
            total[have] += self.weights[at]
        return np.clip(total, -30, 30)


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the sequences from long to short, and how many are longer than t."""
    return np.argsort(-counts, kind="stable"), len(counts) - np.searchsorted(np.sort(counts), np.arange(counts.max() if len(counts) else 0), side="right")


def _pass(gain: np.ndarray, counts: np.ndarray, into_t: tuple[float, float], into_o: tuple[float, float], first: np.ndarray) -> np.ndarray:
    """``r`` along each sequence: ``first`` at its first word, then r = g (p + q r) / (u + v r) with the word's gain g, (p, q) = ``into_t``, (u, v) = ``into_o``.

    A long sequence is cut into segments of SEGMENT words that move forward side by side: the step of a word is a
    fraction in r, so a whole segment is one too (a 2 x 2 matrix); these give each segment its first value.
    """
    (p, q), (u, v) = into_t, into_o
    starts = np.cumsum(counts) - counts
    pieces = -(-counts // SEGMENT)
    owner = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, size = starts[owner] + number * SEGMENT, np.minimum(SEGMENT, counts[owner] - number * SEGMENT)
    out = np.empty_like(gain)
    out[begin[number == 0]] = first[counts > 0]
    long = np.flatnonzero(number < pieces[owner] - 1)  # segments that another one follows
    if len(long):
        a, b, c, d = np.ones(len(long)), np.zeros(len(long)), np.zeros(len(long)), np.ones(len(long))
        for t in range(1, SEGMENT + 1):  # from a segment's first value to that of the next segment
            g = gain[begin[long] + t]
            a, b, c, d = g * (p * c + q * a), g * (p * d + q * b), u * c + v * a, u * d + v * b
            top = a + b + c + d
            a, b, c, d = a / top, b / top, c / top, d / top
        followed = np.maximum(pieces - 1, 0)
        order, longer = _steps(followed)
        at = (np.cumsum(followed) - followed)[order]  # where a sequence's segments begin among those of ``long``
        value = first[order].astype(float)
        for t, n in enumerate(longer):
            k = at[:n] + t
            value[:n] = (a[k] * value[:n] + b[k]) / (c[k] * value[:n] + d[k])
            out[begin[long[k]] + SEGMENT] = value[:n]
    order, longer = _steps(size)
    begin = begin[order]
    for t, n in enumerate(longer):
        if t:
            at = begin[:n] + t
            r = out[at - 1]
            out[at] = gain[at] * (p + q * r) / (u + v * r)
    return out


def messages(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios T : O at each word; the log odds of T are log(forward * backward)."""
    oo, ot, to, tt = np.exp(moves[:4])
    odds = np.exp(scores)
    starts = np.cumsum(counts) - counts
    first = np.zeros(len(counts))
    first[counts > 0] = odds[starts[counts > 0]] * np.exp(moves[4])
    ahead = _pass(odds, counts, (ot, tt), (oo, to), first)
    # Backwards over the reversed words, with r the ratio times the word's odds: r = odds (to + tt r) / (oo + ot r).
    odds, counts = odds[::-1], counts[::-1]
    first[counts > 0] = odds[(np.cumsum(counts) - counts)[counts > 0]]
    first[counts == 0] = 0
    return ahead, (_pass(odds, counts, (to, tt), (oo, ot), first) / odds)[::-1]


def _train_chain(codes: np.ndarray, truth: np.ndarray, counts: np.ndarray, words: list[str], rounds: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with an L2 penalty, by Adam over all sequences: ``counts`` words each, ``words[codes]`` with their labels."""
    owner, feature = (np.concatenate(x) for x in zip(*_features(pa.array(words, pa.string())), strict=True))
    first = np.cumsum(counts) - counts
    later = np.ones(len(codes), bool)
    later[first] = False
    later = np.flatnonzero(later)
    weights, moves = np.zeros(FEATURES), np.array([0.0, -3.0, 0.0, 0.0, -3.0])
    mean = [np.zeros(FEATURES), np.zeros(5)]
    var = [np.zeros(FEATURES), np.zeros(5)]
    for step in range(1, rounds + 1):
        emit = np.clip(np.bincount(owner, weights[feature], len(words)), -30, 30)
        scores = emit[codes]
        ahead, back = messages(scores, counts, moves)
        odds = ahead * back
        wrong = odds / (1 + odds) - truth
        by_word = np.bincount(codes, wrong, len(words))
        pull = np.bincount(feature, by_word[owner], FEATURES) + l2 * weights
        r, b = ahead[later - 1], np.exp(scores[later]) * back[later]
        pair = np.stack([np.exp(moves[0]) * np.ones_like(r), np.exp(moves[1]) * b, np.exp(moves[2]) * r, np.exp(moves[3]) * r * b])
        y0, y1 = truth[later - 1], truth[later]
        seen = np.stack([(1 - y0) * (1 - y1), (1 - y0) * y1, y0 * (1 - y1), y0 * y1])
        pull_moves = np.append((pair / pair.sum(axis=0) - seen).sum(axis=1), wrong[first].sum()) + l2 * moves
        for value, grad, m, v in ((weights, pull, mean[0], var[0]), (moves, pull_moves, mean[1], var[1])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weights, moves


def _summaries(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log odds of T at each word; a row for each document: the values that ``Model.document`` weighs."""
    if len(scores):
        ahead, back = messages(scores, counts, moves)
        odds = np.clip(np.log(ahead) + np.log(back), -15, 15)
    else:
        odds = scores
    starts = np.cumsum(counts) - counts
    top = np.where(counts > 0, np.maximum.reduceat(np.append(odds, -15.0), starts), -15.0) if len(counts) else np.empty(0)
    total = np.where(counts > 0, np.add.reduceat(np.append(1 / (1 + np.exp(-odds)), 0.0), starts), 0.0) if len(counts) else np.empty(0)
    return odds, np.stack([np.ones(len(counts)), top, np.log1p(total), np.log((total + 0.1) / (counts + 10))], axis=1)


def _logistic(rows: np.ndarray, truth: np.ndarray, l2: float = 1.0) -> np.ndarray:
    beta = np.zeros(rows.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        pull = rows.T @ (p - truth) + l2 * np.append(0, beta[1:])
        beta -= np.linalg.solve((rows.T * (p * (1 - p) + 1e-6)) @ rows + l2 * np.eye(len(beta)), pull)
    return beta


def sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """``(text, toxic)`` of about ``per_class`` labelled rows of either class, chosen by a hash of the id; equal texts of a class once."""
    marks = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}  # two rows at most
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / sizes.get(1, 1))).otherwise(min(1.0, per_class / sizes.get(0, 1)))
    chosen = marks.where(F.xxhash64("id", F.lit("toxicity")) / 2.0**64 + 0.5 < share)
    texts = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    joined = texts.join(F.broadcast(chosen), "id")  # per_class bounds the broadcast side
    return joined.groupBy("toxic", F.md5("text"), F.crc32("text")).agg(F.first("text").alias("text")).select("text", "toxic")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts hold each word, and each prefix of a word; the key without letters counts the texts."""
    find = regex.compile(WORDS).findall
    for batch in batches:
        counts: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = set(find(text.as_py().lower()))
            counts["", 0][toxic] += 1
            for w in words:
                counts[w, 0][toxic] += 1
            for begin in {w[:n] for w in words for n in PREFIXES[1:] if len(w) >= n}:
                counts[begin, 1][toxic] += 1
        keys = list(zip(*counts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (1, 0))], names=["key", "prefix", "toxic", "clean"])


def _sequences(batches: Iterator[pa.RecordBatch], words: frozenset[str], prefixes: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Sequences of SEQUENCE words with a label for each word: T in a toxic text if the word, or a prefix of it, marks toxic words."""
    find = regex.compile(WORDS).findall
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            said = find(text.as_py().lower())
            label = [bool(toxic) and (w in words or any(w[:n] in prefixes for n in PREFIXES[1:])) for w in said]
            cuts = range(0, len(said), SEQUENCE)
            marks = [label[at : at + SEQUENCE] for at in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([said[at : at + SEQUENCE] for at in cuts], pa.list_(pa.string())), pa.array(marks, pa.list_(pa.bool_())), pa.array(list(map(any, marks)), pa.bool_())], names=["words", "labels", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, sequences: int = 5000, rounds: int = 60, l2: float = 0.1) -> Model:
    """Learn from the documents that ``labels`` marks (``toxic`` 0 or 1).

    Two bounds: ``per_class`` is about how many labelled rows of either class are learned from; ``sequences``
    is about how many of their sequences of SEQUENCE words train the chain, of those with a toxic word and of
    those without one. Both are chosen by hashes. No table holds labels of words: these are derived from those of the
    documents. Texts stay in the tasks; the driver gets counts of the words that mark toxic ones, the chosen sequences,
    and four numbers for each text. Without both classes the model knows no toxic word and its scores are below 0.5.
    """
    none = Model(np.zeros(FEATURES, np.float32), np.array([0.0, -3.0, 0.0, 0.0, -3.0]), np.array([-1.0, 0.0, 0.0, 0.0]))
    held = written(sample(docs, labels, per_class), "toxicity-sample")
    met = held.mapInArrow(_met, "key string, prefix int, toxic long, clean long").groupBy("key", "prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    met = written(met, "toxicity-words")
    total = met.where("key = '' and prefix = 0").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    n_toxic, n_clean = int(total[0]), int(total[1])
    if not n_toxic or not n_clean:
        return none
    keys = met.where("key <> '' and toxic > 1").where(F.col("toxic") * n_clean > F.col("clean") * n_toxic).toArrow()  # at most the words of the sample
    marked = keys.filter(pa.array(_guilty(keys.column("toxic").to_numpy().astype(float), n_toxic, keys.column("clean").to_numpy().astype(float), n_clean)))
    words, prefixes = (frozenset(k for k, p in zip(marked.column("key").to_pylist(), marked.column("prefix").to_pylist(), strict=True) if p == kind) for kind in (0, 1))
    cut = written(held.mapInArrow(lambda b: _sequences(b, words, prefixes), "words array<string>, labels array<boolean>, toxic boolean"), "toxicity-sequences")
    sizes = {r["toxic"]: r["count"] for r in cut.groupBy("toxic").count().collect()}  # two rows at most
    if not sizes.get(True):
        return none
    share = F.when(F.col("toxic"), min(1.0, sequences / sizes[True])).otherwise(min(1.0, sequences / sizes.get(False, 1)))
    kept = cut.where(F.xxhash64("words", F.lit("toxicity")) / 2.0**64 + 0.5 < share).select("words", "labels").toArrow().combine_chunks()
    said = kept.column("words").combine_chunks()
    counts = said.value_lengths().to_numpy().astype(np.int64)
    coded = said.flatten().dictionary_encode()
    truth = kept.column("labels").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    weights, moves = _train_chain(coded.indices.to_numpy(), truth, counts, coded.dictionary.to_pylist(), rounds, l2)
    model = Model(weights.astype(np.float32), moves, none.document)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, _ in _summarised(batch, 0, shared.value):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(rows)).cast(pa.float64()), *(pa.array(rows[:, i]) for i in range(rows.shape[1]))], names=["toxic", "a", "b", "c", "d"])

    seen = held.mapInArrow(summarise, "toxic double, a double, b double, c double, d double").orderBy("a", "b", "c", "d", "toxic").toArrow()  # a row for each text of the sample
    model.document = _logistic(np.stack([seen.column(c).to_numpy() for c in "abcd"], axis=1), seen.column("toxic").to_numpy())
    return model


def _summarised(batch: pa.RecordBatch, text_at: int, model: Model) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For each block of rows: where it starts, a row of ``Model.document``'s values for each text, and the log odds of its words."""
    pattern = regex.compile(WORDS)
    find = lambda text: pattern.findall(text.lower())
    for start, _, counts, codes, words in coded_blocks(batch, find, BLOCK_CHARS, text_at):
        odds, seen = _summaries(model.emissions(words)[codes], counts, model.moves)
        yield start, seen, np.split(odds, np.cumsum(counts)[:-1])


def _probability(seen: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(seen @ model.document, -30, 30)))


def _spans(text: str, odds: np.ndarray) -> list[dict]:
    """The words of ``text`` at least as likely T as O."""
    hit = np.flatnonzero(odds >= 0)
    if not len(hit):
        return []
    places = [m.span() for m in regex.compile(WORDS).finditer(text)]
    if len(places) != len(odds):  # lower-casing changed the words: find each by the length of what stands before it
        places = _lowered_places(text)
    return [{"start": places[i][0], "end": places[i][1], "marginal": float(1 / (1 + np.exp(-odds[i])))} for i in hit.tolist()]


def _lowered_places(text: str) -> list[tuple[int, int]]:
    """The places in ``text`` of the words of ``text.lower()``, where a character may become several."""
    back = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(back[a], back[z - 1] + 1) for a, z in (m.span() for m in regex.compile(WORDS).finditer(text.lower()))]


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("marginal", "double"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, spans)`` for each row of ``docs``: spans hold the words at least as likely T as O, in code points.

    Null and empty texts are scored as texts without words; repeated rows give repeated rows; no rows give no rows;
    further columns are ignored. A text of any length is scored whole: a longer one than BLOCK_CHARS is a block of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, seen, odds in _summarised(batch, 1, shared.value):
                found = [_spans(batch.column(1)[at + i].as_py() or "", o) if len(o) else [] for i, o in enumerate(odds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(seen)), pa.array(_probability(seen, shared.value)), pa.array(found, kind)], names=["id", "score", "spans"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``limit``.

    Null and empty texts are scored as texts without words; of repeated rows all stay or all go; no rows give no
    rows; a text of any length is scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, seen, _ in _summarised(batch, at, shared.value):
                yield batch.slice(start, len(seen)).filter(pa.array(_probability(seen, shared.value) < limit))

    return docs.mapInArrow(trimmed(run), docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows to learn from: crc32(doc_id) mod 5 is not 0."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold, score all; a null doc_id is not held out."""
    out = score(docs, fit(docs, training_labels(labels)))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), spans.alias("spans"))
