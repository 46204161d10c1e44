"""Document likelihood by subword lattices.

A word, led by a space, is cut into pieces of an existing vocabulary in every possible way; a single byte is
always a piece, so every text can be cut. A cutting is as likely as the product of its pieces, a word as the sum over
its cuttings, and a document as the product of its words and one end. No piece reaches from one word into the
next, so a document's lattice is a chain of its words' lattices, and each distinct word is worked out once.

The sum is a forward recursion in log space: at each byte of a word, the logarithms of the pieces that end there are
added to those of the places where they begin. The scores that the vocabulary brings weight the cuttings of
the training words first; how often each piece is then expected, together with those scores as a prior, gives the
pieces' probabilities, for ``rounds`` rounds. The vocabulary itself stays as it is.

Neighbouring documents form blocks. A block keeps, for each document, the places of its words in the block's
list of distinct words, and only the lists are shuffled: to count the words of all training documents, and to meet
the distinct words' likelihoods. A word is one row for each block that has it, so a frequent one is no hot key
for the counts, and a join that Spark may split for the answers.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.functions.storage import written
from labelmatch.llm.tokens import trimmed

#: Bytes of text in a block, bytes of words whose lattices are held at once, and the prior's weight in pieces.
BLOCK_BYTES, LATTICE_BYTES, PRIOR = 24_000_000, 200_000, 1000.0
#: The prior's share of an end.
END = 1e-3
LN10 = math.log(10)


@dataclass
class Model:
    """A trie over the pieces' bytes, and the natural logarithms of their probabilities and of an end's."""

    keys: np.ndarray  # state << 8 | byte, in order
    targets: np.ndarray
    piece: np.ndarray  # by state, -1 within a piece
    logs: np.ndarray
    end: float

    def step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The states that the bytes lead to, -1 where no piece goes on."""
        asked = states << 8 | data
        at = np.searchsorted(self.keys, asked)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == asked, self.targets[at], -1)


def read_vocabulary(path: str) -> dict[bytes, float]:
    """The pieces of a sentencepiece model and their weights, which sum to 1; a word's mark is a space.

    Scores of a unigram model are log probabilities. Those of a merge model are negative ranks, which weigh 1 / (1 + rank), as
    Zipf's law has it. Bytes that are no pieces, or byte pieces, weigh as much as the least of the other pieces.
    """
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [i for i in range(held.vocab_size()) if not (held.is_control(i) or held.is_unknown(i) or held.is_unused(i) or held.is_byte(i))]
    scores = {held.id_to_piece(i).replace("▁", " ").encode(): held.get_score(i) for i in every}
    ranks = all(s <= 0 and s == int(s) for s in scores.values())
    weights = {p: 1 / (1 - s) if ranks else math.exp(s) for p, s in scores.items() if p}
    least = min((w for w in weights.values() if w > 1e-8), default=1.0)
    weights |= {bytes([b]): weights.get(bytes([b]), least) for b in range(256)}
    total = sum(weights.values())
    return {p: w / total for p, w in weights.items()}


def model_of(weights: dict[bytes, float], end: float = END) -> Model:
    """The model of the given weights of pieces, which leave ``end`` to an end."""
    child: dict[int, int] = {}
    piece = [-1]
    for number, token in enumerate(weights):
        state = 0
        for byte in token:
            key = state << 8 | byte
            if key not in child:
                child[key] = len(piece)
                piece.append(-1)
            state = child[key]
        piece[state] = number
    keys = np.array(sorted(child), np.int64)
    return Model(keys, np.array([child[k] for k in keys.tolist()], np.int64), np.array(piece, np.int64), np.log(np.fromiter(weights.values(), float)) + math.log1p(-end), math.log(end))


def forward(words: list[bytes], model: Model, times: np.ndarray | None = None, totals: np.ndarray | None = None) -> np.ndarray:
    """The natural log of each word's probability. With ``times``, each word's pieces as often as they are expected are added to ``totals``."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    data = np.frombuffer(b" " + b" ".join(words), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    left = ends[word] - np.arange(len(data))  # bytes to the word's end
    begins, lengths, pieces = [], [], []
    at, states, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
    while len(at):
        states = model.step(states, data[at + depth])
        depth += 1
        found = model.piece[states]
        hit = np.flatnonzero((states >= 0) & (found >= 0))
        begins.append(at[hit])
        pieces.append(found[hit])
        lengths.append(np.full(len(hit), depth))
        on = np.flatnonzero((states >= 0) & (left[at] > depth))
        at, states = at[on], states[on]
    begin, length, piece = np.concatenate(begins), np.concatenate(lengths), np.concatenate(pieces)
    own = word[begin]
    start = begin + own  # a word of n bytes has n + 1 places
    offset = begin + length - (ends - sizes)[own]
    order = np.argsort(offset * len(words) + own)
    own, start, piece, offset = own[order], start[order], piece[order], offset[order]
    stop = start + length[order]
    groups = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]]))  # the pieces that end at one place
    levels = np.searchsorted(offset[groups], np.arange(1, int(sizes.max()) + 2))
    edges = np.append(groups, len(stop))
    alpha, share = np.zeros(len(data) + len(words)), np.empty(len(stop))
    logs = model.logs[piece]
    for a, b in zip(levels.tolist(), levels[1:].tolist(), strict=False):
        lo, hi = edges[a], edges[b]
        here = groups[a:b] - lo
        several = np.diff(edges[a : b + 1])
        sums = alpha[start[lo:hi]] + logs[lo:hi]
        top = np.maximum.reduceat(sums, here)
        total = top + np.log(np.add.reduceat(np.exp(sums - np.repeat(top, several)), here))
        alpha[stop[groups[a:b]]] = total
        if times is not None:
            share[lo:hi] = np.exp(sums - np.repeat(total, several))  # of what arrives at a place, by its last piece
    last = ends + np.arange(len(words))
    if times is not None:
        seen = np.zeros(len(alpha))
        seen[last] = times
        for a, b in zip(levels[-2::-1].tolist(), levels[:0:-1].tolist(), strict=False):
            lo, hi = edges[a], edges[b]
            share[lo:hi] *= seen[stop[lo:hi]]
            np.add.at(seen, start[lo:hi], share[lo:hi])
        totals += np.bincount(piece, weights=share, minlength=len(totals))
    return alpha[last]


def _in_lattices(words: list[bytes]) -> Iterator[np.ndarray]:
    """Places of words of like length, up to LATTICE_BYTES bytes; a longer word is alone."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    upto = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LATTICE_BYTES, "right")))
        yield order[at:stop]
        at = stop


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring documents, over any number of batches: a row for each, of place -1, and one for each distinct word."""
    ids, trained, counts, size, made = [], [], array("q"), 0, 0
    kind = None
    places: defaultdict = defaultdict()
    codes = array("I")

    def block() -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 32) + made
        coded, sizes = np.frombuffer(codes, np.uint32), np.frombuffer(counts, np.int64)
        n = np.bincount(coded[np.repeat(np.array(trained, bool), sizes)], minlength=len(places))
        data = zstandard.ZstdCompressor(level=3).compress(coded.tobytes())
        one = [pa.array([number]), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([sum(trained)], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary())]
        yield pa.RecordBatch.from_arrays(one, names=names)
        words = pa.array(list(places), pa.binary())
        for at in range(0, len(words), 10_000):
            part = words.slice(at, 10_000)
            none = [pa.nulls(len(part), x.type) for x in one[4:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), part, pa.array(n[at : at + len(part)].astype(np.int64)), *none], names=names)

    for batch in batches:
        kind = batch.column(0).type
        for own, text, train in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            said = (text.as_py() or "").encode()
            if ids and size + len(said) > BLOCK_BYTES:
                yield from block()
                made += 1
                ids, trained, counts, codes, size = [], [], array("q"), array("I"), 0
                places = defaultdict()
            places.default_factory = places.__len__  # a new word takes the next place
            words = said.lower().split()  # bytes: only A-Z change, only \\x20 and \\x09-\\x0D split
            codes.extend(map(places.__getitem__, words))
            counts.append(len(words))
            ids.append(own.as_py())
            trained.append(bool(train.as_py()))
            size += len(said)
    if ids:
        yield from block()


def split(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """Blocks ``(block, place, word, n, ids, counts, codes)``: of place -1 for the documents, ``n`` of them to learn from, and one of each word, ``n`` times in those."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    schema = T.StructType().add("block", "long").add("place", "integer").add("word", "binary").add("n", "long").add("ids", T.ArrayType(docs.schema[id_col].dataType)).add("counts", T.ArrayType(T.LongType())).add("codes", "binary")
    return written(source.mapInArrow(trimmed(lambda b: _blocks(b, schema.names)), schema), "lattice-blocks")


def fit(counts: DataFrame, documents: int, vocabulary: dict[bytes, float], rounds: int = 2, prior: float = PRIOR) -> Model:
    """Learn the pieces' probabilities from ``counts(word, c)`` of the words in ``documents`` training documents.

    Every training word takes part. What comes to the driver in each round is one number for each piece of the vocabulary.
    """
    spark = counts.sparkSession
    model = model_of(vocabulary)
    weights = np.fromiter(vocabulary.values(), float)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # of fixed size: the vocabulary

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            totals = np.zeros(len(shared.value.logs))
            for batch in batches:
                words, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for at in _in_lattices(words):
                    forward([words[i] for i in at.tolist()], shared.value, times[at], totals)
            some = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], names=["piece", "n"])

        found = counts.where("c > 0").select("word", "c").mapInArrow(trimmed(expect), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        expected = prior * weights * (1 - END)
        expected[found.column("piece").to_numpy()] += found.column("n").to_numpy()
        ends = documents + prior * END
        total = expected.sum() + ends
        model = Model(model.keys, model.targets, model.piece, np.log(expected / total), math.log(ends / total))
    return model


def likelihoods(counts: DataFrame, model: Model) -> DataFrame:
    """``counts(word, c)`` and ``lp``, the log10 of each word's probability."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lp = batch.column(0).to_pylist(), np.empty(len(batch))
            for at in _in_lattices(words):
                lp[at] = forward([words[i] for i in at.tolist()], shared.value) / LN10
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lp)], names=["word", "c", "lp"])

    return counts.select("word", "c").mapInArrow(trimmed(run), "word binary, c long, lp double")


def score(docs: DataFrame, vocabulary: dict[bytes, float], train: Column, rounds: int = 2, prior: float = PRIOR, smoothing: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``, learned from those where ``train`` holds.

    Tokens are the words between white space, A-Z lower-cased, and one end. ``base_score`` is the log10 probability by the smoothed
    frequencies of whole tokens, ``score`` that by the lattices; both are sums over a document's tokens.

    Null and empty texts are an end alone; rows where ``train`` is null are not learned from; repeated rows count as often as
    they are there; null ids stay null; without rows to learn from the vocabulary's own weights decide, and ``base_score``
    has every token of one probability; no rows give no rows; further columns are ignored. A text longer than a block is a block of its own.
    """
    blocks = split(docs, train, id_col, text_col)
    words = blocks.where("place >= 0")
    counts = written(words.groupBy("word").agg(F.sum("n").alias("c")), "lattice-counts")
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = blocks.where("place < 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, distinct = seen[0] + ends, seen[1] + bool(ends)
    model = fit(counts, ends, vocabulary, rounds, prior)
    told = words.select("block", "place", "word").join(written(likelihoods(counts, model), "lattice-words"), "word").select(F.col("block").alias("of"), F.col("place").alias("at"), "c", "lp")
    base = lambda c: np.log10((c + smoothing) / (tokens + smoothing * (distinct + 1)))
    last = model.end / LN10

    def gather(block: pa.Table, told: pa.Table) -> pa.Table:
        place = told.column("at").to_numpy()
        c, lp = np.zeros(len(place), np.int64), np.zeros(len(place))
        c[place], lp[place] = told.column("c").to_numpy(), told.column("lp").to_numpy()
        ids, counts = block.column("ids")[0].values, block.column("counts")[0].values.to_numpy()
        codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.column("codes")[0].as_py()), np.uint32)
        doc = np.repeat(np.arange(len(counts)), counts)
        total = lambda of: np.bincount(doc, weights=of[codes], minlength=len(counts))
        n = pa.array(np.full(len(counts), tokens, np.int64))
        return pa.table([ids, pa.array(counts + 1), pa.array(total(c > 0).astype(np.int64) + bool(ends)), n, pa.array(total(base(c)) + base(ends)), pa.array(total(lp) + last)], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return blocks.where("place < 0").select("block", "ids", "counts", "codes").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(gather, schema)


def op12_lattice(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows whose crc32(doc_id) mod 10 is 0 are held out; a null doc_id is neither held out nor learned from."""
    import public_tokenizers

    remainder = lambda c: F.crc32(c.cast("string")) % 10
    out = score(docs, read_vocabulary(vocabulary or public_tokenizers.path("piece_bpe_32k.model")), remainder(F.col("doc_id")) != 0)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(remainder(F.col("id")) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
