"""Byte-level BPE by a global shuffle of distinct words.

1. Texts are cut into pre-tokens; a block of neighbouring documents keeps, for each of its
   distinct words, one place in a word list, and for each document the places of its pre-tokens
   in order (the positions). Blocks are written once, in buckets, to the shared folder.
2. The word lists are dealt out by the word's hash, so all mentions of a word meet in one task,
   which encodes each distinct word once and answers with the ids, still under the block's places.
3. The answers return to their block, and each document is put together by position.

Decoding joins each id with the token-byte table, whose size is fixed by the vocabulary.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.functions.storage import bucketed
from labelmatch.llm.tokens import trimmed

#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 8_000_000
#: Words whose ids a task keeps at a time.
KEPT_WORDS = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _pack(*arrays: np.ndarray, raw: bytes = b"") -> bytes:
    """Arrays of uint32, each with its lowest bytes first and its highest last, then ``raw``; compressed."""
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(planes) + raw)


def _unpack(data: bytes, n_arrays: int) -> tuple[list[np.ndarray], bytes]:
    held = zstandard.ZstdDecompressor().decompress(data)
    at, out = 4 * n_arrays, []
    for n in np.frombuffer(held, "<u4", n_arrays).tolist():
        planes = np.frombuffer(held, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))
        at += 4 * n
    return out, held[at:]


def _by_frequency(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times, kind="stable")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the pieces [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0)) + int(lengths.max(initial=0))) < 1 << 31 else np.int64
    out = np.repeat((starts - ends + lengths).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def _split(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, n_buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring rows up to ``limit`` characters, over any number of batches; a row for each, and one for each bucket that has words of it."""
    find = regex.compile(pattern).findall
    made, kind = 0, None
    held: list = []
    places: defaultdict = defaultdict()
    codes, counts, size = array("I"), [], 0

    def block() -> pa.RecordBatch:
        words, coded = [w.encode() for w in places], np.frombuffer(codes, np.uint32)
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
        order = pc.sort_indices(pa.table({"b": bucket, "w": pa.array(words, pa.binary())}), [("b", "ascending"), ("w", "ascending")]).to_numpy()
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        coded = place[coded]
        times = np.bincount(coded, minlength=len(words))
        rank = np.empty(len(words), np.int64)
        rank[_by_frequency(times)] = np.arange(len(words))  # small codes for frequent words
        number = (TaskContext.get().partitionId() << 32) + made
        rows = [(number, -1, 0, _pack(np.array(counts, np.int64), times, rank[coded]))]
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            mine = [words[i] for i in order[edges[b] : edges[b + 1]]]
            rows.append((number, int(b), int(edges[b]), _pack(np.array(list(map(len, mine)), np.int64), raw=b"".join(mine))))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
        cols.append(pa.array([held] + [None] * (len(rows) - 1), pa.list_(kind)))
        return pa.RecordBatch.from_arrays(cols, names=["block", "bucket", "first", "data", "ids"])

    for batch in batches:
        kind = batch.column(0).type
        for own, text in zip(batch.column(0), batch.column(1), strict=True):
            said = text.as_py() or ""
            if counts and size + len(said) > limit:
                yield block()
                made += 1
                held, places, codes, counts, size = [], defaultdict(), array("I"), [], 0
            places.default_factory = places.__len__  # a new word takes the next place
            words = find(said)
            codes.extend(map(places.__getitem__, words))
            counts.append(len(words))
            held.append(own.as_py())
            size += len(said)
    if counts:
        yield block()


def _answer(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str) -> Iterator[pa.RecordBatch]:
    """Word lists, bucket by bucket: each distinct word of a bucket is encoded once, or again where more than KEPT_WORDS have passed."""
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    known: dict[bytes, list[int]] = {}
    now = None
    for batch in batches:
        for at in range(len(batch)):
            row = batch.slice(at, 1)
            bucket = row.column("bucket")[0].as_py()
            if bucket != now or len(known) > KEPT_WORDS:
                known.clear()
            now = bucket
            (lengths,), raw = _unpack(row.column("data")[0].as_py(), 1)
            words = [raw[e - k : e] for e, k in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True)]
            for w in words:
                if w not in known:
                    known[w] = encode(w)
            found = [known[w] for w in words]
            data = _pack(np.array(list(map(len, found)), np.int64), np.array([i for f in found for i in f], np.int64))
            yield pa.RecordBatch.from_arrays([row.column("block"), row.column("bucket"), row.column("first"), pa.array([data], pa.binary()), row.column("ids")], names=["block", "bucket", "first", "data", "ids"])


def _reassemble(block: pa.Table, told: pa.Table) -> pa.Table:
    held = block.column("ids")[0].as_py()
    told = told.select(["first", "data"]).sort_by("first")
    answers = [_unpack(data.as_py(), 2)[0] for data in told.column("data")]
    sizes = np.concatenate([np.empty(0, np.int64), *(a for a, _ in answers)])
    ids = np.concatenate([np.empty(0, np.int32), *(b.astype(np.int32) for _, b in answers)])
    del answers
    starts = np.cumsum(sizes) - sizes
    (counts, times, ranks), _ = _unpack(block.column("data")[0].as_py(), 3)
    codes = _by_frequency(times)[ranks]
    lengths = sizes[codes]
    tokens = ids[_ranges(starts[codes], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    kind = block.schema.field("ids").type.value_type
    return pa.table([pa.array(held, kind), _split(ends, tokens)], names=["id", "ids"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """``(id, ids array<int>)`` for each row of ``docs``: each match of ``pattern`` is encoded separately.

    Null and empty texts give an empty array, repeated rows repeated rows, null ids stay null,
    no rows give no rows, further columns are ignored whatever their names, and a text longer than
    a block is a block of its own. ``n_buckets`` is the number of parts of the word shuffle, by default
    ``spark.sql.shuffle.partitions``; a block sends a list to each bucket that has one of its words, so
    lists grow with the distinct words of the blocks, not with the product of blocks and buckets.
    """
    spark = docs.sparkSession
    n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType
    schema = T.StructType().add("block", "long").add("bucket", "integer").add("first", "integer").add("data", "binary").add("ids", T.ArrayType(kind))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # of fixed size: the vocabulary
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = bucketed(source.mapInArrow(trimmed(lambda b: _blocks(b, pattern, n_buckets, BLOCK_CHARS)), schema), "bpe_blocks", "block", n_buckets)
    asked = blocks.where("bucket >= 0").repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(trimmed(lambda b: _answer(b, ranks.value, pattern)), schema)
    texts = blocks.where("bucket < 0")  # in buckets already: only words and answers are shuffled
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_reassemble, T.StructType().add("id", kind).add("ids", T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``tokens`` and the bytes of each row's ids, in order, as column ``to``, which takes the place of one of that name.

    Null and empty ids give no bytes, an unknown id is an error; repeated rows stay; no rows give no rows; further columns pass through.
    """
    tokens = tokens.drop(to) if to != ids_col else tokens
    spark = tokens.sparkSession
    by_id = sorted((rank, token) for token, rank in read_ranks(ranks_path).items())
    sizes = np.zeros(by_id[-1][0] + 1, np.int64)
    for rank, token in by_id:
        sizes[rank] = len(token)
    table = spark.sparkContext.broadcast((b"".join(token for _, token in by_id), sizes))  # of fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, sizes = np.frombuffer(table.value[0], np.uint8), table.value[1]
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            out = []
            for row in range(len(lists)):
                ids = lists[row].values
                ids = np.empty(0, np.int64) if ids is None else ids.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                out.append(data[_ranges(starts[ids], sizes[ids])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, to])

    return tokens.mapInArrow(trimmed(run), T.StructType([*tokens.schema.fields, T.StructField(to, T.BinaryType())]))


def op5_bpe(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(docs, ranks_path, pattern or public_tokenizers.PATTERN), ranks_path)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
