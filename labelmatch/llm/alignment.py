"""Two tokenizers aligned by the bytes of their tokens, and pairs of tokens counted by external spills.

A document's tokens of either side cover the same bytes. Where tokens of both sides end at one byte, these two are
linked, and what lies between two such places is a group.

How often a pair is linked is counted over all documents. Neighbouring documents form blocks; a block's
records, a pair and how many of its links are of that pair, are cut by the radix of B's id and sorted with B first, so each
radix has a run in every block, packed in zstd frames; which document a link is of stays with the block. The
runs of a radix are merged by a heap, FAN of them at a time and, where there are more, their merged runs again, so
no task holds more than a frame of each run. Equal pairs come one after the other and are added up. All pairs of one
token of B come together, so the last merge also knows which of them is the most frequent. The counts
then stream back along each block's runs and are summed by document where the block's links are.

A token that a third of all links hold is one record for each block and pair, never a row for each link.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.functions.storage import written
from labelmatch.llm.tokens import trimmed

#: Bytes of text in a block, radices, pairs in a frame, runs that are merged at once, and stretches whose tokens are remembered.
BLOCK_BYTES, RADIX, FRAME, FAN, KEPT = 4_000_000, 64, 4096, 64, 300_000
#: Bits of an id in a key: radix, B's id, A's id.
BITS = 28


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def read_byte_level(path: str) -> dict[bytes, int]:
    """The bytes and ids of a byte-level BPE in a tokenizer's JSON file, whose ids must be in the order of its merges; added tokens are left out."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = byte_letters()
    ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [model["vocab"][m] for m in made]
    if order != sorted(order):
        raise ValueError("the ids are not in the order of the merges")
    merged = {bytes(letters[c] for c in m) for m in made}
    return {t: i for t, i in ids.items() if len(t) == 1 or t in merged}


class Sides:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: bytes):
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        marked = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_a = _bytes_of(ranks)
        self.bytes_b = _bytes_of({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(marked)}, turned=False)
        # A piece begins with its spaces, so no piece reaches over the beginning of a run of them: stretches are encoded one by one.
        self.by_stretch = not any("▁" in p.lstrip("▁") for p in marked)
        self.space = self.b.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        self.places: defaultdict = defaultdict()
        self.places.default_factory = self.places.__len__  # a new stretch takes the next place
        self.flat, self.sizes = array("i"), array("i")

    def stretches(self, text: str) -> list[str]:
        """``text`` with a space before it, cut before each run of spaces; each without its first space, which B adds."""
        if not self.by_stretch:
            return [text]
        return [s[1:] for s in re.findall(" +[^ ]*", " " + text)] if "  " in text or text.startswith(" ") else text.split(" ")

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.places) > KEPT:
            self._forget()
        codes, counts = array("I"), []
        for text in texts:
            held = self.stretches(text)
            codes.extend(map(self.places.__getitem__, held))
            counts.append(len(held))
        new = list(islice(self.places, len(self.sizes), None))
        for s, ids in zip(new, self.b.encode(new, num_threads=1), strict=True):
            ids = ids or [self.space]  # a space alone
            self.flat.extend(ids)
            self.sizes.append(len(ids))
        sizes, coded = np.array(self.sizes, np.int64), np.frombuffer(codes, np.uint32)
        each = sizes[coded]
        ids = np.array(self.flat, np.int64)[_ranges((np.cumsum(sizes) - sizes)[coded], each)]
        return ids, _sums(each, np.array(counts, np.int64))

    def encode_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.a.encode_to_numpy(text, disallowed_special=()) for text in texts]
        return np.concatenate([np.empty(0, np.int64), *found]).astype(np.int64), np.array(list(map(len, found)), np.int64)


def _bytes_of(tokens: dict, turned: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, and where each id's begin and how many they are."""
    by_id = {i: t for t, i in tokens.items()} if turned else tokens
    held = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    sizes = np.array(list(map(len, held)), np.int64)
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum(sizes) - sizes, sizes


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the pieces [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the next counts[i] values."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def align(texts: list[str], sides: Sides) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For A and for B: ids, whether each token ends where one of the other side does, and the numbers of tokens of each text.

    A text is empty for both if the tokens of one of the sides don't give back a space and the text.
    """
    raw = [(" " + t).encode() for t in texts]
    sizes = np.array([len(r) if t else 0 for r, t in zip(raw, texts, strict=True)], np.int64)
    spoken = [t if n else "" for t, n in zip(texts, sizes.tolist(), strict=True)]
    a, b = sides.encode_a([" " + t if t else "" for t in spoken]), sides.encode_b(spoken)
    good = sizes > 0
    for (ids, counts), (_, _, lengths) in ((a, sides.bytes_a), (b, sides.bytes_b)):
        good &= _sums(lengths[ids], counts) == sizes
    for _ in range(2):  # the second time without the texts whose bytes differ
        kept = [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in (a, b)]
        whole = np.frombuffer(b"".join(r for r, g in zip(raw, good.tolist(), strict=True) if g), np.uint8)
        differ = np.zeros(len(whole), bool)
        for (ids, _), (data, starts, lengths) in zip(kept, (sides.bytes_a, sides.bytes_b), strict=True):
            differ |= data[_ranges(starts[ids], lengths[ids])] != whole
        if not differ.any():
            break
        good = good & (_sums(differ.astype(np.int64), np.where(good, sizes, 0)) == 0)
    ends = [np.cumsum(lengths[ids]) for (ids, _), (_, _, lengths) in zip(kept, (sides.bytes_a, sides.bytes_b), strict=True)]
    marks = []
    for own, other in (ends, ends[::-1]):
        mark = np.zeros(len(whole) + 1, bool)
        mark[other] = True
        marks.append(mark[own])
    return [kept[0][0], marks[0], kept[0][1]], [kept[1][0], marks[1], kept[1][1]]


class Names:
    """Ids in decimal with what follows them, as the texts of groups have them."""

    def __init__(self, n_a: int, n_b: int):
        made = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], object)
        self.a, self.b = (made(n_a, ","), made(n_a, "|")), (made(n_b, ","), made(n_b, ";"))

    def groups(self, a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text, empty without tokens."""
        (ids_a, last_a, count_a), (ids_b, last_b, count_b) = a, b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        out = np.empty(len(ids_a) + len(ids_b), object)
        for ids, last, (more, end), at in ((ids_a, last_a, self.a, np.arange(len(ids_a)) + upto_b[group_a]), (ids_b, last_b, self.b, np.arange(len(ids_b)) + upto_a[group_b])):
            out[at] = more[ids]
            out[at[last]] = end[ids[last]]
        at = 0
        for n in (count_a + count_b).tolist():
            yield "".join(out[at : at + n].tolist())[:-1]
            at += n


def _pack(*arrays: np.ndarray) -> list[bytes]:
    """Arrays of one length as zstd frames of FRAME numbers; the first, in order, as differences."""
    out = []
    for at in range(0, len(arrays[0]), FRAME):
        key, *more = (a[at : at + FRAME] for a in arrays)
        planes = b"".join(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in (np.diff(key, prepend=0), *more))
        out.append(zstandard.ZstdCompressor(level=3).compress(planes))
    return out


def _unpack(frame: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8).reshape(n, 8, -1)
    key, *more = (np.ascontiguousarray(p.T).view("<i8").reshape(-1) for p in planes)
    return [np.cumsum(key), *more]


def _stream(frames: list[bytes]) -> Iterator[tuple[int, int]]:
    """The pairs of a run and their numbers, a frame at a time."""
    for frame in frames:
        keys, n = _unpack(frame, 2)
        yield from zip(keys.tolist(), n.tolist(), strict=True)


def merged(runs: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """The pairs of all runs in order, each once with the sum of its numbers: a k-way merge by a heap."""
    at, total = None, 0
    for key, n in heapq.merge(*map(_stream, runs)):
        if key != at:
            if at is not None:
                yield at, total
            at, total = key, 0
        total += n
    if at is not None:
        yield at, total


def with_best(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Each pair and its number, and 1 if no pair of the same token of B has a greater one: what is held are the pairs of one token."""
    for _, own in groupby(pairs, lambda x: x[0] >> BITS):
        own = list(own)
        top = max(n for _, n in own)
        for key, n in own:
            yield key, n, int(n == top)


def _frames(rows: Iterator[tuple[int, ...]]) -> list[bytes]:
    out = []
    while part := list(islice(rows, FRAME)):
        out += _pack(*np.array(part, np.int64).T)
    return out


def _merge(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """One run for each radix and group of runs."""
    key, runs = None, []

    def done() -> pa.RecordBatch:
        pairs = merged(runs)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([_frames(with_best(pairs) if last else pairs)], pa.list_(pa.binary()))], names=["radix", "run", "frames"])

    for batch in batches:
        for radix, group, frames in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("radix", "group", "frames")), strict=True):
            now = radix.as_py(), group.as_py()
            if now != key:
                if runs:
                    yield done()
                key, runs = now, []
            runs.append(frames.as_py())
    if runs:
        yield done()


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's run the counts of its pairs, and whether they are the best, in its order."""
    known: list[np.ndarray] = []
    for batch in batches:
        for kind, radix, block, frames in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("kind", "radix", "block", "frames")), strict=True):
            if kind.as_py() == 0:
                known = [np.concatenate(x) for x in zip(*(_unpack(f, 3) for f in frames.as_py()), strict=True)]
                continue
            keys = np.concatenate([_unpack(f, 2)[0] for f in frames.as_py()])
            at = np.searchsorted(known[0], keys)
            told = zstandard.ZstdCompressor(level=3).compress(np.stack([known[1][at], known[2][at]]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([radix.as_py()], pa.int32()), pa.array([told], pa.binary())], names=["of", "part", "told"])


def _blocks(batches: Iterator[pa.RecordBatch], sides: Sides, form: Callable[[str], str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring documents, over any number of batches: a row for each, of radix -1, and a run for each radix that has pairs."""
    spelled = Names(len(sides.bytes_a[2]), len(sides.bytes_b[2]))
    ids, texts, size, made, kind = [], [], 0, 0, None

    def block() -> pa.RecordBatch:
        number = (TaskContext.get().partitionId() << 32) + made
        a, b = align(texts, sides)
        x, y = a[0][a[1]], b[0][b[1]]
        links = _sums(a[1].astype(np.int64), a[2])
        pairs, places, n = np.unique((y % RADIX) << 2 * BITS | y << BITS | x, return_inverse=True, return_counts=True)
        edges = np.searchsorted(pairs >> 2 * BITS, np.arange(RADIX + 1))
        full = np.flatnonzero(np.diff(edges))
        runs = [_pack(pairs[edges[r] : edges[r + 1]], n[edges[r] : edges[r + 1]]) for r in full]
        groups = [form(t) if t else "" for t in spelled.groups(a, b)]
        none = [None] * len(runs)
        listed = lambda values, t: pa.array([values, *none], pa.list_(t))
        code = zstandard.ZstdCompressor(level=3).compress(places.astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * (len(runs) + 1)), pa.array([-1, *full.tolist()], pa.int32()), pa.array([None, *runs], pa.list_(pa.binary())), listed(ids, kind), *(listed(v, pa.int64()) for v in (a[2], b[2], links)), listed(groups, pa.string()), pa.array([code, *none], pa.binary())],
            names=names,
        )

    for batch in batches:
        kind = batch.column(0).type
        for own, text in zip(batch.column(0), batch.column(1), strict=True):
            said = text.as_py() or ""
            more = text.as_buffer().size if said else 0
            if ids and size + more > BLOCK_BYTES:
                yield block()
                made += 1
                ids, texts, size = [], [], 0
            ids.append(own.as_py())
            texts.append(said)
            size += more
    if ids:
        yield block()


def count_pairs(runs: DataFrame, n_runs: int) -> DataFrame:
    """``(radix, run, frames)``: one run for each radix, with counts and marks of the best, from ``runs(radix, block, frames)``, up to ``n_runs`` a radix."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = runs.withColumnRenamed("block", "run")
    while True:
        last = n_runs <= FAN
        n_runs = 1 if last else -(-n_runs // FAN)
        grouped = held.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(n_runs)))
        dealt = grouped.select("radix", "group", "frames").repartition(parts, "radix", "group").sortWithinPartitions("radix", "group")
        held = written(dealt.mapInArrow(trimmed(lambda b, last=last: _merge(b, last)), "radix int, run long, frames array<binary>"), "align-merged")
        if last:
            return held


def pairs_of(counted: DataFrame) -> DataFrame:
    """``(a, b, n, best)``: the pairs that ``count_pairs`` holds, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frames in batch.column(0):
                for frame in frames.as_py():
                    keys, n, best = _unpack(frame, 3)
                    mask = (1 << BITS) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(keys & mask), pa.array(keys >> BITS & mask), pa.array(n), pa.array(best == 1)], names=["a", "b", "n", "best"])

    return counted.select("frames").mapInArrow(run, "a long, b long, n long, best boolean")


def blocks_of(docs: DataFrame, a_path: str, b_path: str, pattern: str, form: Callable[[str], str] = str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written blocks: of radix -1 the documents, their numbers of tokens and links, and ``form`` of their groups; else a run."""
    with open(b_path, "rb") as file:
        pieces = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((read_byte_level(a_path), pattern, pieces))  # of fixed size: the vocabularies
    kind = docs.schema[id_col].dataType
    schema = T.StructType().add("block", "long").add("radix", "integer").add("frames", T.ArrayType(T.BinaryType())).add("ids", T.ArrayType(kind))
    for c in ("n_a", "n_b", "n_links"):
        schema = schema.add(c, T.ArrayType(T.LongType()))
    schema = schema.add("groups", T.ArrayType(T.StringType())).add("places", "binary")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(source.mapInArrow(trimmed(lambda b: _blocks(b, Sides(*shared.value), form, schema.names)), schema), "align-blocks")


def aligned(blocks: DataFrame, counted: DataFrame, n_blocks: int) -> DataFrame:
    """``(id, n_a, n_b, n_links, n_best, count_sum, groups)`` for each document: the counts meet each block's runs and are summed by document."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = -(-n_blocks // (4 * FAN)) or 1
    none = F.lit(None).cast("long").alias("block")
    asked = counted.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"), F.lit(0).alias("kind"), none, "frames")
    runs = blocks.where("radix >= 0").select("radix", F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"), F.lit(1).alias("kind"), "block", "frames")
    dealt = asked.unionByName(runs).repartition(parts, "radix", "share").sortWithinPartitions("radix", "share", "kind")
    told = dealt.mapInArrow(trimmed(_answer), "of long, part int, told binary")
    kind = blocks.schema["ids"].dataType.elementType

    def gather(block: pa.Table, told: pa.Table) -> pa.Table:
        frames = [np.frombuffer(zstandard.ZstdDecompressor().decompress(t.as_py()), "<i8").reshape(2, -1) for t in told.sort_by("part").column("told")]
        counts, best = np.concatenate([np.empty((2, 0), np.int64), *frames], axis=1)
        held = {c: block.column(c)[0].values for c in ("ids", "n_a", "n_b", "n_links", "groups")}
        links = held["n_links"].to_numpy()
        places = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.column("places")[0].as_py()), "<u4")
        sums = [pa.array(_sums(of[places], links)) for of in (best, counts)]
        return pa.table([held["ids"], held["n_a"], held["n_b"], held["n_links"], *sums, held["groups"]], names=["id", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups"])

    schema = T.StructType().add("id", kind)
    for c in ("n_a", "n_b", "n_links", "n_best", "count_sum"):
        schema = schema.add(c, "long")
    texts = blocks.where("radix < 0").select("block", "ids", "n_a", "n_b", "n_links", "groups", "places")
    return texts.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(gather, schema.add("groups", "string"))


def alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str, form: Callable[[str], str] = str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_links, n_best, count_sum, groups)`` for each row of ``docs``.

    A encodes a space and the text, B the text, to which it adds the space. ``n_links`` are places where tokens of both end,
    and so groups; ``count_sum`` adds up how often each link's pair is linked in all documents; ``n_best`` are links whose pair
    is, ties included, the most frequent one of its token of B. ``groups`` is ``form`` of ``a1,a2|b1;a3|b2,b3``, by default that text itself.

    Null and empty texts, and those that the tokens of a side don't give back, have no tokens: zeros and an empty string. Repeated rows
    are rows of their own and count as often; null ids stay null; no rows give no rows; further columns are ignored;
    a text longer than a block is a block of its own.
    """
    blocks = blocks_of(docs, a_path, b_path, pattern, form, id_col, text_col)
    n_blocks = blocks.where("radix < 0").count()
    runs = blocks.where("radix >= 0").select("radix", "block", "frames")
    return aligned(blocks, count_pairs(runs, n_blocks), n_blocks)


def _sha256(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def op13_alignment(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    out = alignment(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN, _sha256)
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
