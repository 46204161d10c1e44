"""Removal of repeated byte strings with suffix arrays built by linear grouping.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. Such strings are brought together by content, without a suffix array of the corpus:

1. Every string of that length has an anchor: its k-gram of least hash. A block of documents
   keeps its text and the places of its anchors, and is written once to the shared folder.
2. Anchor hashes meet in buckets, which answer each block which of its anchors stand elsewhere
   too, and which document is the first with the same text (only that one goes on).
3. The surroundings of these anchors, each distinct one once a block, meet in the anchor's
   bucket. Where an anchor has several different surroundings, a suffix array over them finds
   the equal strings; the least document id of each string goes back to the block.
4. The block covers its bytes and hands out what is left.

The suffix array (after Baier, 2016) groups suffixes by their longest Lyndon prefix: groups are
processed from the highest down, and each hands its prefix on to the previous smaller suffixes,
which move to a new group above the rest of theirs; then every suffix is emitted into its group
when its next smaller suffix is met. Nothing is renamed or sorted recursively.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmatch.functions.storage import written

#: Bytes of a repeated string, of a block, of what is hashed at once, of a suffix array; stretches of shifts that are looked at for what may be shared.
LENGTH, BLOCK_BYTES, PIECE_BYTES, SUFFIX_BYTES, STRETCHES = 50, 4_000_000, 1_000_000, 50_000, 13
GRAM = LENGTH // 2
SHIFTS = LENGTH - GRAM + 1
AROUND = 2 * SHIFTS + GRAM - 2
BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.iinfo(np.int64).max
PAD = 0xFF  # no byte of UTF-8


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order, the empty suffix first; its symbols are small whole numbers."""
    n, end = len(text), max(text, default=0) + 1
    members: list[list[int]] = [[] for _ in range(end + 1)]  # ``end`` is the end of the list of groups
    for i, c in enumerate(text):
        members[c].append(i)
    below, above = list(range(-1, end)), list(range(1, end + 2))
    done = bytearray(end + 1)
    group, reach, prev = list(text), [1] * n, [-1] * n
    live = [len(m) for m in members]

    def split(old: int, moved: list[int]) -> None:
        """A new group next above ``old``; a group that moves whole stays where it is."""
        if live[old] == len(moved):
            return
        new, up = len(members), above[old]
        members.append(moved)
        live.append(len(moved))
        live[old] -= len(moved)
        for q in moved:
            group[q] = new
        done.append(0)
        below.append(old)
        above.append(up)
        above[old] = below[up] = new

    g = end - 1
    while g >= 0:
        done[g] = 1
        if live[g]:
            mine = members[g]
            if live[g] < len(mine):
                members[g] = mine = [s for s in mine if group[s] == g]
            length = reach[mine[0]]
            if len(mine) == 1:
                s = mine[0]
                q = s - 1
                while q >= 0 and done[group[q]]:
                    q = prev[q]
                prev[s] = q
                if q >= 0:
                    reach[q] += length
                    split(group[q], [q])
            else:
                times: dict[int, int] = {}
                for s in mine:
                    q = s - 1
                    while q >= 0 and done[group[q]]:
                        q = prev[q]
                    prev[s] = q
                    if q >= 0:
                        times[q] = times.get(q, 0) + 1
                moved: dict[tuple[int, int], list[int]] = {}
                for q, k in times.items():
                    reach[q] += k * length
                    moved.setdefault((group[q], -k), []).append(q)
                for old, k in sorted(moved) if len(moved) > 1 else moved:  # fewest repeats end next above the old group
                    split(old, moved[old, k])
        g = below[g]
    head, at, g = [0] * len(members), 1, 0
    while g != end:
        head[g] = at
        at += live[g]
        g = above[g]
    out = [n] * (n + 1)
    for i in range(n + 1):
        s = out[i]
        p = s - 1
        while p >= 0 and p + reach[p] == s:
            place = head[group[p]]
            out[place] = p
            head[group[p]] = place + 1
            p = prev[p]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled to 48 bits, never 0."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(16)) | np.uint64(1)


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes >> np.uint64(1)) % np.uint64(n)  # the lowest bit is always set


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-gram at each place, by doubling."""
    cur, size, done, width = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            done = cur if done is None else done[: len(cur) - width] * _power(size) + cur[width:]
            width += size
        if 2 * size > k:
            return _mixed(done)
        cur = cur[:-size] * _power(size) + cur[size:]
        size *= 2


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` over each w neighbours, by doubling."""
    size = 1
    while 2 * size <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the k-grams of least hash among those of some string of LENGTH bytes inside a document."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64)
    h = _rolling(data, GRAM)
    low = _slide(h, SHIFTS, np.minimum)
    starts = np.append(0, ends[:-1])
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    low = np.where(np.cumsum(inside)[: len(low)] > 0, low, np.uint64(0))
    edge = np.zeros(SHIFTS - 1, np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), SHIFTS, np.maximum)
    return np.flatnonzero(h == high)


def _hash_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.zeros(len(places), np.uint64)
    for j in range(GRAM):
        out = out * BASE + data[places + j].astype(np.uint64) + np.uint64(1)
    return _mixed(out)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, byte by byte, compressed."""
    planes = [np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(planes))


def _unpack(data: bytes, n_arrays: int) -> list[np.ndarray]:
    held = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * n_arrays, []
    for n in np.frombuffer(held, "<i8", n_arrays).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(held, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").reshape(-1))
        at += 8 * n
    return out


_ROW = T.StructType().add("block", "long").add("bucket", "integer").add("kind", "integer").add("data", "binary").add("more", "binary")
_NAMES = ["block", "bucket", "kind", "data", "more"]
TEXT, KNOWN, LEAST = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_NAMES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring rows: ids (null: NONE), sizes, gaps between anchors; the text beside them."""
    made = 0
    for batch in batches:
        ids, texts = batch.column(0).fill_null(NONE).to_numpy(), batch.column(1)
        at = 0
        while at < len(texts):
            start, size, held = at, 0, []
            while at < len(texts):
                text = (texts[at].as_py() or "").encode()
                if held and size + len(text) > BLOCK_BYTES:
                    break
                held.append(text)
                size += len(text)
                at += 1
            places, piece, base, done = [], [], 0, 0
            for i, text in enumerate(held):
                piece.append(text)
                done += len(text)
                if done - base >= PIECE_BYTES or i == len(held) - 1:
                    found = anchors(np.frombuffer(b"".join(piece), np.uint8), np.cumsum(list(map(len, piece))))
                    places.append(found + base)
                    piece, base = [], done
            gaps = np.diff(np.concatenate(places), prepend=0)
            packed = _pack(ids[start:at], np.array(list(map(len, held))), gaps)
            yield _rows([((TaskContext.get().partitionId() << 32) + made, -1, TEXT, packed, zstandard.ZstdCompressor(level=3).compress(b"".join(held)))])
            made += 1


class _Block:
    """What every stage derives from a block's row in the same way."""

    def __init__(self, packed: bytes, text: bytes, n_buckets: int):
        self.ids, self.sizes, gaps = _unpack(packed, 3)
        self.text = zstandard.ZstdDecompressor().decompress(text)
        self.data = np.frombuffer(self.text, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.places = np.cumsum(gaps)
        self.rows = np.searchsorted(self.ends, self.places, "right")
        taking_part = self.ids[self.rows] != NONE
        self.places, self.rows = self.places[taking_part], self.rows[taking_part]
        self.hashes = _hash_at(self.data, self.places)
        self.n_buckets = n_buckets
        self.known, self.at = np.unique(self.hashes, return_inverse=True)
        order = np.lexsort((self.known, _bucket(self.known, n_buckets)))
        self.known, back = self.known[order], np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.at = back[self.at]  # place of each anchor's hash in the list by bucket, then hash
        self.cuts = np.searchsorted(_bucket(self.known, n_buckets), np.arange(n_buckets + 1))
        digests = [xxhash.xxh3_128_digest(self.text[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        words = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        part = np.flatnonzero(self.ids != NONE)
        self.copies, inverse = np.unique(words[part], axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        self.first = np.full(len(self.copies), NONE)
        np.minimum.at(self.first, inverse, self.ids[part])
        self.copy = np.full(len(self.ids), -1)
        self.copy[part] = inverse
        self.copy_bucket = (self.copies[:, 0] % n_buckets) if len(self.copies) else np.empty(0, np.int64)

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """For each bucket: hashes with a mark if two documents here hold them, and texts with their least id."""
        held = np.unique(self.at * np.int64(len(self.ids) + 1) + self.rows) // np.int64(len(self.ids) + 1)
        many = np.bincount(held, minlength=len(self.known)) > 1
        for b in range(self.n_buckets):
            a, z = self.cuts[b], self.cuts[b + 1]
            mine = self.copy_bucket == b
            if z > a or mine.any():
                yield b, _pack(np.diff(self.known[a:z].astype(np.int64), prepend=0), many[a:z], self.copies[mine, 0], self.copies[mine, 1], self.first[mine])

    def told(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each listed hash stands elsewhere too; the least id of each row's text."""
        repeated, first = np.zeros(len(self.known), bool), self.first.copy()
        for b, data in answers.items():
            marks, least = _unpack(data, 2)
            repeated[self.cuts[b] : self.cuts[b + 1]] = marks > 0
            first[self.copy_bucket == b] = least
        return repeated, np.where(self.copy >= 0, np.append(first, NONE)[self.copy], NONE)

    def around(self, repeated: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Repeated anchors of first copies: their numbers; distinct surroundings by bucket; which one each has; buckets of those."""
        mine = np.flatnonzero(repeated[self.at] & (self.ids[self.rows] == first[self.rows]))
        places, rows = self.places[mine], self.rows[mine]
        index = places[:, None] + np.arange(1 - SHIFTS, GRAM + SHIFTS - 1)
        outside = (index < self.starts[rows][:, None]) | (index >= self.ends[rows][:, None])
        shown = self.data[np.clip(index, 0, max(len(self.data) - 1, 0))] if len(mine) else np.empty((0, AROUND), np.uint8)
        shown[outside] = PAD
        keyed = np.empty((len(mine), AROUND + 4), np.uint8)
        keyed[:, :4] = _bucket(self.hashes[mine], self.n_buckets).astype(">u4").view(np.uint8).reshape(-1, 4)
        keyed[:, 4:] = shown
        distinct, which = np.unique(np.ascontiguousarray(keyed).view(f"V{AROUND + 4}").reshape(-1), return_inverse=True)
        raw = np.frombuffer(distinct.tobytes(), np.uint8).reshape(-1, AROUND + 4)
        return mine, raw[:, 4:], which, np.ascontiguousarray(raw[:, :4]).view(">u4").reshape(-1).astype(np.int64)


def _ask(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _rows([(row["block"], b, KNOWN, data, None) for b, data in _Block(row["data"], row["more"], n_buckets).asked()])


def _answer(group: pa.Table) -> pa.Table:
    """One bucket: which hashes stand in two blocks or in two documents of one; the least id of each text."""
    rows = group.select(["block", "bucket", "data"]).to_pylist()
    parts = [_unpack(r["data"], 5) for r in rows]
    hashes = np.concatenate([np.cumsum(p[0]) for p in parts])
    marks = np.concatenate([p[1] for p in parts]) > 0
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.append(False, ranked[1:] == ranked[:-1])
    group_of = np.empty(len(hashes), np.int64)
    group_of[order] = np.cumsum(~same)
    repeated = (np.bincount(group_of, minlength=1) > 1) | (np.bincount(group_of, marks, minlength=1) > 0)
    words = np.stack([np.concatenate([p[i] for p in parts]) for i in (2, 3)], axis=1)
    _, text = np.unique(words, axis=0, return_inverse=True)
    text = text.reshape(-1)
    least = np.full(text.max(initial=-1) + 1, NONE)
    np.minimum.at(least, text, np.concatenate([p[4] for p in parts]))
    out, a, z = [], 0, 0
    for row, p in zip(rows, parts, strict=True):
        out.append((row["block"], row["bucket"], KNOWN, _pack(repeated[group_of[a : a + len(p[0])]], least[text[z : z + len(p[2])]]), None))
        a, z = a + len(p[0]), z + len(p[2])
    return pa.Table.from_batches([_rows(out)])


def _opened(group: pa.Table, n_buckets: int):
    rows = group.select(_NAMES).to_pylist()
    text = next(r for r in rows if r["kind"] == TEXT)
    block = _Block(text["data"], text["more"], n_buckets)
    repeated, first = block.told({r["bucket"]: r["data"] for r in rows if r["kind"] == KNOWN})
    return text["block"], block, first, block.around(repeated, first), {r["bucket"]: r["data"] for r in rows if r["kind"] == LEAST}


def _show(group: pa.Table, n_buckets: int) -> pa.Table:
    """A block's distinct surroundings of repeated anchors, each with the least id here."""
    number, block, _, (mine, shown, which, bucket), _ = _opened(group, n_buckets)
    least = np.full(len(shown), NONE)
    np.minimum.at(least, which, block.ids[block.rows[mine]])
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        a, z = cuts[b], cuts[b + 1]
        out.append((number, b, LEAST, _pack(least[a:z]), zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(shown[a:z].T).tobytes())))
    return pa.Table.from_batches([_rows(out)])


def _may_share(shown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shift, and the one after the last, of each surroundings whose string may stand in another; none where they are equal.

    A necessary test, no match is lost: a string at shift o holds SHIFTS - 1 - o bytes before the anchor and o after it;
    for each stretch of shifts, the bytes that all of its strings hold must stand in two surroundings.
    """
    first, last = np.full(len(shown), SHIFTS), np.zeros(len(shown), np.int64)
    cuts = np.linspace(0, SHIFTS, STRETCHES + 1).astype(int).tolist()
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = np.ascontiguousarray(shown[:, high - 1 : SHIFTS - 1 + GRAM + low])
        _, which, times = np.unique(part.view(f"V{part.shape[1]}").reshape(-1), return_inverse=True, return_counts=True)
        some = times[which] > 1
        first[some] = np.minimum(first[some], low)
        last[some] = high
    return np.minimum(first, last), last


def _parts(shown: np.ndarray, rows: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Surroundings of one anchor that are too many for one suffix array, in parts of shifts and rows that may share a string there.

    Strings at the shifts low to high - 1 have some bytes in common; only rows equal in these may share one. A part that is still
    too large is cut again, at last to single shifts.
    """
    if len(rows) > 1 and (high - low == 1 or len(rows) * AROUND <= SUFFIX_BYTES):
        yield low, high, rows
    elif len(rows) > 1:
        middle = (low + high) // 2
        for x, y in ((low, middle), (middle, high)):
            core = np.ascontiguousarray(shown[rows, y - 1 : SHIFTS - 1 + GRAM + x])
            _, which = np.unique(core.view(f"V{core.shape[1]}").reshape(-1), return_inverse=True)
            order = np.argsort(which, kind="stable")
            for part in np.split(rows[order], np.flatnonzero(np.diff(which[order])) + 1):
                yield from _parts(shown, part, x, y)


def least_ids(shown: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For distinct surroundings and the least id of each: the least id of each of their SHIFTS strings, NONE outside a document.

    A string that stands in one of them only has that one's id. Surroundings are dealt with by their
    anchor; where it has several, equal strings are neighbours in the suffix array over all of these. No
    suffix array is longer than SUFFIX_BYTES and one anchor's part of that size, however common an anchor is.
    """
    padded = shown == PAD
    left, right = padded[:, : SHIFTS - 1].sum(axis=1), padded[:, SHIFTS + GRAM - 1 :].sum(axis=1)
    offsets = np.arange(SHIFTS)
    inside = (offsets >= left[:, None]) & (offsets <= (SHIFTS - 1 - right)[:, None])
    out = np.where(inside, ids[:, None], NONE)
    gram = np.ascontiguousarray(shown[:, SHIFTS - 1 : SHIFTS - 1 + GRAM]).view(f"V{GRAM}").reshape(-1)
    first, last = _may_share(shown)
    order = np.flatnonzero(first < last)
    order = order[np.argsort(gram[order], kind="stable")]
    edges = np.append(np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
    held: list[tuple[int, int, int, list[int]]] = []  # shifts from and to, least id, and the rows that have a piece in common
    pieces: list[list[int]] = []
    opened, size = 0, 0

    def sort() -> None:
        """Equal strings of the pieces at hand get their least id. An anchor's k-gram is one symbol, so that a string has SHIFTS of them."""
        text = [c for piece in pieces for c in piece]
        begins = np.cumsum([0, *map(len, pieces)])
        starts = np.array(suffix_array(text)[1:], np.int64)
        piece = np.searchsorted(begins, starts, "right") - 1
        one = np.array([rows[0] for _, _, _, rows in held])[piece]
        offset = starts - begins[piece] + np.array([low for low, _, _, _ in held])[piece]
        good = (offset < np.array([high for _, high, _, _ in held])[piece]) & inside[one, np.minimum(offset, SHIFTS - 1)]
        starts, piece, offset = starts[good], piece[good], offset[good]
        strings = [text[s : s + SHIFTS] for s in starts.tolist()]
        fresh = np.array([True, *(x != y for x, y in zip(strings[1:], strings, strict=False))][: len(strings)], bool)
        run = np.cumsum(fresh) - 1
        least = np.full(run.max(initial=-1) + 1, NONE)
        np.minimum.at(least, run, np.array([m for _, _, m, _ in held])[piece])
        table = np.full((len(held), SHIFTS), NONE)
        table[piece, offset] = least[run]
        for n, (low, high, _, rows) in enumerate(held):
            out[rows, low:high] = table[n, low:high]

    def add(alike: dict[tuple[int, int, bytes], list[int]]) -> None:
        """The pieces of one anchor, or of one part of it, under a symbol of their own."""
        nonlocal opened, size
        for (low, high, piece), rows in alike.items():
            middle = SHIFTS - 1 - low
            pieces.append([*piece[:middle], 256 + opened, *piece[middle + GRAM :], PAD])
            held.append((low, high, int(ids[rows].min()), rows))
        opened, size = opened + 1, size + len(alike) * AROUND
        if size >= SUFFIX_BYTES:
            flush()

    def flush() -> None:
        nonlocal opened, size
        if pieces:
            sort()
        held.clear()
        pieces.clear()
        opened, size = 0, 0

    def grouped(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[tuple[int, int, bytes], list[int]]:
        alike: dict[tuple[int, int, bytes], list[int]] = {}
        for i, x, y in zip(rows.tolist(), low.tolist(), high.tolist(), strict=True):
            alike.setdefault((x, y, shown[i, x : y + LENGTH - 1].tobytes()), []).append(i)
        return alike

    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = order[a:z]
        if len(rows) < 2:
            continue
        if len(rows) * AROUND > SUFFIX_BYTES:
            for low, high, part in _parts(shown, rows, int(first[rows].min()), int(last[rows].max())):
                if high - low == 1:  # the strings themselves
                    part = part[inside[part, low]]
                    strings = np.ascontiguousarray(shown[part, low : low + LENGTH]).view(f"V{LENGTH}").reshape(-1)
                    _, which = np.unique(strings, return_inverse=True)
                    least = np.full(which.max(initial=-1) + 1, NONE)
                    np.minimum.at(least, which, ids[part])
                    out[part, low] = least[which]
                else:
                    add(grouped(part, np.full(len(part), low), np.full(len(part), high)))
            continue
        alike = grouped(rows, first[rows], last[rows])
        if len(alike) == 1:  # the same strings in all: nothing to sort
            where = inside[rows[0]] & (offsets >= first[rows[0]]) & (offsets < last[rows[0]])
            out[np.ix_(rows, np.flatnonzero(where))] = ids[rows].min()
        else:
            add(alike)
    flush()
    return out


def _compare(group: pa.Table) -> pa.Table:
    """One bucket: the least id of each string around its anchors, over all blocks."""
    rows = group.select(_NAMES).to_pylist()
    ids = [_unpack(r["data"], 1)[0] for r in rows]
    shown = [np.frombuffer(zstandard.ZstdDecompressor().decompress(r["more"]), np.uint8).reshape(AROUND, -1).T for r in rows]
    every = np.ascontiguousarray(np.concatenate(shown))
    distinct, which = np.unique(every.view(f"V{AROUND}").reshape(-1), return_inverse=True)
    least = np.full(len(distinct), NONE)
    np.minimum.at(least, which, np.concatenate(ids))
    strings = least_ids(np.frombuffer(distinct.tobytes(), np.uint8).reshape(-1, AROUND), least)
    out, at = [], 0
    for row, mine in zip(rows, ids, strict=True):
        found = strings[which[at : at + len(mine)]]
        at += len(mine)
        earlier = (found < NONE).any(axis=1)
        best = np.where(earlier, found.min(axis=1), NONE)
        plain = np.where(found < NONE, found == best[:, None], True).all(axis=1)  # one id for all strings, the usual case
        inside = (found < NONE) @ (1 << np.arange(SHIFTS))
        out.append((row["block"], row["bucket"], LEAST, _pack(best, inside, plain, found[~plain].reshape(-1)), None))
    return pa.Table.from_batches([_rows(out)])


def _finish(group: pa.Table, n_buckets: int) -> pa.Table:
    _, block, first, (mine, shown, which, bucket), answers = _opened(group, n_buckets)
    least = np.full((len(shown), SHIFTS), NONE)
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
    for b, data in answers.items():
        best, inside, plain, found = _unpack(data, 4)
        part = np.where((inside[:, None] >> np.arange(SHIFTS)) & 1, best[:, None], NONE)
        part[plain == 0] = found.reshape(-1, SHIFTS)
        least[cuts[b] : cuts[b + 1]] = part
    anchor, shift = np.nonzero(least[which] < block.ids[block.rows[mine]][:, None])
    starts = block.places[mine][anchor] + shift - (SHIFTS - 1)
    cover = np.bincount(starts, minlength=len(block.data) + 1) - np.append(np.zeros(LENGTH, np.int64), np.bincount(starts, minlength=len(block.data) + 1))[: len(block.data) + 1]
    gone = np.cumsum(cover)[: len(block.data)] > 0
    later = np.flatnonzero((block.ids != NONE) & (first < block.ids) & (block.sizes >= LENGTH))
    for i in later.tolist():  # a later copy of a whole text
        gone[block.starts[i] : block.ends[i]] = True
    cols: list[list] = [[], [], [], []]
    for i, (a, z) in enumerate(zip(block.starts.tolist(), block.ends.tolist(), strict=True)):
        part = gone[a:z]
        n = int(part.sum())
        cols[0].append(None if block.ids[i] == NONE else int(block.ids[i]))
        cols[1].append(z - a)
        runs = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8))) if n else np.empty(0, np.int64)
        cols[2].append(runs.tolist())
        cols[3].append(block.data[a:z][~part].tobytes() if n else block.text[a:z])
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())], names=["id", "n_bytes", "edges", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """``(id, n_bytes, edges, kept)`` for each row of ``docs``.

    ``edges`` are the starts and ends of the removed runs of bytes, in turn; ``kept`` the bytes left.
    Null texts are empty; texts shorter than LENGTH lose nothing; rows with one id take nothing from
    each other; a row with a null id is left whole and takes nothing from others; repeated rows give
    repeated rows; no rows give no rows; further columns are ignored; a text longer than a block is a block of
    its own. ``n_buckets`` is the number of parts of the anchor shuffles, by default
    ``spark.sql.shuffle.partitions``; a block sends a row to each bucket that has one of its anchors, so rows
    grow with the anchors, not with the product of blocks and buckets.
    """
    n = n_buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(source.mapInArrow(_blocks, _ROW), "suffix-blocks", "uncompressed")
    asked = blocks.mapInArrow(lambda b: _ask(b, n), _ROW)
    known = written(asked.groupBy("bucket").applyInArrow(_answer, _ROW), "suffix-known", "uncompressed")
    shown = blocks.unionByName(known).groupBy("block").applyInArrow(lambda t: _show(t, n), _ROW)
    least = written(shown.groupBy("bucket").applyInArrow(_compare, _ROW), "suffix-least", "uncompressed")
    out = T.StructType().add("id", "long").add("n_bytes", "long").add("edges", T.ArrayType(T.LongType())).add("kept", "binary")
    return blocks.unionByName(known).unionByName(least).groupBy("block").applyInArrow(lambda t: _finish(t, n), out)


def op1_suffixes(docs: DataFrame) -> DataFrame:
    removed = F.aggregate(F.col("edges"), F.lit(0).cast("long"), lambda a, x: x - a)  # end - start + end - ...
    return remove_repeats(docs).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.floor(F.size("edges") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
