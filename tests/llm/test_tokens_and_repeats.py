import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from labelmatch.llm import bpe, lists, simhash, suffixes

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # columns whose names an operator might use itself
        for name in ("id", "block", "fp", "ids", "score", "row", "spans", "node"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_decodes(spark, prose, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 3000)
    rows = [*prose, prose[3], (None, "no id")]
    got = bpe.decode(bpe.encode(frame(spark, rows), RANKS, P.PATTERN, n_buckets=3), RANKS).collect()
    have = sorted((repr(r.id), list(r.ids), bytes(r.decoded)) for r in got)
    assert have == sorted((repr(i), tokenizer.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)


def test_bpe_query_digests_and_empty_table(spark, prose, tokenizer):
    got = {r.doc_id: r for r in bpe.op5_bpe(frame(spark, prose)).collect()}
    for i, t in prose:
        ids = tokenizer.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.op5_bpe(frame(spark, [])).count() == 0


def test_decoding_replaces_a_column_of_its_name(spark):
    tokens = spark.createDataFrame([(1, [64, 65], "old"), (2, None, "old"), (3, [], None)], "id long, ids array<int>, decoded string")
    out = bpe.decode(tokens, RANKS)
    assert out.columns == ["id", "ids", "decoded"] and [len(r.decoded) for r in out.orderBy("id").collect()] == [2, 0, 0]


def test_decode_refuses_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [10**6])], "id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(rows, RANKS).collect()


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(items):
        for b, y in items[:n]:
            if linked(x, y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in items}


def test_simhash_equals_brute_force(spark, prose):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(frame(spark, prose)).collect()}
    marks = [(i, plain_fingerprint(t)) for i, t in prose]
    want = groups(marks, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == {i: (f"{m:016x}", want[i]) for i, m in marks}
    assert simhash.op3_simhash(frame(spark, [])).count() == 0
    twice = simhash.op3_simhash(frame(spark, [(5, "a b c"), (5, "a b c"), (None, "a b c")])).collect()
    assert [r.component_id for r in twice] == [5, 5, 5]


def test_links_join_all_within_two_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    near = [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base for _ in range(6)]
    marks = sorted({*base, *near, 0, (1 << 64) - 1})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = groups([(signed(m), m) for m in marks], lambda a, b: (a ^ b).bit_count() <= 2)
    for long in (64, 1):  # 1: all shared table values are split
        found = simhash.links(spark.createDataFrame([(signed(m),) for m in marks], "fp long"), long).collect()
        links = {(r.u, r.v) for r in found}
        assert all(((u ^ v) & ((1 << 64) - 1)).bit_count() <= 2 for u, v in links)
        assert groups([(signed(m), signed(m)) for m in marks], lambda a, b: (a, b) in links or (b, a) in links) == want  # noqa: B023


def test_links_within_a_family_that_shares_a_segment(spark):
    rng = random.Random(4)
    high = rng.getrandbits(32) << 32
    marks = sorted({high ^ low for x in (rng.getrandbits(32) for _ in range(12)) for low in (x, x ^ 1 << rng.randrange(32), x ^ 3 << rng.randrange(30), x ^ 1 << 33, x ^ 1 << 40 ^ 1 << rng.randrange(32))})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = groups([(signed(m), m) for m in marks], lambda a, b: (a ^ b).bit_count() <= 2)
    for long in (64, 10, 1):
        links = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(signed(m),) for m in marks], "fp long"), long).collect()}
        assert groups([(signed(m), signed(m)) for m in marks], lambda a, b: (a, b) in links or (b, a) in links) == want  # noqa: B023


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({b" ".join(words)} if words else set())


def test_balls_of_fingerprints_are_not_sent_to_the_driver(spark, monkeypatch):
    plans, written = {}, simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and written(df, name))
    marks = written(spark.range(2000).selectExpr("xxhash64(id) as fp"), "marks")  # far below the size of tables that are broadcast; its balls are not
    simhash.links(marks).count()
    assert "SortMergeJoin [key" in plans["simhash-met"]


@pytest.mark.parametrize("short", [200, 1])
def test_near_copies_leave_one_of_each_group(spark, prose, monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT", short)  # 1: every table row goes the way of the long lists
    monkeypatch.setattr(simhash, "STAR", 3 if short == 1 else 400)
    rows = [*prose, prose[0], (None, "only once"), (None, "only once")]
    out = simhash.drop_near_duplicates(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    sets = [(i, shingles(t)) for i, t in prose]
    want = groups(sets, lambda a, b: (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8)
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(map(repr, [*{v for v in want.values()}, None]))
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


def test_copies_with_repeated_lines_leave_one(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        line = words[100:116]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:116] + line * 12 + words[116:]))]
    assert all(len(shingles(a) & shingles(b)) >= 0.9 * len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == [i for i, _ in rows[::2]]


def test_all_pairs_of_the_similarity_are_found(spark, monkeypatch):
    """Short texts, and copies at or just above the limit with the changed words in one place or dealt over the text."""
    monkeypatch.setattr(simhash, "FREQUENT", 2)
    rng = random.Random(12)
    fresh = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for n in (8, 9, 13, 14, 30, 100, 400, 700, 1500, 5000):
        for _ in range(30 if n < 500 else 4):
            words = [fresh() for _ in range(n)]
            rows.append(" ".join(words))
            rows.append(" ".join([*words, fresh()]))
            other = list(words)
            for at in rng.sample(range(n), max(1, n // 50)):
                other[at] = fresh()
            rows.append(" ".join(other))
            rows.append(" ".join([*words[: n - n // 12], *(fresh() for _ in range(n // 12))]))
    line = " ".join(fresh() for _ in range(12))
    rows = [(i, t if i % 3 else f"{line} {t}") for i, t in enumerate(rows)]
    sets = [(i, shingles(t)) for i, t in rows]
    want = groups(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert 100 < len(rows) - len(set(want.values()))
    for short in (2000, 3):
        monkeypatch.setattr(simhash, "SHORT", short)
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == sorted(set(want.values()))


def test_suffix_array_equals_sorting():
    rng = random.Random(2)
    for _ in range(400):
        text = bytes(rng.choice(b"ab\xff"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(50)))
        assert suffixes.suffix_array(text) == sorted(range(len(text) + 1), key=lambda i: text[i:])


def plain_repeats(rows):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - 49):
                first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((repr(i), len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [4_000_000, 2000])
def test_repeats_equal_brute_force(spark, prose, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixes, "SUFFIX_BYTES", 50_000 if block > 2000 else 3000)
    rng = random.Random(9)
    shuffled = [*prose, prose[7], (None, prose[7][1]), (-1, prose[14][1][30:200]), (7, "ab" * 200), (8, "ab" * 200)]
    rng.shuffle(shuffled)
    got = suffixes.op1_suffixes(frame(spark, shuffled)).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain_repeats(shuffled)
    assert suffixes.op1_suffixes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [50_000, 2000, 100])
def test_common_anchors_are_dealt_with_in_parts(monkeypatch, limit):
    """Many different surroundings of one k-gram: each string's least id, with suffix arrays of any size."""
    monkeypatch.setattr(suffixes, "SUFFIX_BYTES", limit)
    rng = random.Random(11)
    gram = bytes(rng.randrange(97, 123) for _ in range(suffixes.GRAM))
    side = suffixes.SHIFTS - 1
    lefts, rights = ([bytes(rng.choice(b"ab") for _ in range(side)) for _ in range(6)] for _ in range(2))
    rows = set()
    for _ in range(150):
        left, right = rng.choice(lefts), rng.choice(rights)
        left, right = (bytes(rng.choice(b"abc") for _ in range(k)) + x[k:] for x, k in ((left, rng.randrange(side)), (right[::-1], rng.randrange(side))))
        pad = rng.choice([0, 0, 0, rng.randrange(side)])
        rows.add(bytes([suffixes.PAD]) * pad + left[pad:] + gram + right[::-1])
    rows |= {bytes(rng.choice(b"xy") for _ in range(suffixes.AROUND)) for _ in range(5)}
    shown = np.frombuffer(b"".join(sorted(rows)), np.uint8).reshape(-1, suffixes.AROUND)
    ids = np.array(rng.sample(range(10_000), len(rows)))
    want: dict[bytes, int] = {}
    strings = [[bytes(r[o : o + suffixes.LENGTH]) for o in range(suffixes.SHIFTS)] for r in shown]
    for i, own in zip(ids.tolist(), strings, strict=True):
        for o, x in enumerate(own):
            want[o, x] = min(want.get((o, x), i), i)
    got = suffixes.least_ids(shown, ids)
    for n, own in enumerate(strings):
        assert got[n].tolist() == [suffixes.NONE if suffixes.PAD in x else want[o, x] for o, x in enumerate(own)]


def test_spanning_pairs_connect_what_all_pairs_do():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 60))))
        x, y = lists.spanning(n, a, b)
        pairs = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert len(x) < n and all(frozenset(p) in pairs for p in zip(x.tolist(), y.tolist(), strict=True))
        assert (lists.roots(n, a, b) == lists.roots(n, x, y)).all()


def test_sketches_turn_away_no_pair_of_the_similarity():
    rng = np.random.default_rng(6)
    kept = apart = tried = 0
    for n in (1, 2, 9, 40, 255, 257, 300, 500, 520, 1000, 3000, 9000):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            k = int(n * 0.222) if n < 1000 else int(n * 0.22)  # so many of each are in one set only, up to the limit
            differ = rng.integers(0, k + 1)
            left = int(rng.integers(0, differ + 1))
            b = np.unique(np.concatenate([a[: n - left], rng.integers(0, 1 << 63, differ - left, dtype=np.uint64)]))
            c = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            a = np.unique(a)
            sets = simhash.Sketches(np.array(list(map(len, (a, b, c)))), np.stack([simhash.sketch(x) for x in (a, b, c)]).view(np.uint64), 0.8)
            if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
                assert sets.close(np.array([0]), np.array([1]))[0]
                kept += 1
            tried += 1
            apart += not sets.close(np.array([0]), np.array([2]))[0]
    assert kept > 200 and apart > 0.9 * tried


def test_of_rows_with_one_id_and_text_the_first_by_its_other_columns_stays(spark):
    rows = [(1, "a b c d e f", "de", "web"), (1, "a b c d e f", "en", "web"), (1, "a b c d e f", "de", "news"), (2, "other words that stand here alone", None, None), (2, "other words that stand here alone", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for n in (1, 4):
        got = sorted((r.doc_id, r.lang, r.source) for r in simhash.drop_near_duplicates(docs.repartition(n, "source", "lang")).collect())
        assert got == [(1, "de", "news"), (2, "en", None)]


def test_what_stars_leave_apart_is_linked_without_a_row_for_each_pair(spark, monkeypatch):
    """A list of texts that are all alike gives fewer links than rows, in one piece and in several, and these connect all of it."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(0, 120, 4)] + ["quite another text of some words here"]
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    rows = [(0, i, i, len(h), *simhash.sketch(h).tolist(), t) for i, (h, t) in enumerate(zip(sets, texts, strict=True))]
    members = spark.createDataFrame(rows, "list long, node long, known long, size long, " + ", ".join(f"{f} long" for f in simhash._SKETCH) + ", text string")
    for star in (400, 7):
        monkeypatch.setattr(simhash, "STAR", star)
        found = [(r.u, r.v) for r in simhash.unsettled(members, 0.8, 5).collect()]
        assert len(found) < len(texts) * (1 if star == 400 else 6)
        assert {r.component for r in simhash.connected_components(spark.createDataFrame(found, "u long, v long")).collect()} == {0} and 30 not in {x for p in found for x in p}
    prints = [simhash.bits_of(h) for h in sets]
    reps = spark.createDataFrame([*enumerate(prints), (31, prints[3])], "node long, fp long")
    pairs = [(r.u, r.v) for r in simhash.fingerprint_pairs(reps).collect()]
    whole = [*prints, prints[3]]
    assert any(31 in p for p in pairs) and all(u > v and ((whole[u] ^ whole[v]) & (2**64 - 1)).bit_count() <= 2 for u, v in pairs)
