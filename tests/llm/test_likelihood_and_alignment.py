import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelmatch.llm import alignment, lattice
from tests.llm.test_tokens_and_repeats import frame

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def plain_lattice(word, logs):
    """The probability of a word by all its cuttings, and how often each piece is expected."""
    word = b" " + word
    n = len(word)
    before, after = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    pieces = [(i, j, word[i:j]) for i in range(n) for j in range(i + 1, n + 1) if word[i:j] in logs]
    for i, j, p in sorted(pieces, key=lambda x: x[1]):
        before[j] += before[i] * math.exp(logs[p])
    for i, j, p in sorted(pieces, key=lambda x: -x[0]):
        after[i] += after[j] * math.exp(logs[p])
    expected = Counter()
    for i, j, p in pieces:
        expected[p] += before[i] * math.exp(logs[p]) * after[j] / before[n]
    return before[n], expected


def small_vocabulary():
    weights = {bytes([b]): 1.0 for b in range(256)} | {b" ": 5.0, b" a": 9.0, b"ab": 4.0, b"b": 2.0, b"aba": 3.0, "é".encode(): 2.0, b" the": 8.0, b"the": 1.0, b"er": 5.0, b"on": 5.0, b"an": 4.0}
    total = sum(weights.values())
    return {p: w / total for p, w in weights.items()}


def test_forward_equals_all_cuttings():
    weights = small_vocabulary()
    model = lattice.model_of(weights)
    logs = dict(zip(weights, model.logs, strict=True))
    rng = random.Random(2)
    words = [b"", b"a", b"abab", b"ababab", "éé".encode(), b"\xff", *(bytes(rng.choice(b"abthern") for _ in range(rng.randrange(1, 30))) for _ in range(50))]
    times = np.array([rng.randrange(1, 9) for _ in words], float)
    totals = np.zeros(len(weights))
    got = lattice.forward(words, model, times, totals)
    want = Counter()
    for w, t, lp in zip(words, times, got, strict=True):
        p, expected = plain_lattice(w, logs)
        assert math.isclose(lp, math.log(p), rel_tol=1e-9)
        for piece, n in expected.items():
            want[piece] += n * t
    assert np.allclose(totals, [want[p] for p in weights], rtol=1e-9, atol=1e-12)


def test_probabilities_of_words_of_two_bytes_sum_to_what_the_pieces_allow():
    """Over an alphabet that the pieces cover, all strings of up to n bytes have a probability below 1, growing with n."""
    weights = {b" ": 0.5, b"a": 0.2, b" a": 0.2, b"aa": 0.1}
    model = lattice.model_of(weights, end=0.5)
    sums = np.exp(lattice.forward([b"a" * n for n in range(40)], model))
    assert 0 < sums.sum() < 1


def plain_scores(rows, weights, rounds, prior):
    counts, ends = Counter(), 0
    for i, text in rows:
        if i is not None and not held_out(i):
            counts.update(words_of(text))
            ends += 1
    tokens, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    end = lattice.END
    logs = {p: math.log(w * (1 - end)) for p, w in weights.items()}
    log_end = math.log(end)
    for _ in range(rounds):
        expected = Counter({p: prior * w * (1 - end) for p, w in weights.items()})
        for w, c in counts.items():
            for p, n in plain_lattice(w, logs)[1].items():
                expected[p] += c * n
        total = sum(expected.values()) + ends + prior * end
        logs = {p: math.log(n / total) for p, n in expected.items()}
        log_end = math.log((ends + prior * end) / total)
    out = []
    for i, text in rows:
        words = words_of(text)
        base = [math.log10((c + 0.1) / (tokens + 0.1 * (distinct + 1))) for c in [*(counts[w] for w in words), ends]]
        score = sum(math.log10(plain_lattice(w, logs)[0]) for w in words) + log_end / math.log(10)
        out.append((i, held_out(i), len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), tokens, sum(base), score))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8_000_000, 500])
def test_likelihoods_equal_brute_force(spark, prose, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK_BYTES", block)
    weights = small_vocabulary()
    rows = [(i, t if t is None or len(t) < 90 else t[:90]) for i, t in prose] + [(None, "the erera"), (7, "again the"), (7, "again the"), (400, "The THE the\x0bthe the")]
    monkeypatch.setattr(lattice, "read_vocabulary", lambda path: weights)
    got = sorted((tuple(r) for r in lattice.op12_lattice(frame(spark, rows)).collect()), key=str)
    want = plain_scores(rows, weights, 2, lattice.PRIOR)
    key = lambda r: (str(r[0]), r[2], round(r[6], 5))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_likelihoods_without_rows_to_learn_from(spark):
    assert lattice.op12_lattice(frame(spark, [])).count() == 0
    some = next(i for i in range(1000) if held_out(i))
    (row,) = lattice.op12_lattice(frame(spark, [(some, "the house")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == 0 and row.score < 0


def test_pieces_learned_from_documents_predict_held_out_ones_better(spark):
    """Held-out documents are likelier by the learned pieces than by the vocabulary's own scores, and much likelier than scrambled ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r.doc_id: r for r in lattice.op12_lattice(docs).where("held_out").collect()}
    weights = lattice.read_vocabulary(PIECES)
    own = lattice.model_of(weights)
    rng = random.Random(4)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.doc_id in held}
    gained = sum(held[i].score for i in texts) - sum(lattice.forward(words_of(t), own).sum() / lattice.LN10 for t in texts.values() if words_of(t))
    assert gained > 0.2 * -sum(r.score for r in held.values())
    mixed = {i: " ".join("".join(rng.sample(w, len(w))) for w in t.split()) for i, t in texts.items() if t}
    worse = spark.createDataFrame([*((i + 1_000_000_000, t) for i, t in mixed.items())], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(worse)
    again = {r.id: r.score for r in lattice.score(both, weights, (F.col("doc_id") < 1_000_000_000) & (F.crc32(F.col("doc_id").cast("string")) % 10 != 0)).collect()}
    assert sum(again[i] > again[i + 1_000_000_000] for i in mixed if len(mixed[i].split()) > 5) > 0.98 * sum(len(t.split()) > 5 for t in mixed.values())


BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def sides():
    with open(PIECES, "rb") as file:
        return alignment.Sides(alignment.read_byte_level(BYTE_LEVEL), public_tokenizers.PATTERN, file.read())


def plain_tokens(texts):
    """For each text the ids and bytes of both sides, by the tokenizers' own libraries over whole texts."""
    first = Tokenizer.from_file(BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = alignment.byte_letters()
    out = []
    for t in texts:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode([t], num_threads=1)[0] if t else []
        bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode() for p in map(second.id_to_piece, b)]
        whole = (" " + (t or "")).encode()
        out.append(([], [], [], []) if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole else (a, bytes_a, b, bytes_b))
    return out


def plain_alignment(rows):
    counts, held = Counter(), []
    for (i, _), (a, bytes_a, b, bytes_b) in zip(rows, plain_tokens([t for _, t in rows]), strict=True):
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        both = sorted({*ends_a} & {*ends_b})
        links = [(a[ends_a.index(e)], b[ends_b.index(e)]) for e in both] if len(a) < 3000 else [(dict(zip(ends_a, a))[e], dict(zip(ends_b, b))[e]) for e in both]  # noqa: B905
        counts.update(links)
        groups, x, y = [], 0, 0
        for e in both:
            u, v = x, y
            while x < len(a) and ends_a[x] <= e:
                x += 1
            while y < len(b) and ends_b[y] <= e:
                y += 1
            groups.append(",".join(map(str, a[u:x])) + "|" + ",".join(map(str, b[v:y])))
        held.append((i, len(a), len(b), links, ";".join(groups)))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    out = []
    for i, n_a, n_b, links, groups in held:
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(links), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out, counts, top


ODD = ["a  b", "  a", " a ", "a   ", " ", "   ", "a\nb", "\ufb01\u2460", "a\x00b", "\t x", "<s> </s> <|endoftext|> <unk>", "a\u2581b", "\u3000x", "\u00e9 e\u0301", "\ufeffx", "\U0001f600 \U0001f600", "<0x41>", "it's they've", "1234 56 789"]


@pytest.mark.parametrize(("block", "fan", "frame", "kept"), [(4_000_000, 64, 4096, 300_000), (3000, 2, 7, 50)])
def test_alignment_equals_brute_force(spark, prose, monkeypatch, block, fan, frame, kept):
    for name, value in (("BLOCK_BYTES", block), ("FAN", fan), ("FRAME", frame), ("KEPT", kept)):
        monkeypatch.setattr(alignment, name, value)
    rows = [*prose, *((500 + i, t) for i, t in enumerate(ODD)), (None, "the end"), (7, "again the"), (7, "again the")]
    want, counts, top = plain_alignment(rows)
    got = alignment.op13_alignment(frame_of(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def frame_of(spark, rows):
    return frame(spark, rows).repartition(3)


def test_pairs_and_texts_of_groups(spark, prose):
    rows = prose[:30]
    want, counts, top = plain_alignment(rows)
    docs = frame(spark, rows)
    blocks = alignment.blocks_of(docs, BYTE_LEVEL, PIECES, public_tokenizers.PATTERN)
    counted = alignment.count_pairs(blocks.where("radix >= 0").select("radix", "block", "frames"), blocks.where("radix < 0").count())
    got = {(r.a, r.b): (r.n, r.best) for r in alignment.pairs_of(counted).collect()}
    assert got == {(a, b): (n, n == top[b]) for (a, b), n in counts.items()}
    texts = {r.id: r.groups for r in alignment.alignment(docs, BYTE_LEVEL, PIECES, public_tokenizers.PATTERN).collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() if t else "" for i, t in texts.items()} == {w[0]: w[-1] for w in want}
    assert alignment.op13_alignment(docs.where("false")).count() == 0


def test_tokens_of_stretches_equal_those_of_whole_texts(sides):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the", "Haus", " ", "  ", "\n", "a", "\u00e9", "\u2581", "x.y", "\t", "12", "\U0001f600"]) for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ODD
    (ids_a, _, n_a), (ids_b, _, n_b) = alignment.align(texts, sides)
    at_a, at_b = np.cumsum(n_a), np.cumsum(n_b)
    for i, (a, _, b, _) in enumerate(plain_tokens(texts)):
        assert ids_a[at_a[i] - n_a[i] : at_a[i]].tolist() == a and ids_b[at_b[i] - n_b[i] : at_b[i]].tolist() == b, texts[i]


def test_merged_runs_are_the_sums():
    rng = np.random.default_rng(3)
    runs, want = [], Counter()
    for _ in range(9):
        keys = np.unique(rng.integers(0, 1 << 60, 3)[rng.integers(0, 3, 50)] + rng.integers(0, 2000, 50))
        n = rng.integers(1, 50, len(keys))
        runs.append(alignment._pack(keys, n))
        for k, m in zip(keys.tolist(), n.tolist(), strict=True):
            want[k] += m
    assert list(alignment.merged(runs)) == sorted(want.items())
