import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pandas.util import hash_array
from pyspark.sql import functions as F

from labelmatch.functions.storage import written
from labelmatch.llm import langid, licenses, mixing, pii, toxicity
from tests.llm.test_tokens_and_repeats import frame

SMALL = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = langid.op2_langid(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "12 34 !?", "fr"), (5, "", None), (6, "chaton", None), (7, "the", None), (None, "le chat", None), (7, "the", None)]
    docs = spark.createDataFrame([(i, t, x, "e") for i, t, x in rows], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, least=1)
    got = [(r.id, r.lang_pred) for r in langid.predict(docs, model).collect()]
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "fr"), (7, "en"), (None, "fr"), (7, "en")]
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_unseen_words_use_the_longest_known_grams():
    row = lambda *x: np.log(np.array(x, np.float32))
    model = langid.Model(["a", "b"], [{"cat": row(0.9, 0.1)}, {"c": row(0.1, 0.9)}, {}, {"cat": row(0.8, 0.2)}, {}])
    assert np.exp(model.word("cat")) == pytest.approx([0.9, 0.1], abs=1e-6)
    assert np.exp(model.word("cats")) == pytest.approx([0.8, 0.2], abs=1e-6)
    assert np.exp(model.word("cx")) == pytest.approx([0.1, 0.9], abs=1e-6)
    assert model.word("zz").tolist() == [0, 0]


def test_language_predictions_equal_brute_force(spark, prose):
    """Counting, back-off and posterior once more, word by word; a text of one very long word and one of many words among them."""
    rows = [(i, t, ["en", "de", "fr"][k % 3]) for k, (i, t) in enumerate(prose)] + [(900, "ß" * 3000, None), (901, "wort " * 20_000, "de"), (902, "zzz qqq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    langs, counts = ["de", "en", "fr"], [defaultdict(lambda: np.zeros(3)) for _ in range(5)]
    for _, t, lang in rows:
        for w in letters(t) if lang and t is not None else ():
            counts[0][w][langs.index(lang)] += 1
            for n in range(1, 5):
                held = f"_{w}_" if n > 1 else w
                for at in range(len(held) - n + 1):
                    counts[n][held[at : at + n]][langs.index(lang)] += 1
    tables = []
    for held in counts:
        kept = {g: np.where(k >= 2, k, 0) for g, k in held.items() if (k >= 2).any()}
        total = sum((k + 0.5 for k in kept.values()), np.zeros(3))
        tables.append({g: np.log(((k + 0.5) / total).astype(np.float32)) for g, k in kept.items()})

    def word(w):
        if w in tables[0]:
            found = tables[0][w]
        else:
            for n in (4, 3, 2, 1):
                held = f"_{w}_" if n > 1 else w
                known = [tables[n][held[at : at + n]] for at in range(len(held) - n + 1) if held[at : at + n] in tables[n]]
                if known:
                    found = np.mean(known, axis=0)
                    break
            else:
                return np.zeros(3)
        return found - np.log(np.exp(found.astype(float)).sum())

    model = langid.fit(docs, per_lang=10**9)
    got = {r.id: r for r in langid.predict(docs, model).collect()}
    for i, t, _ in rows:
        words = letters(t)
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        sums = sum(n * word(w) for w, n in Counter(words).items()) / math.sqrt(len(words))
        post = np.exp(sums - sums.max()) / np.exp(sums - sums.max()).sum()
        assert got[i].score == pytest.approx(post.max(), abs=1e-3) and post[langs.index(got[i].lang_pred)] == pytest.approx(post.max(), abs=1e-3)


def plain_marginals(scores, moves):
    """Marginals of T over all labellings."""
    n = len(scores)
    total, at = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        s = moves[4] * y[0] + sum(e for e, b in zip(scores, y, strict=True) if b) + sum(moves[2 * a + b] for a, b in zip(y, y[1:], strict=False))
        total += np.exp(s)
        at += np.exp(s) * np.array(y)
    return at / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    moves = rng.normal(size=5)
    counts = np.array([3, 0, 7, 1])
    scores = rng.normal(size=11)
    ahead, back = toxicity.messages(scores, counts, moves)
    odds = ahead * back
    want = np.concatenate([plain_marginals(scores[a : a + n], moves) for a, n in zip(np.cumsum(counts) - counts, counts, strict=True) if n])
    assert odds / (1 + odds) == pytest.approx(want)


def test_toxicity_scores_equal_brute_force(spark, prose):
    """Scores and spans of a model by plain loops over the words, for short, long and odd texts."""
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(0, 1.5, toxicity.FEATURES).astype(np.float32), np.array([0.3, -2.0, -0.5, 0.4, -2.0]), np.array([-1.0, 0.4, 0.7, 0.5]))
    rows = [*prose, (800, "İstanbul'da SIĞINAK ß"), (801, " ".join(f"w{i % 97}" for i in range(5000)))]

    def emission(w):
        names = [("word", w), ("suffix", w[-3:]), *((f"prefix {n}", w[:n]) for n in toxicity.PREFIXES if len(w) >= n)]
        at = [int(hash_array(np.array([x], object), hash_key=k.ljust(16, "-"), categorize=False)[0] % np.uint64(toxicity.FEATURES)) for k, x in names]
        return float(np.clip(sum(float(model.weights[i]) for i in at), -30, 30))

    oo, ot, to, tt = np.exp(model.moves[:4])
    got = {r.id: r for r in toxicity.score(frame(spark, rows), model).collect()}
    for i, t in rows:
        words = regex.findall(toxicity.WORDS, (t or "").lower())
        odds = np.exp([emission(w) for w in words])
        ahead, back = np.ones(len(words)), np.ones(len(words))
        for k in range(len(words)):
            ahead[k] = odds[k] * (np.exp(model.moves[4]) if not k else (ot + ahead[k - 1] * tt) / (oo + ahead[k - 1] * to))
        for k in range(len(words) - 2, -1, -1):
            r = odds[k + 1] * back[k + 1]
            back[k] = (to + r * tt) / (oo + r * ot)
        log = np.clip(np.log(ahead) + np.log(back), -15, 15)
        total = (1 / (1 + np.exp(-log))).sum()
        seen = np.array([1, log.max(initial=-15), np.log1p(total), np.log((total + 0.1) / (len(words) + 10))])
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(seen @ model.document))), rel=1e-6)
        assert len(got[i].spans) == (log >= 0).sum()
        assert [t[s.start : s.end].lower() for s in got[i].spans] == [w for w, x in zip(words, log, strict=True) if x >= 0] or "İ" in t


def test_toxicity_held_out_and_spans(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op8_toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    clean, toxic = [r for r in held if not r.toxic], [r for r in held if r.toxic]
    assert sum(r.predicted for r in clean) / len(clean) < 0.02
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    text = "Of the idiot, thheti was\na moron."
    spans = toxicity.score(frame(spark, [(1, text)]), model).first().spans
    assert {text[s.start : s.end] for s in spans} >= {"idiot", "moron"}
    odd = [(1, None), (2, ""), (3, "!!"), (4, "the"), (4, "the"), (None, "idiot moron scum")]
    assert toxicity.score(frame(spark, odd), model).count() == 6
    kept = toxicity.drop_toxic(frame(spark, odd), model)
    assert kept.columns == frame(spark, []).columns and sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "4"]
    assert toxicity.drop_toxic(frame(spark, []), model).count() == 0
    empty = toxicity.fit(docs, labels.where("false"))
    assert {r.score < 0.5 for r in toxicity.score(frame(spark, odd), empty).collect()} == {True}


def plain_licences(words):
    """Every start of every template, tried."""
    out = []
    for label, text, keys in licenses.TEMPLATES:
        wanted = licenses.words_of(text)
        for start in range(-len(wanted), len(words)):
            here = [words[start + i] if 0 <= start + i < len(words) else b"" for i in range(len(wanted))]
            stands = lambda k: any(wanted[p : p + len(k)] == k == here[p : p + len(k)] for p in range(len(wanted)))  # noqa: E731, B023
            if all(stands(licenses.words_of(k)) for k in keys):
                out.append((label, max(start, 0), sum(x == y for x, y in zip(here, wanted, strict=True)) / len(wanted)))
    return sorted(out)


def licence_texts():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            cut = sorted(rng.sample(range(len(words) + 1), 2)) if rng.random() < 0.3 and len(words) > 2 else (0, len(words))
            words = words[cut[0] : cut[1]]
            for at in rng.sample(range(len(words)), len(words) // 30):
                words[at] = "changed"
            parts += [" ".join(words), " ".join(rng.choice(["the license", "permission is hereby", "public", "mit", "software", "word"]) for _ in range(rng.randrange(6)))]
        rows.append((1000 + i, " ".join(parts)))
    return rows


def test_licences_equal_brute_force(spark, prose):
    lines = ["Released under the MIT License.", "MIT LICENSE mit license", "the gnu General Public-License, version 3", "apache license", "licensed under CC BY 4.0 now", "mit éducation license", "Licensed under the Apache License, Version 2.0"]
    rows = [*prose, *[(400 + i, f"{prose[20 + i][1]} {x} {prose[30][1]}") for i, x in enumerate(lines)], *licence_texts(), (None, lines[0]), (400, lines[1])]
    got = {(r.doc_id, r.n_words): r for r in licenses.op6_license(frame(spark, rows)).collect()}
    several = 0
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i, len(words)]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min([k for k, _ in places], default=None), max([k for k, _ in places], default=None))
        found = plain_licences([w.encode() for w in words]) if len(words) < 3000 else []
        several += len({x for x, _, _ in found}) > 1
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert r.labels == ",".join(sorted({x for x, _, _ in found} | {x for _, x in places}))
        assert r.score == pytest.approx(max([s for _, _, s in found] + [0.5 if places else 0.0]))
    assert several > 10
    label_of = lambda i: next(r.labels for (k, _), r in got.items() if k == i)
    assert "mit-notice" in label_of(400) and "cc-by-4.0" in label_of(404) and "apache-2.0" in label_of(406) and label_of(405) == ""
    assert licenses.op6_license(frame(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, "mit license", "x", 5)], "doc_id long, text string, id string, n_words int")
    assert licenses.op6_license(clash).first().n_words == 2


def test_every_template_finds_itself():
    known = licenses.index(licenses.TEMPLATES, 10, {})
    for label, text, _ in licenses.TEMPLATES:
        words = [b"so", *licenses.words_of(text), b"end"]
        assert (label, 1, 1.0) in licenses.match(words, known)


def test_key_phrases_are_found_at_the_first_word():
    for frequencies in ({}, dict.fromkeys(licenses.vocabulary(licenses.TEMPLATES), 9)):
        known = licenses.index(licenses.TEMPLATES, 10, frequencies)
        for label, text, keys in licenses.TEMPLATES:
            words = licenses.words_of(text)
            spots = [(licenses._find(words, tuple(licenses.words_of(k)))[0], len(licenses.words_of(k))) for k in keys]
            first, last = min(p for p, _ in spots), max(p + n for p, n in spots)
            for before in ([], [b"so"], [b"so"] * 50):
                found = licenses.match([*before, *words[first:last], b"end"], known)
                assert label in {x for x, _, _ in found} and all(at >= 0 for _, at, _ in found)
        top = lambda text: {x for x, _, _ in licenses.match(licenses.words_of(text), known)}  # noqa: E731, B023
        assert "gpl-3.0" in top("GNU General Public License version 3") and "apache-2.0" in top("Apache License, Version 2.0") and "mpl-2.0" in top("Mozilla Public License v. 2.0")


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def pii_texts():
    rng = random.Random(8)
    parts = ["a.b@c.de", "x@y.z..w@q.r", "a@b.c_d@e.f", "@", "..", "1.2.3.4", "300.1.1.1.1", "0001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111--1111", "5500000000000004", "+49 (30) 1234-567", "+1", "++44 20 7946 0958", "é", "漢", " ", "\n", "word", "-", ".", "7", "+"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for i in range(300)] + [(900, None), (901, ""), (902, "9" * 4000), (903, "1 " * 4000), (904, "a" * 4000 + "@b" + ".c" * 4000), (905, "1." * 4000), (906, "+1 " * 3000)]


def test_pii_base_spans_equal_regexes(spark):
    rows = pii_texts()
    got = {r.doc_id: r for r in pii.op9_pii(frame(spark, rows)).collect()}
    for i, t in rows:
        want = plain_pii(t or "")
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        n = Counter(k for k, _, _ in want)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in pii.KINDS), (t, shown, r.spans)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert r.spans == shown or r.spans.startswith(shown + ",term") or (not shown and r.spans.startswith("term"))
    assert pii.op9_pii(frame(spark, [])).count() == 0


def test_pii_terms_that_reveal_are_removed(spark):
    rows = [(1, "Hugo Zeppelin writes from h@z.de the and words"), (2, "again Zeppelin, h@z.de, and other text here"), (3, "words here and there, other@x.org")] + [(10 + i, f"words here and text nr {i}") for i in range(20)]
    got = {r.doc_id: r for r in pii.op9_pii(frame(spark, rows)).collect()}
    spans = lambda i: [rows[i - 1][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
    assert spans(1) == ["Zeppelin"] and spans(2) == ["Zeppelin"] and got[10].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[1] == "Hugo  writes from [EMAIL] the and words" and clean[10] == rows[3][1]
    assert clean[2] == "again , [EMAIL], and other text here"
    assert pii.sanitise(frame(spark, [(1, None)])).first().text is None


def plain_terms(rows):
    """The term spans by the definition: pairs of an entity and a term counted over all rows, in plain Python."""
    entities = {n: {(k, t[a:b]) for k, a, b in plain_pii(t or "")} for n, (_, t) in enumerate(rows)}
    words = {n: {w.lower() for w in regex.findall(r"\p{L}+", t or "") if len(w) >= pii.TERM_LETTERS} for n, (_, t) in enumerate(rows)}
    told = defaultdict(set)
    for e in set().union(*entities.values()):
        own = [n for n in entities if e in entities[n]]
        if len({rows[n][1] for n in own}) >= pii.SUPPORT and len(own) < len(rows):
            for term in set().union(*(words[n] for n in own)):
                both, every = sum(term in words[n] for n in own), sum(term in w for w in words.values())
                if both >= pii.SUPPORT and round(math.log(both * len(rows) / (len(own) * every)) / math.log(len(rows) / len(own)), 9) >= pii.GENERALISE:
                    for n in own:
                        told[n] |= {term} & words[n]
    return {n: [("term", *m.span()) for m in regex.finditer(r"\p{L}+", t or "") if m[0].lower() in told[n]] for n, (_, t) in enumerate(rows)}


def test_pii_terms_equal_brute_force_and_sql(spark, monkeypatch):
    rng = random.Random(6)
    names = ["Zeppelin", "Özgür", "İstanbul", "Quark", "Weiß", "Łódź"]
    mails = [f"{chr(97 + i)}@x{i}.org" for i in range(6)]
    rows = []
    for i in range(90):
        k = rng.randrange(6)
        said = [rng.choice(["words", "here", "there", "other", "text"]) for _ in range(rng.randrange(1, 12))]
        rows.append((i, " ".join([names[k] if rng.random() < 0.8 else "", *said, mails[k] if rng.random() < 0.4 else "", names[k].upper() if rng.random() < 0.2 else "", "10.0.0.1" if i % 30 == 0 else ""])))
    rows += [rows[3], (200, None), (201, ""), (None, "Quark d@x3.org")]
    want = plain_terms(rows)
    assert sum(map(len, want.values())) > 20
    expected = sorted((repr(i), ",".join(f"{k}:{a}:{b}" for k, a, b in [*plain_pii(t or ""), *want[n]])) for n, (i, t) in enumerate(rows))
    docs = frame(spark, rows)
    assert sorted((repr(r.doc_id), r.spans) for r in pii.op9_pii(docs).collect()) == expected
    monkeypatch.setattr(pii, "MAX_BROADCAST", 1)  # the way of large tables
    assert sorted((repr(r.doc_id), r.spans) for r in pii.op9_pii(docs).collect()) == expected
    plain = [(i, t) for i, t in rows if "İ" not in (t or "")]  # its lower case has two characters in one engine and one in the other
    held = pa.table({"doc_id": pa.array([i for i, _ in plain], pa.int64()), "text": pa.array([t for _, t in plain], pa.string())})  # noqa: F841
    found = duckdb.sql(pii.oracle_sql("held"))
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in pii.op9_pii(frame(spark, plain)).select(*found.columns).collect())


def test_pii_merges_tables_beyond_the_bounds_of_a_broadcast(spark, monkeypatch):
    """Their files may be small: dealt out, they would still be collected in the driver."""
    many = spark.range(60).selectExpr("id as n", "concat('email:', id % 3, '@x.org') as entity")
    few = written(spark.range(3).selectExpr("concat('email:', id, '@x.org') as entity", "id as n_e"), "few")
    want = sorted((n, f"email:{n % 3}@x.org", n % 3) for n in range(60))
    for bound in (None, "MAX_BROADCAST", "MAX_BYTES"):
        if bound:
            monkeypatch.setattr(pii, bound, 1)
        met = pii._met(many, few, ["entity"])
        assert sorted((r.n, r.entity, r.n_e) for r in met.collect()) == want
        assert ("Broadcast" in met._jdf.queryExecution().executedPlan().toString()) == (bound is None)
        monkeypatch.undo()


def test_pii_keeps_off_python(spark):
    plan = pii.op9_pii(frame(spark, [(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_equals_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(mixing.oracle_sql())
    got = mixing.op4_mixing(docs)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


def plain_fill(amount, children):
    """Shares by weight under capacities, by raising the level in rounds."""
    out, open_ = {}, dict(children)
    while open_:
        level = amount / sum(w for w, _ in open_.values())
        full = {k for k, (w, c) in open_.items() if c <= level * w}
        if not full:
            return out | {k: level * w for k, (w, _) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[1]
            amount -= out[k]
    return out


def test_shortages_go_to_siblings_before_ancestors(spark):
    rng = random.Random(3)
    rows = [(f"d{rng.randrange(3)}", f"l{rng.randrange(3)}", f"s{i}", rng.choice([0, 5, 100, 5000]), float(rng.randrange(1, 5))) for i in range(40)]
    leaves = spark.createDataFrame([(d, x, s, n, {"d0": 1.0, "d1": 2.0, "d2": 5.0}[d], {"l0": 1.0, "l1": 3.0, "l2": 1.5}[x], w) for d, x, s, n, w in rows], "domain string, lang string, source string, tokens long, w_domain double, w_lang double, w_source double")
    got = {(r.domain, r.lang, r.source): r.alloc for r in mixing.allocate(leaves, 0.7, 2).collect()}
    cap = defaultdict(float)
    for d, x, s, n, _ in rows:
        for key in ((d,), (d, x), (d, x, s)):
            cap[key] += 2.0 * n
    top = plain_fill(float(int(0.7 * sum(r[3] for r in rows))), {k: ({"d0": 1.0, "d1": 2.0, "d2": 5.0}[k[0]], c) for k, c in cap.items() if len(k) == 1})
    mid = {}
    for k, a in top.items():
        mid |= plain_fill(a, {m: ({"l0": 1.0, "l1": 3.0, "l2": 1.5}[m[1]], c) for m, c in cap.items() if len(m) == 2 and m[:1] == k})
    low = {}
    for k, a in mid.items():
        low |= plain_fill(a, {(d, x, s): (w, 2.0 * n) for d, x, s, n, w in rows if (d, x) == k})
    assert got == {k: int(v + 1e-6) for k, v in low.items()}


def test_mixing_edges(spark):
    rows = [(1, "a b c", "en", "src1"), (1, "a b c", "en", "src1"), (2, None, None, None), (None, "x y", "de", "src2"), (4, "", "en", "web")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, source string, domain string")
    out = mixing.mix(docs, share=2.0, epochs=2)
    assert out.columns == docs.columns and out.count() >= 4
    assert mixing.mix(docs.where("false")).count() == 0
    assert out.where(F.col("doc_id") == 1).count() == 4


def test_addresses_with_zero_octets_are_found(spark):
    found = ["10.0.0.1", "0.0.0.0", "00.1.2.3", "127.0.0.1", "1.2.3.00", "000.0255.010.0"]
    rows = [(i, f"at {x} now") for i, x in enumerate([*found, "256.0.0.1", "0.0.0.0256", "0.0.0"])]
    got = {r.doc_id: r.n_ip for r in pii.op9_pii(frame(spark, rows)).collect()}
    assert got == {i: len([m for m in plain_pii(t) if m[0] == "ip"]) for i, t in rows} == {i: int(i < len(found)) for i, _ in rows}
    assert pii.sanitise(frame(spark, rows[:1])).first().text == "at [IP] now"


def test_documents_with_one_header_are_all_learned_from(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(200)]
    header = "this page was printed from the board of our town on monday morning"
    text = lambda *more: " ".join([header, *rng.choices(words, k=30), *more])
    rows = [(i, text("zwrxq", "zwrxq") if i % 2 else text()) for i in range(120)]
    docs = frame(spark, [*rows, (200, rows[0][1])])
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(200, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.id: r.score >= 0.5 for r in toxicity.score(frame(spark, [(1, text("zwrxq")), (2, text())]), model).collect()}
    assert got == {1: True, 2: False}


def test_mixing_takes_numbers_of_any_length(spark):
    names = ["web", "7", "s" + "9" * 38, "s" + "9" * 39, "s" + "1" * 200, "s01\n", "x12y", None]
    docs = spark.createDataFrame([(i, f"a b {i}", "en", s) for i, s in enumerate(names)], "doc_id long, text string, lang string, source string")
    got = {r.source: r.d for r in docs.select("source", mixing.domain_of(F.col("source")).alias("d")).collect()}
    want = {s: "none" if not (m := re.search(r"[0-9]+\Z", s or "")) else f"d{int(m[0]) % 4}" for s in names}
    assert got == want
    documents = docs.toArrow()  # noqa: F841 read by the SQL
    rows = sorted(map(tuple, mixing.op4_mixing(docs).collect()))
    assert rows == sorted(duckdb.sql(mixing.oracle_sql()).fetchall())


def test_operators_leave_the_session_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert spark.conf.get(name) == before
