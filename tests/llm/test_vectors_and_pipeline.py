import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelmatch.functions.storage import written
from labelmatch.llm import forest, negatives, pivots
from labelmatch.llm.vectors import norms
from tests.llm.test_tokens_and_repeats import shingles

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, copy string"


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(6)
    rows = rng.standard_normal((700, 16))
    for i in range(300, 500):  # near vectors, about the limit too
        rows[i] = rows[i - 300] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])
    rows[500:520] = rows[0]  # copies
    rows[520:660] = rows[1] + rng.standard_normal((140, 16)) * 0.1  # one large group
    labels = [None if i % 50 == 49 else int(i % 300 % 3) if i < 500 else (0 if i < 520 else 1) for i in range(700)]
    data = [(i, [float(np.float32(x)) for x in r], labels[i]) for i, r in enumerate(rows)]
    odd = [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] + [1.0] * 15, 1), (803, [float("inf")] + [1.0] * 15, 1), (804, [None] + [1.0] * 15, 1), (805, [1.0, 2.0], 1), (805, [1.0, 2.0], 1), (806, [], 0)]
    return [(*r, "x", "y") for r in data + odd]


@pytest.mark.parametrize("chunk", [2000, 20])
def test_near_embeddings_find_the_links(spark, cloud, chunk):
    got = {r.id: r for r in pivots.near_duplicates(spark.createDataFrame(cloud, SCHEMA), chunk=chunk, n_pivots=64).where("id <> 805").collect()}
    good = [(i, np.array(v, float), label) for i, v, label, _, _ in cloud if i < 800]
    rows = np.stack([v for _, v, _ in good])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    near = rows @ rows.T >= 0.93
    for a, (_, _, x) in enumerate(good):
        for b, (_, _, y) in enumerate(good):
            near[a, b] &= a != b and x is not None and x == y
    want = near.sum(axis=1)
    have = np.array([got[i].n_links for i, _, _ in good])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    for i in (800, 801, 802, 803, 804, 806):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    root = list(range(len(good)))
    for _ in range(len(good)):
        new = [min([root[a], *(root[b] for b in np.flatnonzero(near[a]))]) for a in range(len(good))]
        if new == root:
            break
        root = new
    assert sum(got[i].component_id == root[i] for i, _, _ in good) >= 0.9 * len(good)


def test_near_embeddings_edges(spark, cloud):
    twice = pivots.near_duplicates(spark.createDataFrame(cloud, SCHEMA).where("vec_id = 805")).collect()
    assert [(r.n_links, r.component_id) for r in twice] == [(1, 805), (1, 805)]
    assert pivots.op7_near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("chunk", [65_536, 20])
def test_forest_recall_and_scores(spark, cloud, chunk):
    """Also with lists cut by first symbols, and those of copies in pieces."""
    out, told = forest.search(spark.createDataFrame(cloud, SCHEMA), F.col("id") % 50 == 0, shard=200, chunk=chunk)
    out = out.collect()
    assert len(told.collect()) == 14
    good = [(i, np.array(v, float)) for i, v, _, _, _ in cloud if i < 800]
    rows = np.stack([v for _, v in good])
    ids = np.array([i for i, _ in good])
    hits = total = 0
    for q in range(0, 700, 50):
        cosines = (rows * rows[q]).sum(axis=1) / (norms(rows) * norms(rows[q : q + 1])[0])
        cosines[q] = -2
        best = ids[np.lexsort((ids, -cosines))][:5]
        mine = sorted((r.rank, r.id, r.score) for r in out if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(cosines[i], abs=1e-12) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(best.tolist()))
        total += 5
    assert hits / total >= 0.9
    assert [r.id for r in sorted(out, key=lambda r: r.rank) if r.query_id == 0] == [500, 501, 502, 503, 504]  # ties to the smaller id


def test_strings_share_prefixes_and_ascending_adds_the_ring(spark):
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((50, 16))
    rows[1] = rows[0] * 3
    strings = forest.Hashes(16, 8, 1).strings(rows)
    assert (strings[0] == strings[1]).all() and strings.max() < 1 << forest.SYMBOL * forest.SYMBOLS
    tree = np.sort(strings[:, 3])
    order = np.argsort(strings[:, 3], kind="stable")
    held = pa.table({"list": ["x"], "s": [tree.tobytes()], "shard": [np.zeros(50, "<i4").tobytes()], "slot": [order.astype("<i4").tobytes()]})
    shared = lambda a, b: next((x for x in range(forest.SYMBOLS, 0, -1) if a >> forest.SYMBOL * (forest.SYMBOLS - x) == b >> forest.SYMBOL * (forest.SYMBOLS - x)), 0)
    own = int(strings[0, 3])
    lengths = [shared(own, int(s)) for s in strings[:, 3]]
    told = forest._descend(held, pa.table({"of": ["x"], "q": [9], "s": [own]}))
    assert dict(zip(told["symbols"].to_pylist(), told["n"].to_pylist(), strict=True)) == {x: sum(n >= x for n in lengths) for x in range(1, forest.SYMBOLS + 1)}
    for level, seen in ((1, 2), (2, 13), (1, 13)):
        got = forest._ascend(held, pa.table({"of": ["x"], "q": [9], "s": [own], "level": [level], "seen": [seen]}))
        slots = sorted(x for s in got["slots"].to_pylist() for x in np.frombuffer(s, "<i4").tolist())
        assert slots == [i for i, n in enumerate(lengths) if level <= n < seen]


def test_forest_with_few_or_no_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "x", "y"), (7, [1.0, 1.0], 1, "x", "y"), (50, [0.0, 2.0], 1, "x", "y"), (100, None, 1, "x", "y")], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in forest.op10_nearest(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 0.707107), (0, 2, 50, 0.0), (50, 1, 7, 0.707107), (50, 2, 0, 0.0)]
    assert forest.op10_nearest(few.where("false")).count() == 0
    assert forest.op10_nearest(few.where("vec_id = 0")).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "toxicity":
            labels = spark.read.parquet(f"{SMALL}/labels.parquet")
            gone = before.join(docs, "doc_id", "left_anti").join(labels, "doc_id")
            assert gone.where("toxic = 1").count() > 4 * gone.where("toxic = 0").count()
        if name == "simhash":
            sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
            ids = sorted(sets)
            assert not [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            dropped = {r.doc_id: shingles(r.text) for r in before.join(docs, "doc_id", "left_anti").collect()}
            every = {r.doc_id: shingles(r.text) for r in before.collect()}
            assert all(any(len(s & t) >= 0.8 * len(s | t) for j, t in every.items() if j != i) for i, s in dropped.items())
        if name == "pii":
            assert docs.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.")).count() == 0 and sizes[-1] == sizes[-2]
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[4] > 0
    out = corpus_pipeline.tokenise(spark, docs, SMALL)
    joined = sorted((r.doc_id, r.decoded) for r in out.collect())
    assert joined == sorted((r.doc_id, r.text) for r in docs.collect())


def test_pipeline_stages_with_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids, texts, languages and sources, empty and very long texts, repeated rows, clashing columns, no rows at all."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "se", "ru", "ni", "po")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(40), "en", f"src{i % 5}", 1) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "de", "src1", 0), (None, text(20), "fr", None, 2), (102, text(60_000), "en", "src2", 3), (103, "write to a.b@c.org or 10.0.0.1", "en", "src3", 4), rows[0], rows[0], (104, rows[1][1], "en", "src1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for name in ("id", "h", "node", "row", "spans", "tokens", "block", "score", "k1"):
        docs = docs.withColumn(name, F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(40)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.where("false")):
        held, kept = table, []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, held, str(tmp_path))
            if name != "bpe":
                assert out.columns == docs.columns
            held = written(out, f"odd-{name}")
            kept.append((name, held.collect()))
        if table is docs:
            ids = {name: [r.doc_id for r in got] for name, got in kept}
            assert len(ids["toxicity"]) >= len(rows) - 6 and 102 in ids["toxicity"]
            assert ids["simhash"].count(0) <= 1 and 104 not in ids["simhash"] and len([i for i in ids["simhash"] if i in (100, 101)]) <= 1
            assert next(r.text for r in dict(kept)["pii"] if r.doc_id == 103) == "write to [EMAIL] or [IP]"
            assert sorted(map(repr, ids["bpe"])) == sorted(map(repr, ids["mixing"]))
        else:
            assert all(not got for _, got in kept)


def plain_negatives(rows, scale=256):
    """op11's rows by comparing all with all, in Python's integers."""
    good = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in good:
        if i % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in good if j != i)  # noqa: B905 the shorter ends in zeros
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            band = [(-n, q) for n, q, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, j, rank, q, -p, n) for rank, (n, q) in enumerate(band, 1)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "batch"), [(1024, 10_000), (3, 17)])
def test_negatives_equal_brute_force(spark, cloud, monkeypatch, anchors, batch):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = [*cloud, (None, [1.0] * 16, 1, "", ""), (850, [], 1, "", ""), (900, [-3.0] * 16, 0, "", ""), (901, [-2.0] * 16, 0, "", ""), (902, [-2.5] * 16, 1, "", "")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        got = negatives.op11_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_negatives_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.sql(negatives.oracle_sql())
    got = negatives.op11_negatives(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_negatives_edges(spark):
    assert negatives.op11_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(50, [1.0, 2.0], 1, "a", "b")] * 3  # repeated rows have no other row
    assert negatives.op11_negatives(spark.createDataFrame(one, SCHEMA)).count() == 0
    rows = [(50, [2.0], 1, "", ""), (50, [2.0], 1, "", ""), (51, [2.0], 1, "", ""), (51, [2.0], 1, "", ""), (52, [1.5], 2, "", ""), (52, [1.5], 2, "", "")]
    got = sorted(map(tuple, negatives.op11_negatives(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain_negatives(rows) and len(got) == 8


@pytest.mark.parametrize("top", [255, 1 << 20, 1 << 30, 1 << 40, (1 << 63) - 1])
def test_packed_products_are_exact(top):
    rng = random.Random(top)
    rows = np.array([[rng.randint(-top, top) for _ in range(5)] for _ in range(40)] + [[-top] * 5, [top] * 5, [0] * 5], np.int64)
    asked = [[rng.randint(-top, top) for _ in range(5)] for _ in range(20)] + [[top] * 5, [-top] * 5, [0] * 5]
    packed = negatives.Fields(rows, min(map(min, asked)), max(map(max, asked)))
    for a in asked:
        want = [max(-negatives.TOP, min(negatives.TOP, sum(x * y for x, y in zip(a, r, strict=True)))) for r in rows.tolist()]
        assert packed.scores(a).tolist() == want
