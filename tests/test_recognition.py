from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmatch import config as C
from labelmatch.functions.vectors import average_views, check_dimension, cosine_distance, embed_in_batches
from labelmatch.operators import components, decide, evaluate, retrieve, twins
from labelmatch.operators.components import connected_components


def test_zones(spark):
    rows = spark.createDataFrame([(0.9, 0.2), (0.9, 0.1), (0.9, None), (0.83, 0.15), (0.7, 0.5), (0.4, 0.5), (None, 0.5), (0.485, 0.2)], "s double, m double")
    got = [r[0] for r in rows.select(decide.classify(F.col("s"), F.col("m"), 0.83, 0.15, 0.485)).collect()]
    assert got == ["found", "probable", "found", "found", "probable", "not_in_catalog", "probable", "probable"]
    with pytest.raises(ValueError):
        C.check_thresholds(0.9, 0.8)


def test_second_model_overrules_and_missing_counts_minus_one(spark):
    sims = spark.createDataFrame([(1, 1, "B", 1, 0.9), (1, 1, "B", 2, 0.8), (1, 2, "B", 1, 0.7), (1, 1, "A", 1, 0.2), (1, 2, "A", 1, 0.9), (1, 2, "A", 2, 0.9)], "query_id long, product_id long, model string, view int, similarity double")
    candidates = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, product_id long")
    got = {r.product_id: (r.rank, r.fusion) for r in decide.fuse(candidates, sims, [1, 2]).collect()}
    assert got == {1: (1, 1.7 + 0.3 * (0.2 - 1)), 2: (2, round(0.7 - 1 + 0.3 * 1.8, 4)), 3: (3, -2.6)}


def test_a_query_without_candidates_is_not_in_the_catalog(spark):
    ranked = spark.createDataFrame([(1, 5, 1, 1.6, 0.5, 0.9)], "query_id long, product_id long, rank int, fusion double, best_a double, best_b double")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: (r.status, r.winner, r.margin) for r in decide.answers(ranked, queries, 0.8, 0.1, 0.5).collect()}
    assert got == {1: ("found", 5, None), 2: ("not_in_catalog", None, None)}


def test_vintage_bounds(spark):
    rows = spark.createDataFrame([("Chateau X 2019 Grand Cru Bordeaux",), ("Vintage 1985 reserve",), ("anno 1700",), ("in 2100",), (None,)], "t string")
    assert [r[0] for r in rows.select(decide.vintage(F.col("t"))).collect()] == [2019, 1985, None, None, None]


def test_evidence_without_points(spark):
    rows = spark.createDataFrame([(0.8, None, None), (0.8, 300, 300)], "s double, g int, i int")
    got = [r[0] for r in rows.select(decide.evidence_score(F.col("s"), F.col("g"), F.col("i"))).collect()]
    assert got == pytest.approx([0.32, 0.92])


def test_ratio_test(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 1.0)] * 4 + [(1, 1, 0.9, 1.0), (1, 2, 0.1, None)], "query_id long, product_id long, d1 double, d2 double")
    got = {r.product_id: (r.good, r.usable) for r in decide.ratio_test(rows).collect()}
    assert got == {1: (4, True), 2: (0, False)}


def test_block_kernel_equals_native_arrays(spark):
    rng = np.random.default_rng(3)
    refs = spark.createDataFrame([(i, i % 7, [float(x) for x in rng.standard_normal(8)]) for i in range(60)], "vector_id long, product_id long, vec array<double>")
    queries = refs.where("vector_id % 9 = 0").select(F.col("vector_id").alias("query_id"), "vec")
    blocks = {(r.query_id, r.product_id): round(r.distance, 9) for r in retrieve.best_per_product(queries, refs).collect()}
    pairs = queries.withColumnRenamed("vec", "q").crossJoin(refs).where("query_id <> vector_id")
    native = pairs.groupBy("query_id", "product_id").agg(F.min(cosine_distance(F.col("q"), F.col("vec"))).alias("d")).collect()
    assert blocks == {(r.query_id, r.product_id): round(r.d, 9) for r in native}


def test_votes_inside_and_outside_the_pool(spark):
    refs = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 2, [1.0, 0.2]), (4, 3, [0.0, 1.0])], "vector_id long, product_id long, vec array<double>")
    queries = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, vec array<double>")
    pool = {r.product_id: r.votes for r in retrieve.nearest_with_votes_pool(queries, refs, 5, 3).collect()}
    every = {r.product_id: r.votes for r in retrieve.nearest_with_votes(queries, refs, 5, 3).collect()}
    none = retrieve.nearest_with_votes(queries, refs, 5, 3, refs.where("false")).count()
    assert (pool, every, none) == ({1: 2, 2: 1}, {1: 2, 2: 1, 3: 1}, 0)


def test_views_dimensions_and_embedder(spark):
    views = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 3.0]), (2, [0.0, 0.0])], "k long, v array<double>")
    got = {r.k: r.v for r in average_views(views, "k", "v").collect()}
    assert got[1] == pytest.approx([0.5**0.5] * 2) and got[2] == [0.0, 0.0]
    good, bad = check_dimension(spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "v array<double>"), "v", 2)
    assert (good.count(), bad.count()) == (1, 2)
    texts = spark.createDataFrame([("ab",), ("c",)], "t string")
    out = embed_in_batches(texts, lambda xs: np.array([[len(x), 0.0] for x in xs]), "t", 2).collect()
    assert [r.embedding for r in out] == [[1.0, 0.0], [1.0, 0.0]]


def test_components_chain_pair_and_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(500, 500 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {500 + i: 500 for i in range(60)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_round_of_components_reads_its_edges_once_an_end(spark):
    edges = spark.range(9).selectExpr("id + 1 as u", "id as v")
    plan = components._small_star(components._large_star(edges))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range") == 4 and plan.count("Aggregate") == 4  # the minima of both stars, twice the larger, and what is told apart at the end


def test_components_end_with_the_round_that_makes_stars(spark, monkeypatch):
    made = []
    keep = components.written
    monkeypatch.setattr(components, "written", lambda *a: made.append(0) or keep(*a))
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)] + [(100, 100 + i) for i in range(1, 9)], "u long, v long")
    got = {r.node: r.component for r in connected_components(pairs).collect()}
    assert got == {i: i - i % 2 for i in range(60)} | {100 + i: 100 for i in range(9)}
    assert len(made) == 2  # the edges, and one round


def test_twins_leave_singletons_out_and_the_approximate_form_finds_near_pairs(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.05, 0.0]), (3, [1.0, 0.1, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 1.0, 0.02]), (6, [0.0, 0.0, 1.0])]
    refs = spark.createDataFrame(rows, "product_id long, vec array<double>")
    names = spark.createDataFrame([(i, f"t{i}", "a" if i != 2 else "b") for i in range(1, 7)], "product_id long, title string, manufacturer string")
    pairs = twins.twin_pairs(refs, 0.97, 10)
    got = {r.cluster_id: (r.size, r.manufacturer, r.members) for r in twins.twin_clusters(pairs, names).collect()}
    assert got == {1: (3, "a", "1,2,3"), 4: (2, "a", "4,5")}
    near = {(r.p1, r.p2) for r in twins.approx_twin_pairs(refs, 0.97).collect()}
    assert near == {(r.p1, r.p2) for r in pairs.collect()}


def test_signatures_find_near_pairs_with_the_probability_asked_for(spark):
    rng = np.random.default_rng(3)
    rows, angle = [], np.arccos(0.881)
    for i in range(600):  # pairs of similarity 0.881, just above the bound, among unlike vectors
        a, b = rng.standard_normal((2, 48))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        rows += [(2 * i, a.tolist()), (2 * i + 1, (3 * (np.cos(angle) * a + np.sin(angle) * b / np.linalg.norm(b))).tolist())]
    odd = [(None, rows[0][1]), (5000, None), (5001, [0.0] * 48), (5002, [float("nan")] * 48)]
    refs = spark.createDataFrame(rows + odd, "product_id long, vec array<double>")
    row = twins.twin_recall(refs, 0.88, 0.99).first()
    assert row.exact == 600 and row.found >= 585  # 594 expected; below 585 once in 10,000
    assert twins.twin_recall(refs.limit(0), 0.88).first()[1:] == (0, 0, None)


def test_copies_in_one_bucket_are_met_in_pieces_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(twins, "PIECE", 7)
    monkeypatch.setattr(twins, "LOT", 20)
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "product_id long, vec array<double>")
    got = [(r.p1, r.p2) for r in twins.approx_twin_pairs(copies, 0.9).collect()]
    assert sorted(got) == [(i, j) for i in range(30) for j in range(i + 1, 30)]


def test_signatures_that_cost_less_than_all_pairs_find_the_near_ones(spark, monkeypatch):
    monkeypatch.setattr(twins, "MOVED", 1)
    monkeypatch.setattr(twins, "PIECE", 7)
    monkeypatch.setattr(twins, "LOT", 20)
    assert twins.signature_plan(330, 0.97)[0] > 0
    data, _ = groups_of_vectors(5, 60)
    rows = data + [(9000 + i, [1.0] + [2.0] * (len(data[0][1]) - 1)) for i in range(30)]
    refs = spark.createDataFrame(rows, "product_id long, vec array<double>")
    want = plain_pairs(data + rows[-30:], 0.97)
    got = {(r.p1, r.p2): r.similarity for r in twins.approx_twin_pairs(refs, 0.97).collect()}
    assert got.keys() <= want.keys() and len(got) > 0.9 * len(want) and sum(a >= 9000 for a, _ in got) == 435


def test_unlike_vectors_are_compared_and_not_moved_into_many_tables(spark):
    assert twins.signature_plan(600_000, 0.4) == (0, 1)  # 14 bits and 1,888 tables, each vector moved for each of them
    assert twins.signature_plan(600_000, 0.93)[1] < 20


def test_a_vector_is_sent_once_to_a_lot_of_cells(spark, monkeypatch):
    from labelmatch.functions import cells

    monkeypatch.setattr(cells, "PIECE", 7)
    monkeypatch.setattr(cells, "SHARES", 1)
    data, _ = groups_of_vectors(8, 60)
    refs = spark.createDataFrame(data, "product_id long, vec array<double>")
    held = twins._cells(refs)
    sent = twins._visits(held, -1.0)  # all cells from its own on
    per = sent.groupBy("id").agg(F.count("*").alias("lots"), F.sum(F.size("cells")).alias("pieces"), F.count_distinct("lot").alias("once")).collect()
    lots = int(held.lots.max()) + 1
    assert len(held.lots) == held.pieces.sum() > 2 * lots and held.sizes.sum() == len(data)
    assert all(r.lots == r.once <= lots for r in per) and max(r.pieces for r in per) == len(held.lots)


def test_more_vectors_take_more_bits():
    plans = [twins.signature_plan(n, 0.88, 0.99) for n in (10**3, 10**6, 10**9)]
    assert plans[0][0] < plans[1][0] < plans[2][0]
    for bits, tables in plans:
        same = 1 - np.arccos(0.88) / np.pi
        assert 1 - (1 - same**bits) ** tables >= 0.99


def test_settings_whose_zones_overlap_or_lack_a_bound(spark):
    rows = [("met", 0.5, 0.5), ("good", 0.4, 0.5), ("over", 0.6, 0.5), ("none", None, 0.5), ("nan", 0.2, float("nan"))]
    got = decide.threshold_errors(spark.createDataFrame(rows, "name string, reject_below double, found_similarity double")).collect()
    assert {tuple(r) for r in got} == {("over", "exceeds"), ("none", "missing"), ("nan", "missing")}


def test_p95_and_upper_median_are_index_rules(spark):
    rows = spark.createDataFrame([("a", i) for i in range(1, 11)] + [("b", 5)], "g string, v int")
    p95 = {r.g: r.x for r in evaluate.at_index(rows, ["g"], "v", evaluate.p95_index(), "x").collect()}
    mid = {r.g: r.x for r in evaluate.at_index(rows, ["g"], "v", evaluate.upper_median_index(), "x").collect()}
    assert (p95, mid) == ({"a": 9, "b": 5}, {"a": 6, "b": 5})


def test_clusters_are_built_from_all_pairs(spark, tmp_path):
    from labelmatch.plans import recognition

    vec = lambda g: [float(i == g) for i in range(64)]
    rows = [(i, vec(0)) for i in range(70)] + [(100, vec(1)), (101, [0.0, 1.0, 1.0, *[0.0] * 61])]  # 2,415 pairs of equal vectors, then a less similar one
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(i, f"n{i:03}", "m") for i, _ in rows], "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.cluster_id: r["size"] for r in recognition.twin_clusters(spark, str(tmp_path)).collect()}
    assert got == {0: 70, 100: 2}


def groups_of_vectors(n_groups, each, dim=12, width=0.05, seed=5):
    """Vectors close to a few directions, exact copies, a zero vector and odd rows among them, as (id, vec)."""
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n_groups, dim))
    rows = [c + rng.standard_normal(dim) * width for c in centers for _ in range(each)]
    rows += [rows[0]] * 6
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    return data, [(5000, [0.0] * dim), (5001, None), (None, [1.0] * dim), (5002, [float("nan")] * dim), (5003, [1.0, 2.0]), (5004, [None] * dim)]


def plain_pairs(data, least):
    unit = np.array([v for _, v in data])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = unit @ unit.T
    return {(data[i][0], data[j][0]): sims[i, j] for i, j in zip(*np.nonzero(np.triu(sims >= least, 1)), strict=True)}


@pytest.mark.parametrize("piece", [2048, 7])
def test_twins_skip_cells_and_miss_no_pair(spark, monkeypatch, piece):
    from labelmatch.functions import cells

    monkeypatch.setattr(cells, "PIECE", piece)
    data, odd = groups_of_vectors(8, 60)
    refs = spark.createDataFrame(data + odd, "product_id long, vec array<double>").repartition(3)
    want = plain_pairs(data, 0.97)
    got = [(r.p1, r.p2, r.similarity) for r in twins.similar_pairs(refs, 0.97).collect()]
    assert len(got) == len(want) and {(a, b): pytest.approx(s) for a, b, s in got} == want
    told = twins.cells_skipped(refs, 0.97).first()
    assert told.vectors == len(data) and told.skipped > 0.5
    best = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:50]
    assert sorted(round(r.similarity, 9) for r in twins.twin_pairs(refs, 0.97, 50).collect()) == sorted(round(s, 9) for _, s in best)
    few = {(r.p1, r.p2): r.similarity for r in twins.linking_pairs(refs, 0.97).collect()}
    assert few.keys() <= want.keys() and len(few) < 0.6 * len(want)
    edges = lambda pairs: spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "u long, v long")
    parts = [{r.node: r.component for r in connected_components(edges(p)).collect()} for p in (few, want)]
    assert parts[0] == parts[1]
    for c in set(parts[1].values()):
        assert max(s for (a, _), s in few.items() if parts[1][a] == c) == pytest.approx(max(s for (a, _), s in want.items() if parts[1][a] == c))


def test_copies_are_linked_once(spark):
    refs = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(100, [2.0, -1.0])], "product_id long, vec array<double>")
    assert sorted((r.p1, r.p2) for r in twins.linking_pairs(refs, 0.9).collect()) == [(0, i) for i in range(1, 40)]
    names = spark.createDataFrame([(i, "t", "m") for i in range(39)], "product_id long, title string, manufacturer string")
    assert sorted((r.cluster_id, r.product_id) for r in twins.twin_members(twins.linking_pairs(refs, 0.9), names).collect()) == [(0, i) for i in range(39)]


def test_spanning_places_connect_what_all_do():
    rng = np.random.default_rng(1)
    for density in (0.01, 0.05, 0.3, 1.0):
        mask = rng.random((30, 40)) < density
        i, j = twins.spanning(mask)
        assert mask[i, j].all()

        def parts(a, b):
            root = list(range(70))
            for u, v in zip(a.tolist(), (b + 30).tolist(), strict=True):
                x, y = root[u], root[v]
                root = [min(x, y) if r in (x, y) else r for r in root]
            return root

        every = parts(*np.nonzero(mask))
        assert parts(i, j) == every and len(i) == 70 - len(set(every))


@pytest.mark.parametrize("piece", [2048, 7])
def test_two_rounds_find_the_nearest_and_spare_cells(spark, monkeypatch, piece):
    from labelmatch.functions import cells

    monkeypatch.setattr(cells, "PIECE", piece)
    data, odd = groups_of_vectors(8, 60, width=0.2)
    refs = spark.createDataFrame([(i, None if i is None else i % 37, v) for i, v in data + odd], "vector_id long, product_id long, vec array<double>")
    queries = refs.where("vector_id % 9 = 0 or vector_id is null").select(F.col("vector_id").alias("query_id"), "vec")
    unit = np.array([v for _, v in data])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    away = {i: 1 - unit @ unit[i] for i in range(0, len(data), 9)}

    def plain(i, k, left_out=()):
        best = {}
        for j, d in enumerate(away[i].tolist()):
            if j != i and j % 37 not in left_out:
                best[j % 37] = min(best.get(j % 37, (9,)), (d, j))
        best.setdefault(5000 % 37, (1.0, 5000))  # the zero vector
        return sorted((round(d, 9), p) for p, (d, _) in best.items())[:k]

    listed = lambda rows: {q: sorted((round(r.distance, 9), r.product_id) for r in rows if r.query_id == q) for q in {r.query_id for r in rows}}
    assert listed(retrieve.nearest_products(queries, refs, 3).collect()) == {i: plain(i, 3) for i in away}
    without = spark.createDataFrame([(i, i % 37) for i in away], "query_id long, product_id long")
    assert listed(retrieve.nearest_products(queries, refs, 3, without).collect()) == {i: plain(i, 3, {i % 37}) for i in away}
    pool = retrieve.nearest_vectors(queries, refs, 5).collect()
    assert {q: [round(r.distance, 9) for r in sorted(pool, key=lambda r: r["rank"]) if r.query_id == q] for q in away} == {i: sorted(round(d, 9) for j, d in enumerate(away[i].tolist()) if j != i)[:5] for i in away}
    votes = retrieve.nearest_with_votes(queries, refs, 3, 20).collect()
    near = {i: Counter(j % 37 for _, j in sorted((round(d, 12), j) for j, d in enumerate(away[i].tolist()) if j != i)[:20]) for i in away}
    assert listed(votes) == {i: plain(i, 3) for i in away} and all(r.votes == max(1, near[r.query_id][r.product_id]) for r in votes)
    told = retrieve.cells_visited(queries, refs, 3).collect()
    assert {r.query_id for r in told} == set(away) and sum(r["first"] + r.second for r in told) < 0.8 * sum(r.cells for r in told)


def test_a_labelled_query_left_without_candidates_is_rejected(spark):
    refs = spark.createDataFrame([(10, 1, [1.0, 0.0])], "vector_id long, product_id long, vec array<double>")
    queries = spark.createDataFrame([(q, v, m, [1.0, 0.1]) for q in (1, 2) for v in (1, 2) for m in "AB"], "query_id long, view int, model string, vec array<double>")
    labels = spark.createDataFrame([(1, "in", [1]), (2, "out", [])], "query_id long, kind string, accepted array<long>")
    got = {(r.kind, r.query_id): r.status for r in evaluate.replay(queries, refs, refs, labels, 0.9, 0.1, 0.5).collect()}
    assert got == {("positive", 1): "found", ("negative", 2): "found", ("left_out", 1): "not_in_catalog"}


def test_similarities_of_candidates_by_pieces_equal_brute_force(spark, monkeypatch):
    """Products in several pieces, two models and views, a query among the vectors, a product of that query alone: no row for a pair is made."""
    monkeypatch.setattr(retrieve, "HELD", 3)
    rng = np.random.default_rng(5)
    vecs = {m: rng.standard_normal((40, 8)) for m in "AB"}
    refs = [(i, 39 if i == 39 else i % 4, m, vecs[m][i].tolist()) for m in "AB" for i in range(40)]
    asked = {(q, v, m): rng.standard_normal(8) for q in (3, 7, 39) for v in (1, 2) for m in "AB"}
    wanted = [(3, 3), (3, 1), (7, 3), (7, 9), (39, 39), (39, 0)]
    queries = spark.createDataFrame([(q, v, m, x.tolist()) for (q, v, m), x in asked.items()], "query_id long, view int, model string, vec array<double>")
    out = retrieve.max_similarity_by_product(queries, spark.createDataFrame(refs, "vector_id long, product_id long, model string, vec array<double>"), spark.createDataFrame(wanted, "query_id long, product_id long"), ["model"], ["view"])
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "NOT (query_id" not in plan  # queries and vectors are not joined row by row
    got = {(r.query_id, r.product_id, r.model, r["view"]): r.similarity for r in out.collect()}
    unit = lambda x: x / np.linalg.norm(x)
    want = {}
    for (q, v, m), x in asked.items():
        for _, p in (w for w in wanted if w[0] == q):
            sims = [unit(x) @ unit(vecs[m][i]) for i in range(40) if (39 if i == 39 else i % 4) == p and i != q]
            if sims:
                want[q, p, m, v] = pytest.approx(max(sims))
    assert got == want
