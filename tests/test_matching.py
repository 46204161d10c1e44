import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from labelmatch.operators import matching as M
from labelmatch.plans import matching as plans

SMALL = "/root/testdata/sf0.001"


def like(a, b):
    same = lambda x, y: x is not None and x == y
    return 0.4 * bool(set(a.grapes) & set(b.grapes)) + 0.3 * (same(a.category, b.category) and a.sparkling == b.sparkling) + 0.15 * same(a.region, b.region) + 0.15 * same(a.winery, b.winery)


def test_recommend_equals_the_greedy_choice(spark):
    rows = plans.scored(spark, SMALL).select("r.request_id", "p", "score").collect()
    pools = defaultdict(list)
    for r in rows:
        pools[r.request_id].append((r.score, r.p))
    want = {}
    for request, pool in pools.items():
        pool.sort(key=lambda x: (-x[0], x[1].ord))
        names, single = set(), []
        for s, p in pool:
            if p.name not in names:
                names.add(p.name)
                single.append((s, p))
        left = [x for x in single[: M.HEAD] if x[0] >= single[0][0] - M.FLOOR]
        picks = []
        while left and len(picks) < 3:
            best = max(range(len(left)), key=lambda i: (left[i][0] - M.SPREAD * max([0.0, *(like(left[i][1], q) for _, q in picks)]), -i))
            picks.append(left.pop(best))
        want[request] = [p.product_id for _, p in picks]
    got = defaultdict(list)
    for r in M.recommend(plans.scored(spark, SMALL)).orderBy("request_id", "rank").collect():
        got[r.request_id].append(r.product_id)
    assert got == want


def test_alternatives_keep_their_limits(spark):
    rows = M.alternatives(plans.products(spark, SMALL), plans.products(spark, SMALL))
    named = rows.join(plans.products(spark, SMALL).select("product_id", "name", "winery"), "product_id")
    assert named.groupBy("base_id").count().agg(F.max("count")).first()[0] <= 5
    assert named.groupBy("base_id", "winery").count().agg(F.max("count")).first()[0] <= 2
    assert named.groupBy("base_id", "name", "winery").count().agg(F.max("count")).first()[0] == 1


def odd_products(spark, n, seed):
    """Products with any number of grapes and aromas, null traits, names and wineries, and names that differ in case and blanks only."""
    rng = random.Random(seed)
    some = lambda values: rng.choice([None, *values])
    few = lambda values, most: None if rng.random() < 0.1 else [rng.choice(values) for _ in range(rng.randrange(most + 1))]
    rows = [
        (i, some(["Ab", " ab", "cd", "ef", "gh "]), some(["u", "v", "w", "x"]), some(["r", "w"]), some([True, False, False]), some([0, 1, 2, 3]), some([0.5, 1.0, 2.5, 3.0]), some([1.0, 3.0]), some([1.0, 1.5]),
         some([True, False]), some(["R1", "R2"]), some(["T1", "T2"]), few(["g1", "g2", "g3", "", None], 3), few(["a1", "a2", "a3"], 3))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "product_id long, name string, winery string, category string, sparkling boolean, sweetness int, body double, tannin double, acidity double, oak boolean, region string, type string, grapes array<string>, aroma array<string>")


def plain_alternatives(rows, k, per_winery):
    key = lambda p: (None if p.name is None else p.name.strip(" ").lower(), p.winery)
    same = lambda x, y: x is not None and x == y
    close = lambda x, y: 0.0 if x is None or y is None else max(0.0, 1 - abs(x - y) / 2)
    out = []
    for a in rows:
        met = []
        for b in rows:
            if not same(a.category, b.category) or not same(a.sparkling, b.sparkling) or a.product_id == b.product_id or key(a) == key(b):
                continue
            if a.sweetness is not None and b.sweetness is not None and abs(a.sweetness - b.sweetness) > 1:
                continue
            x, y = set(a.aroma or ()), set(b.aroma or ())
            grapes = (set(a.grapes or ()) & set(b.grapes or ())) - {None}
            worth = 0.35 * bool(grapes) + 0.15 * same(a.type, b.type) + 0.15 * close(a.body, b.body) + 0.1 * close(a.tannin, b.tannin) + 0.05 * close(a.acidity, b.acidity)
            worth += (0.2 * len(x & y) / len(x | y) if x | y else 0) + 0.05 * same(a.sweetness, b.sweetness) + 0.1 * same(a.region, b.region) + 0.05 * bool(a.oak and b.oak)
            met.append((-round(worth, 6), b.name is not None, b.name or "", b.product_id, b))
        met.sort(key=lambda m: m[:4])
        seen, wineries, rank = set(), Counter(), 0
        for near, *_, b in met:
            if key(b) in seen:
                continue
            seen.add(key(b))
            if wineries[b.winery] < per_winery and rank < k:
                wineries[b.winery] += 1
                rank += 1
                out.append((a.product_id, rank, b.product_id, -near))
    return sorted(out)


def test_alternatives_equal_brute_force_and_compare_profiles_only(spark, monkeypatch):
    """What few entries do not settle looks into all profiles; no classes are compared pair by pair, which grows with the square of the catalog."""
    compared, real = [], M.likeness
    monkeypatch.setattr(M, "likeness", lambda a, b: compared.append(str(a)) or real(a, b))
    for n, seed, k, per_winery, looks in ((150, 1, 5, 2, None), (150, 2, 4, 1, (1, 2, 1 << 40))):
        if looks:
            monkeypatch.setattr(M, "LOOKS", looks)
        rows = odd_products(spark, n, seed).localCheckpoint()
        want = plain_alternatives(rows.collect(), k, per_winery)
        got = M.alternatives(rows, rows, k, per_winery).collect()
        assert len(want) > n and sorted((r.base_id, r.rank, r.product_id, round(r.likeness, 6)) for r in got) == want
    assert compared and all("array()" in x for x in compared)  # traits without grapes


def test_roles(spark):
    role = lambda rank, n: M.assign_role(F.lit(rank), F.lit(n), F.lit(50))
    assert list(spark.range(1).select(role(1, 100), role(2, 3), role(2, 100), role(2, 20)).first()) == ["best match", "rare", "classic", "other"]
    products = spark.createDataFrame([(i, ["a"] if i else ["a", "b"]) for i in range(5)] + [(9, [])], "product_id long, grapes array<string>")
    assert {r.product_id: r.common for r in M.with_common(products).collect()} == {**{i: 5 for i in range(5)}, 9: None}


def test_near_profiles_leave_none_out_that_is_nearer(spark, monkeypatch):
    """Chunks of a few profiles; whatever is nearer than ``least`` is there, so a class that finds enough above it needs no list of all that share a grape."""
    monkeypatch.setattr(M, "CHUNK", 9)
    traits = M._with_traits(plans.products(spark, SMALL)).select(F.struct(*[F.col(f"traits.{t}").alias(t) for t in M.TRAITS if t != "grapes"]).alias("rest")).distinct()
    rows = traits.select(F.monotonically_increasing_id().alias("profile"), "rest", F.lit(2).cast("long").alias("n"), F.lit(True).alias("asks")).localCheckpoint()
    side = lambda n: rows.select(F.col("profile").alias(n), F.col("rest").alias(f"r{n}"))
    both = side("a").crossJoin(side("b")).where("ra.category = rb.category and ra.sparkling = rb.sparkling and (ra.sweetness is null or rb.sweetness is null or abs(ra.sweetness - rb.sweetness) <= 1)")
    want = {(r.a, r.b): r.f for r in both.select("a", "b", M.likeness(M._without_grapes("ra"), M._without_grapes("rb")).alias("f")).collect()}
    for need, cut in ((6, True), (10**6, False)):
        got = M.near_profiles(rows, need).collect()
        least = {r.a: r.least for r in got}
        assert {r.a for r in got} == {a for a, _ in want} and any(x > 0 for x in least.values()) == cut
        pairs = {(r.a, r.b) for r in got}
        assert pairs <= set(want) and len(pairs) == len(got)
        assert all(p in pairs for p, f in want.items() if f > least[p[0]] + 1e-9)
