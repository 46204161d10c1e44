"""Keyed permutations, numbers in groups, and batches made of them."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelmatch.operators import sampling


def place(x: int, n: int, *key) -> int:
    """The same permutation, one number at a time."""
    value = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    for r in range(sampling.ROUNDS):
        mirror = (value(*key, r) % n - x) % n
        if value(*key, r, max(x, mirror)) % 2:
            x = mirror
    return x


def test_places_are_a_permutation_of_any_size(spark):
    sizes = [1, 2, 3, 7, 16, 31, 100]
    rows = spark.createDataFrame([(n, x) for n in sizes for x in range(n)], "n long, x long").withColumn("y", sampling.permuted(F.col("x"), F.col("n"), F.lit("k"), F.col("n"))).collect()
    for n in sizes:
        got = {r.x: r.y for r in rows if r.n == n}
        assert sorted(got.values()) == list(range(n))
        assert got == {x: place(x, n, "k", n) for x in range(n)}
    assert spark.range(1).select(sampling.permuted(F.col("id"), F.lit(0), F.lit("k")).alias("y")).first().y is None


def test_first_places_are_even_over_many_keys(spark):
    n, keys = 12, 6000
    counts = spark.range(keys).select(sampling.permuted(F.lit(0), F.lit(n), F.col("id")).alias("a"), sampling.permuted(F.lit(1), F.lit(n), F.col("id")).alias("b")).groupBy("a", "b").count().collect()
    expected = keys / (n * (n - 1))
    assert len(counts) == n * (n - 1)  # all ordered pairs
    assert sum((r["count"] - expected) ** 2 / expected for r in counts) < 200  # 131 degrees of freedom; above 200 once in 10,000


def test_numbers_in_groups_of_any_size(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"g{i % 40}", i) for i in range(400)]
    got = sampling.numbered(spark.createDataFrame(rows, "g string, v long").repartition(7), ["g"], ["v"], "test-numbers").collect()
    expected = {}
    for g, v in sorted(rows):
        expected.setdefault(g, []).append(v)
    assert {(r.g, r.v, r.no) for r in got} == {(g, v, i) for g, vs in expected.items() for i, v in enumerate(vs)}


def test_batches_repeat_nothing_where_they_need_not(spark):
    sizes = {"hot": 500, "one": 1, "two": 2} | {f"g{i}": 20 for i in range(12)}
    rows = [(g, i, "x") for g, n in sizes.items() for i in range(n)] + [(None, 1, "x"), ("two", None, "x")]
    manifest = spark.createDataFrame(rows, "group_id string, image_id long, slot string")
    got = sampling.sampled_batches(manifest, 5, 8, 30).collect()
    assert len(got) == 30 * 5 * 8
    by_step = {}
    for r in got:
        by_step.setdefault(r.step, {}).setdefault(r.group_id, {})[r.slot] = r.image_id
    names = sorted(sizes)
    for step, groups in by_step.items():
        assert sorted(groups) == sorted(names[place(c, len(names), "batch", step)] for c in range(5))
        for g, slots in groups.items():
            assert slots == {k: place(k % sizes[g], sizes[g], "batch", step, g) for k in range(8)}
            assert max(Counter(slots.values()).values()) == -(-8 // min(8, sizes[g]))
    assert {g for groups in by_step.values() for g in groups} == set(sizes)  # every group comes up
    other = {(r.step, r.group_id, r.slot, r.image_id) for r in sampling.sampled_batches(manifest.repartition(5), 5, 8, 30).collect()}
    assert other == {(r.step, r.group_id, r.slot, r.image_id) for r in got}


def test_batches_of_few_groups_of_none_and_of_repeated_rows(spark):
    few = spark.createDataFrame([("a", 1), ("a", 1), ("b", 5)], "group_id string, image_id long")
    got = sampling.sampled_batches(few, 4, 3, 2).collect()
    assert Counter((r.step, r.group_id, r.image_id) for r in got) == {(s, g, i): 3 for s in (0, 1) for g, i in (("a", 1), ("b", 5))}
    assert sampling.sampled_batches(few.limit(0), 4, 3, 2).collect() == []
    with pytest.raises(ValueError):
        sampling.sampled_batches(few, 0, 3, 2)
