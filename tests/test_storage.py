from pathlib import Path

from labelmatch.functions import storage


def test_written_tables_are_released(spark):
    held = storage.written(spark.range(10), "kept")
    named = storage.bucketed(spark.range(10), "kept_in_buckets", "id", 2)
    assert held.count() == named.count() == 10
    paths = [Path(p.removeprefix("file:")) for p, _ in storage._MADE[-2:]]
    assert all(p.exists() for p in paths)
    storage.release(spark)
    assert not any(p.exists() for p in paths) and not [t for t in spark.catalog.listTables() if t.name.startswith("kept_in_buckets")]


def test_few_parts_are_spread(spark):
    few = storage.spread(spark.range(100, numPartitions=1))
    many = storage.spread(spark.range(100, numPartitions=50))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 50
    assert sorted(r.id for r in few.collect()) == list(range(100))
