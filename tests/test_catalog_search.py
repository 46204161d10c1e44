"""Catalog search: each task passes on the first rows of a term only."""

from pyspark.sql import functions as F

from labelmatch.functions import storage
from labelmatch.operators import catalog


def test_a_term_that_all_products_hold_leaves_few_rows_a_task(spark):
    made = len(storage._MADE)
    products = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("product_id"), F.when(F.col("id") % 5000 != 3, F.concat(F.lit("Item "), F.col("id") % 7)).alias("title"), F.lit("maker").alias("maker"))
    terms = spark.createDataFrame([("MAKER",), ("%",), ("item 3",), ("nothing",)], "term string")
    got = catalog.search_catalog(products, terms, ["title", "maker"], 4, 2).orderBy("term", "rank").collect()
    path = next(p for p, _ in storage._MADE[made:] if "/search-found-" in p)
    assert spark.read.parquet(path).count() <= 4 * 3 * 6  # tasks, terms, rows of both pages
    want = {r.product_id: r.title for r in products.collect()}
    first = sorted(want, key=lambda i: (want[i] is not None, want[i] or "", i))
    threes = [i for i in first if want[i] == "Item 3"]
    assert [(r.term, r.rank, r.product_id, r.total) for r in got] == [
        (term, i + 1, ids[i], len(ids)) for term, ids in (("%", first), ("MAKER", first), ("item 3", threes)) for i in range(2, 6)
    ]


def test_more_terms_than_a_task_holds_rows_lose_nothing(spark):
    products = spark.range(0, 40_000, 1, 2).select(F.col("id").alias("product_id"), F.concat(F.lit("part "), F.lpad((F.col("id") % 20_000).cast("string"), 5, "0")).alias("title"))
    terms = products.select(F.substring("title", 6, 5).alias("term"))
    got = catalog.search_catalog(products, terms, ["title"], 5)
    assert got.agg(F.count("*"), F.countDistinct("term"), F.min("total"), F.max("total")).first() == (40_000, 20_000, 2, 2)
