import pytest
from pyspark.sql import functions as F

from labelmatch.operators import ingest
from labelmatch.sources.versions import Change, Versions
from labelmatch.streaming import imports

PRODUCTS = "product_id long, slug string, title string, manufacturer string, description string, image_path string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_change_of_two_tables_appears_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    made = Versions(spark, str(tmp_path), {"a": "k", "b": "k"}, 8)
    frame = lambda data: spark.createDataFrame(data, "k long, v string")
    assert made.commit({"a": Change(frame([(i, "old") for i in range(50)])), "b": Change(frame([(1, "x"), (1, "y"), (2, "z")]), append=True)}) == 1
    before = made.manifest()
    change = {"a": Change(frame([(3, "new"), (70, "new")]), frame([(4, "")])), "b": Change(frame([(1, "w")]))}

    def breaks(manifest):
        raise OSError("the process ends here")

    with monkeypatch.context() as m:
        m.setattr(made, "_publish", breaks)
        with pytest.raises(OSError):
            made.commit(change)
    assert made.manifest() == before and made.read("a").count() == 50  # files were written, no version names them
    assert made.commit(change) == 2
    assert rows(made.read("a")) == sorted([(i, "old") for i in range(50) if i not in (3, 4)] + [(3, "new"), (70, "new")])
    assert rows(made.read("b")) == [(1, "w"), (2, "z")]
    assert rows(made.read("a", 1)) == [(i, "old") for i in range(50)]
    after = made.manifest()["tables"]["a"]["buckets"]
    same = [b for b in after if after[b] == before["tables"]["a"]["buckets"].get(b)]
    assert 8 - len(same) <= 3  # only the buckets of 3, 4 and 70 were written again
    other = Versions(spark, str(tmp_path), {"a": "k", "b": "k"}, 8)
    with pytest.raises(RuntimeError):
        other._publish(before | {"version": 2})
    with pytest.raises(ValueError):
        made.commit({"a": Change(frame([(None, "v")]))})
    assert made.vacuum() >= 1 and made.versions() == [2] and made.read("a").count() == 50
    assert made.commit({"a": Change(frame([]), frame([(i, "") for i in range(100)]))}) == 3 and made.read("a").count() == 0


@pytest.fixture()
def catalog(spark, tmp_path):
    held = Versions(spark, str(tmp_path / "catalog"), imports.KEYS, 4)
    old = spark.createDataFrame([(1, "s-1", "One", "M", "d", "1.jpg"), (2, None, "Two", "M", "d", "2.jpg"), (3, "s-3", "Three", "M", "d", "3.jpg")], PRODUCTS)
    whole = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (3, "A"), (3, "A")], "product_id long, model string")
    jobs = spark.createDataFrame([("old-1", "running", 0, 0, 0, None)], "job_id string, status string, total long, completed long, failed long, error string")
    held.commit({"products": Change(old), "vectors": Change(whole, append=True), "items": Change(spark.createDataFrame([], imports.ITEMS)), "jobs": Change(jobs)})
    return held


FEED = "row_number long, name string, producer string, description string, image string, Slug string"


def importing(spark, catalog):
    images = spark.createDataFrame([(f"{i}.jpg",) for i in (1, 2, 4)], "path string")
    vectors_of = lambda touched: touched.select("product_id", F.explode(F.array(F.lit("A"), F.lit("A"))).alias("model"))
    return imports.Import(catalog, "feed", images, ["A"], vectors_of, F.col("row_number") + 100, complete=2)


def test_a_batch_delivered_twice_changes_nothing(spark, catalog):
    feed = spark.createDataFrame([(1, "One", "M", "changed", "1.jpg", "s-1"), (2, "two", "m", "longer", "2.jpg", None), (4, "Four", "M", "d", "4.jpg", None), (5, "Five", "M", "d", "5.jpg", None), (6, None, "M", "d", "1.jpg", None)], FEED)
    job = importing(spark, catalog)
    job.step(feed, 0)
    after = catalog.manifest()
    job.step(feed, 0)
    assert catalog.manifest() == after
    got = {r.product_id: (r.title, r.description) for r in catalog.read("products").collect()}
    assert got == {1: ("One", "d"), 2: ("two", "longer"), 3: ("Three", "d"), 104: ("Four", "d")}  # 1 is whole and skipped, 2 repaired, 4 new
    assert {r.product_id: r.n for r in catalog.read("vectors").groupBy("product_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 2: 2, 3: 2, 104: 2}
    items = {r.row_number: (r.product_id, r.action, r.status) for r in catalog.read("items").collect()}
    assert items == {1: (1, "skip", "completed"), 2: (2, "repair", "completed"), 4: (104, "new", "completed"), 5: (None, "missing_image", "failed"), 6: (None, "invalid", "failed")}
    jobs = {r.job_id: (r.status, r.total, r.completed, r.failed) for r in catalog.read("jobs").collect()}
    assert jobs == {"old-1": ("running", 0, 0, 0), "feed-0": ("failed", 5, 3, 2)}
    assert [(r.row_number, r["rank"]) for r in imports.last_items(catalog.read("items"), 2).orderBy("rank").collect()] == [(6, 1), (5, 2)]
    imports.recover(catalog)
    assert {r.job_id: (r.status, r.error) for r in catalog.read("jobs").collect()}["old-1"] == ("failed", "interrupted")


def test_a_batch_that_breaks_off_leaves_the_catalog_and_can_be_repeated(spark, catalog, monkeypatch):
    feed = spark.createDataFrame([(4, "Four", "M", "d", "4.jpg", None)], FEED)
    job = importing(spark, catalog)
    publish, count = catalog._publish, iter(range(9))

    def breaks(manifest):
        if next(count) == 1:
            raise OSError("the process ends here")
        publish(manifest)

    with monkeypatch.context() as m:
        m.setattr(catalog, "_publish", breaks)
        with pytest.raises(OSError):
            job.step(feed, 0)
    assert catalog.read("products").count() == 3 and catalog.read("items").count() == 0
    assert {r.job_id: r.status for r in catalog.read("jobs").collect()}["feed-0"] == "running"
    job.step(feed, 0)
    assert catalog.read("products").count() == 4 and {r.job_id: r.status for r in catalog.read("jobs").collect()}["feed-0"] == "completed"


def test_files_that_arrive_are_imported_once(spark, catalog, tmp_path):
    from labelmatch.streaming import sessions

    for name, i in (("a", 4), ("b", 2)):
        spark.createDataFrame([(i, {4: "Four", 2: "Two"}[i], "M", "d", f"{i}.jpg", None)], FEED).coalesce(1).write.json(str(tmp_path / "feed" / name))
    stream = lambda: spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "feed" / "*"))
    job = importing(spark, catalog)
    for _ in range(2):
        sessions.incremental_import(stream(), job.step, str(tmp_path / "at")).awaitTermination(300)
    assert sorted(r.product_id for r in catalog.read("products").collect()) == [1, 2, 3, 104]
    assert sorted(r.row_number for r in catalog.read("items").collect()) == [2, 4] and catalog.read("jobs").where("status = 'completed'").count() == 2


def test_rows_without_slugs_are_groups_of_their_own(spark):
    feed = spark.createDataFrame([(i, None if i % 2 else "s", "M", "d", "1.jpg", None if i < 90 else f"x{i % 2}") for i in range(100)], FEED)
    checked = ingest.manifest_errors(ingest.coalesce_aliases(feed))
    assert {r.row_number for r in checked.where("array_contains(errors, 'slug is repeated')").collect()} == set(range(90, 100))
    assert "coalesce(slug" in checked._jdf.queryExecution().optimizedPlan().toString()
