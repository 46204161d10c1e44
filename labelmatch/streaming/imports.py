"""Imports of catalog feeds: a batch's checks, plan, products, vectors and items are one version of the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch import config as C
from labelmatch.operators import ingest
from labelmatch.sources.versions import Change, Versions

#: Tables of a catalog and their keys; errors of items and jobs are cut at so many characters.
KEYS = {"products": "product_id", "vectors": "product_id", "items": "job_id", "jobs": "job_id"}
ITEM_ERROR, JOB_ERROR = 2000, 4000
PRODUCT = ["product_id", "slug", "title", "manufacturer", "description", "image_path"]
ITEMS = "job_id string, row_number long, product_id long, action string, status string, error string"


def planned(feed: DataFrame, products: DataFrame, vectors: DataFrame, images: DataFrame, models: list[str], complete: int = C.COMPLETE, force: bool = False) -> DataFrame:
    """``feed`` read by its aliases, with ``errors``, the product each row stands for, and ``action`` (I1 to I6)."""
    rows = ingest.manifest_errors(ingest.coalesce_aliases(feed), images)
    there = images.select(F.col("path").alias("image_path"), F.lit(True).alias("has_image")).distinct()
    rows = rows.join(there, "image_path", "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))
    return ingest.plan_ingest(rows, products, ingest.vector_counts(vectors, models), models, complete, force)


def changes(plan: DataFrame, new_id: Column, vectors_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, Change]]:
    """The plan's rows that change the catalog, with their ids, and the changes: rows of products are inserted or updated, and their vectors replaced.

    ``vectors_of`` gives ``(product_id, ...)`` rows of vectors for these rows.
    """
    touched = plan.where("action in ('new', 'repair', 'force')").withColumn("product_id", F.coalesce("product_id", new_id))
    have = [c for c in PRODUCT if c in touched.columns]
    return touched, {"products": Change(touched.select(*have)), "vectors": Change(vectors_of(touched), touched.select("product_id"))}


def items_of(plan: DataFrame, touched: DataFrame, job_id: str) -> DataFrame:
    """``(job_id, row_number, product_id, action, status, error)``: a row failed if it is invalid or has no image, else it is completed."""
    bad = F.col("action").isin("invalid", "missing_image")
    error = F.when(bad, F.substring(F.coalesce(F.array_join("errors", "; "), F.col("action")), 1, ITEM_ERROR))
    ids = touched.select("row_number", F.col("product_id").alias("_id"))
    joined = plan.join(ids, "row_number", "left")
    return joined.select(F.lit(job_id).alias("job_id"), F.col("row_number").cast("long").alias("row_number"), F.coalesce("_id", "product_id").cast("long").alias("product_id"), "action", F.when(bad, "failed").otherwise("completed").alias("status"), error.alias("error"))


def last_items(items: DataFrame, n: int) -> DataFrame:
    """The last ``n`` items of each job by their row numbers, the latest first, ties by status."""
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("row_number"), "status")))
    return ranked.where(F.col("rank") <= n)


def recover(catalog: Versions) -> int:
    """Jobs that were running when their process ended become failed; the last version's number."""
    jobs = catalog.read("jobs")
    lost = jobs.where("status = 'running'").withColumns({"status": F.lit("failed"), "error": F.lit("interrupted")})
    return catalog.manifest()["version"] if lost.isEmpty() else catalog.commit({"jobs": Change(lost)})


class Import:
    """One stream of feeds into a versioned catalog.

    ``step`` is for ``foreachBatch``. A batch first marks its job as running, then commits products, vectors, items and the
    finished job together, under the stream's name and the batch's number: a batch that is delivered twice changes
    nothing the second time, and one that breaks off leaves the catalog as it was, and a running job for ``recover``.
    """

    def __init__(self, catalog: Versions, name: str, images: DataFrame, models: list[str], vectors_of: Callable[[DataFrame], DataFrame], new_id: Column, complete: int = C.COMPLETE):
        self.catalog, self.name, self.images, self.models, self.vectors_of, self.new_id, self.complete = catalog, name, images, models, vectors_of, new_id, complete

    def _job(self, job_id: str, status: str, totals: DataFrame | None = None) -> Change:
        spark = self.catalog.spark
        if totals is None:
            return Change(spark.createDataFrame([(job_id, status, 0, 0, 0, None)], "job_id string, status string, total long, completed long, failed long, error string"))
        ledger = ingest.job_ledger(totals, JOB_ERROR).select("job_id", "status", "total", "completed", "failed", "error")
        empty = spark.createDataFrame([(job_id, "completed", 0, 0, 0, None)], ledger.schema)
        return Change(ledger.unionByName(empty.join(ledger, "job_id", "left_anti")))

    def step(self, feed: DataFrame, batch: int) -> None:
        """One micro-batch; its rows have a ``row_number``."""
        if self.catalog.manifest()["batches"].get(self.name, -1) >= batch:
            return
        job = f"{self.name}-{batch}"
        self.catalog.commit({"jobs": self._job(job, "running")})
        from labelmatch.functions.storage import written

        products, vectors = self.catalog.read("products"), self.catalog.read("vectors")
        plan = written(planned(feed, products, vectors, self.images, self.models, self.complete), "import-plan")
        touched, made = changes(plan, self.new_id, self.vectors_of)
        items = written(items_of(plan, touched, job), "import-items")
        self.catalog.commit(made | {"items": Change(items), "jobs": self._job(job, "", items)}, self.name, batch)
