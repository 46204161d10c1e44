"""Catalog feeds: aliases, checks, plans, ledgers, and what belongs to their images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmatch import config as C

#: Names a field goes by, and the longest text it takes.
ALIASES = {"title": ["title", "name", "Название вина"], "manufacturer": ["manufacturer", "producer", "Винодельня"], "description": ["description", "Описание"], "image_path": ["image_path", "image", "filename", "Название фото"], "slug": ["slug", "Slug"]}
LENGTHS = {"title": 300, "manufacturer": 300, "description": 5000, "image_path": 500, "slug": 300}
REQUIRED = ["title", "manufacturer", "description", "image_path"]


def coalesce_aliases(feed: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``feed`` with each field from the first of its names that holds text, trimmed; null without any."""
    out = feed
    for field, names in (ALIASES if aliases is None else aliases).items():
        present = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in feed.columns]
        out = out.withColumn(field, F.coalesce(*present) if present else F.lit(None).cast("string"))
    return out


def unsafe_path(path: Column) -> Column:
    """Absolute, or with a part ``..``: it could leave its folder."""
    return F.coalesce(path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)"), F.lit(False))


def manifest_errors(rows: DataFrame, images: DataFrame | None = None, required: list[str] | None = None) -> DataFrame:
    """``rows(row_number, title, ...)`` with ``errors``, an array in fixed order; empty where a row is valid."""
    required = REQUIRED if required is None else required
    found = [F.when(F.col(c).isNull() | (F.trim(c) == ""), f"{c} is missing") for c in required]
    found += [F.when(F.length(c) > n, f"{c} is too long") for c, n in LENGTHS.items() if c in rows.columns]
    out = rows
    if "image_path" in rows.columns:
        found.append(F.when(unsafe_path(F.col("image_path")), "image is outside the batch"))
        if images is not None:
            out = out.join(images.select(F.col("path").alias("image_path"), F.lit(True).alias("_there")).distinct(), "image_path", "left")
            found.append(F.when(F.col("image_path").isNotNull() & F.col("_there").isNull(), "image is not in the batch"))
    if "slug" in rows.columns:
        own = F.coalesce("slug", F.concat(F.lit("\0"), F.col("row_number").cast("string")))  # rows without a slug are groups of their own
        found.append(F.when(F.col("slug").isNotNull() & (F.count("*").over(Window.partitionBy(own)) > 1), "slug is repeated"))
    return out.withColumn("errors", F.array_compact(F.array(*found))).drop("_there")


def first_error(checked: DataFrame) -> DataFrame:
    """The strict reading: one row for the first invalid row, none if all are valid."""
    return checked.where("size(errors) > 0").agg(F.min(F.struct("row_number", F.col("errors")[0].alias("error"))).alias("e")).where("e is not null").select("e.*")


def match_existing(feed: DataFrame, products: DataFrame) -> DataFrame:
    """``feed`` with ``product_id`` of the product it stands for: by slug if it has one, else by lower-case title and manufacturer."""
    known = products.select(F.col("product_id"), F.col("slug"), F.lower("title").alias("_t"), F.lower("manufacturer").alias("_m"))
    slugs = known.where("slug is not null").groupBy("slug").agg(F.min("product_id").alias("product_id"))
    names = known.groupBy("_t", "_m").agg(F.min("product_id").alias("product_id"))
    by_slug = feed.where("slug is not null").join(slugs, "slug", "left")
    by_name = feed.where("slug is null").withColumn("_t", F.lower("title")).withColumn("_m", F.lower("manufacturer")).join(names, ["_t", "_m"], "left").drop("_t", "_m")
    return by_slug.unionByName(by_name)


def vector_counts(vectors: DataFrame, models: list[str]) -> DataFrame:
    return vectors.groupBy("product_id").agg(*[F.count_if(F.col("model") == m).alias(f"n_{m}") for m in models])


def plan_ingest(feed: DataFrame, products: DataFrame, counts: DataFrame, models: list[str], complete: int = C.COMPLETE, force: bool = False) -> DataFrame:
    """``feed(row_number, title, manufacturer, slug, has_image, ...)`` with ``action``: invalid, missing_image, new, skip, repair or force.

    Of rows that stand for one product the first decides; later ones are skipped.
    """
    joined = match_existing(feed, products).join(counts, "product_id", "left")
    whole = F.lit(True)
    for m in models:
        whole = whole & (F.coalesce(f"n_{m}", F.lit(0)) == complete)
    invalid = F.col("title").isNull() | F.col("manufacturer").isNull()
    key = F.coalesce(F.col("product_id").cast("string"), F.concat(F.lit("s:"), "slug"), F.concat(F.lit("n:"), F.lower("title"), F.lit("|"), F.lower("manufacturer")), F.concat(F.lit("\0"), F.col("row_number").cast("string")))
    usable = ~invalid & F.col("has_image")
    again = F.row_number().over(Window.partitionBy(key, usable).orderBy("row_number")) > 1
    action = F.when(invalid, "invalid").when(~F.col("has_image"), "missing_image").when(again, "skip").when(F.col("product_id").isNull(), "new").when(F.lit(force), "force").when(whole, "skip").otherwise("repair")
    return joined.withColumn("action", action)


def apply_ingest(old: DataFrame, plan: DataFrame, new: DataFrame) -> DataFrame:
    """The vectors after the plan: those of repaired products are replaced, those of new ones added. ``streaming.imports.changes`` does this, and the product rows, in one version of the catalog."""
    touched = plan.where("action in ('new', 'repair', 'force')").select("product_id").distinct()
    return old.join(touched, "product_id", "left_anti").unionByName(new.join(touched, "product_id", "left_semi"))


def insert_unique_slug(rows: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose slug is new, and those it would repeat."""
    taken = products.select("slug").where("slug is not null").distinct()
    return rows.join(taken, "slug", "left_anti"), rows.join(taken, "slug", "left_semi")


def job_ledger(items: DataFrame, error_chars: int = 4000) -> DataFrame:
    """``items(job_id, row_number, status, error)`` -> totals and a status for each job; pending items of a job at rest make it failed."""
    n = lambda s: F.count_if(F.col("status") == s)
    job = items.groupBy("job_id").agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), n("pending").alias("pending"), F.min(F.when(F.col("error").isNotNull(), F.struct("row_number", "error"))).alias("e"))
    status = F.when((F.col("failed") > 0) | (F.col("pending") > 0), "failed").otherwise("completed")
    return job.select("job_id", "total", "completed", "failed", "pending", status.alias("status"), F.substring("e.error", 1, error_chars).alias("error"))


def missing_images(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with title and manufacturer none of whose candidate files is there: the photo's name, or the slug with any extension."""
    named = rows.where("title is not null and manufacturer is not null")
    stem = lambda c: F.regexp_replace(F.lower(c), r"\.[^.]*$", "")
    photo = named.select("row_number", F.lower("image_path").alias("key")).where("key is not null")
    slug = named.select("row_number", F.concat(F.lit("*"), F.lower("slug")).alias("key")).where("key is not null")
    there = files.select(F.lower("path").alias("key")).unionByName(files.select(F.concat(F.lit("*"), stem(F.col("path"))).alias("key"))).distinct()
    has = photo.unionByName(slug).join(there, "key", "left_semi").select("row_number").distinct()
    return named.join(has, "row_number", "left_anti")


def image_targets(rows: DataFrame, url: str = "url", size: int = 1600) -> DataFrame:
    """``target_url`` with a resize part set to ``size``, and the file's name: that of the photo, else the last part of the address."""
    resized = F.regexp_replace(F.col(url), r"/(\d+)/(\d+)/", f"/{size}/{size}/")
    name = F.regexp_extract(F.regexp_replace(F.col(url), r"[?#].*$", ""), r"([^/]+)/?$", 1)
    return rows.withColumn("target_url", resized).withColumn("file_name", F.when(name != "", name).otherwise("index"))


def augmentation_plan(products: DataFrame, names: int = C.VARIANT_NAMES, variants: int = C.VARIANTS_PER_NAME, seed: int = 42) -> DataFrame:
    """The catalog row and ``names * variants`` seeded rows of each product; a seed depends on product, name and number only."""
    number = F.explode(F.sequence(F.lit(0), F.lit(names * variants))).alias("i")
    rows = products.select("product_id", number)
    name = F.when(F.col("i") == 0, "catalog").otherwise(F.concat(F.lit("aug"), F.lpad(F.floor((F.col("i") - 1) / variants).cast("string"), 2, "0")))
    value = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "product_id", name, "i")), 1, 8), 16, 10).cast("long"), F.lit(2**31 - 1))
    return rows.select("product_id", name.alias("aug_name"), F.when(F.col("i") == 0, F.lit(0)).otherwise(value).cast("long").alias("aug_seed"))


def balanced_batches(manifest: DataFrame, classes: int, per_class: int, steps: int, seed: str = "batch") -> DataFrame:
    """``(step, group_id, image_id)``: in each step ``classes`` groups without repetition, ``per_class`` images of each, repeated only where a group has too few."""
    groups = manifest.select("group_id").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    key = lambda *c: F.md5(F.concat_ws(":", F.lit(seed), *c))
    drawn = groups.withColumn("o", F.row_number().over(Window.partitionBy("step").orderBy(key("step", "group_id"), "group_id"))).where(F.col("o") <= classes).select("step", "group_id")
    inside = Window.partitionBy("step", "group_id")
    images = drawn.join(manifest, "group_id").withColumn("i", F.row_number().over(inside.orderBy(key("step", "image_id"), "image_id")) - 1).withColumn("n", F.count("*").over(inside))
    picks = F.filter(F.sequence(F.lit(0), F.lit(per_class - 1)), lambda k: F.pmod(k, F.col("n")) == F.col("i"))
    return images.withColumn("slot", F.explode(picks)).select("step", "group_id", "image_id", "slot")


def best_box(boxes: DataFrame, reach: float = 0.15) -> DataFrame:
    """``boxes(image_id, box_id, width, height, x1, y1, x2, y2, conf)`` -> the label of each image.

    Boxes over the vertical centre line: the one nearest to the middle in height, then the surest; otherwise the
    one whose edge is nearest to the line, and none if that is farther than ``reach`` of the width.
    """
    mid_x, mid_y = F.col("width") / 2, F.col("height") / 2
    over = (F.col("x1") <= mid_x) & (mid_x <= F.col("x2"))
    gap_x = F.when(over, 0.0).otherwise(F.least(F.abs(F.col("x1") - mid_x), F.abs(F.col("x2") - mid_x)))
    gap_y = F.when((F.col("y1") <= mid_y) & (mid_y <= F.col("y2")), 0.0).otherwise(F.least(F.abs(F.col("y1") - mid_y), F.abs(F.col("y2") - mid_y)))
    keyed = boxes.withColumn("gap_x", gap_x).withColumn("gap_y", F.when(over, gap_y).otherwise(0.0))
    first = keyed.withColumn("o", F.row_number().over(Window.partitionBy("image_id").orderBy("gap_x", "gap_y", F.desc("conf"), "box_id"))).where("o = 1")
    return first.where(F.col("gap_x") <= reach * F.col("width")).drop("o", "gap_x", "gap_y")


def clamp_crop(boxes: DataFrame) -> DataFrame:
    """Boxes inside their frame; one without area becomes the whole frame."""
    x1, x2 = (F.greatest(F.lit(0), F.least(F.col("width"), F.col(c).cast("int"))) for c in ("x1", "x2"))
    y1, y2 = (F.greatest(F.lit(0), F.least(F.col("height"), F.col(c).cast("int"))) for c in ("y1", "y2"))
    flat = (x2 <= x1) | (y2 <= y1)
    pick = lambda whole, part: F.when(flat, whole).otherwise(part)
    return boxes.withColumns({"cx1": pick(F.lit(0), x1), "cy1": pick(F.lit(0), y1), "cx2": pick(F.col("width"), x2), "cy2": pick(F.col("height"), y2)})


def best_polygon(polygons: DataFrame) -> DataFrame:
    """``polygons(image_id, polygon_id, points array<struct<x,y>>)`` -> the largest of four points or more, by the shoelace formula."""
    nxt = F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1))
    area = F.abs(F.aggregate(F.zip_with("points", nxt, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double")), F.lit(0.0), lambda s, v: s + v)) / 2
    rows = polygons.where("size(points) >= 4").withColumn("area", area)
    return rows.groupBy("image_id").agg(F.min(F.struct((-F.col("area")).alias("key"), "polygon_id", "area")).alias("p")).select("image_id", "p.polygon_id", "p.area")


def crop_audit(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row: images without a box, and with a box beside the centre."""
    chosen = images.select("image_id").distinct().join(best_box(boxes), "image_id", "left")
    off = ~((F.col("x1") <= F.col("width") / 2) & (F.col("width") / 2 <= F.col("x2")))
    return chosen.agg(F.count("*").alias("images"), F.count_if(F.col("box_id").isNull()).alias("no_box"), F.count_if(F.coalesce(off, F.lit(False))).alias("off_centre"))


def rectification_summary(rows: DataFrame) -> DataFrame:
    """``rows(image_id, error, fallback)``: how many went well, failed, or fell back."""
    return rows.agg(F.count_if(F.col("error").isNull() & ~F.col("fallback")).alias("ok"), F.count("error").alias("errors"), F.count_if(F.col("error").isNull() & F.col("fallback")).alias("fallbacks"))
