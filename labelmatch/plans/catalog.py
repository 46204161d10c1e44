"""Catalog pages, ingestion, images, feedback and sessions over the star schema, ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmatch.functions.storage import folder, spread, table, written
from labelmatch.operators import catalog, evaluate, ingest, names, sampling
from labelmatch.sources import files
from labelmatch.sources.versions import Change, Versions
from labelmatch.streaming import imports, sessions, wishes

MODELS, COMPLETE = ["A", "N"], 8


def products(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the parts are in the catalog; half of these have a slug."""
    p = table(spark, d, "part")
    slug = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.translate("p_name", " ", "-"), F.lit("-"), F.col("p_partkey")))
    return p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("product_id"), F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_partkey")).alias("title"), F.col("p_brand").alias("manufacturer"), slug.alias("slug"))


def feed(spark: SparkSession, d: str) -> DataFrame:
    """All parts, with some fields missing, paths that leave the folder, repeated slugs and repeated rows."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    raw = p.select(
        k.alias("row_number"),
        F.when(k % 37 != 5, F.concat(F.lit(" "), F.col("p_name"), F.lit(" "), k)).alias("name"),
        F.when(k % 41 != 7, F.col("p_brand")).alias("producer"),
        F.col("p_type").alias("description"),
        F.when(k % 29 == 3, F.concat(F.lit("../"), k, F.lit(".jpg"))).when(k % 31 == 4, F.lit(" ")).otherwise(F.concat(k, F.lit(".jpg"))).alias("image"),
        F.when(k % 2 == 0, F.concat(F.translate("p_name", " ", "-"), F.lit("-"), F.when(k % 50 == 0, 0).otherwise(k))).alias("Slug"),
    )
    return ingest.coalesce_aliases(raw)


def images(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size % 3 <> 0").select(F.concat(F.col("p_partkey"), F.lit(".jpg")).alias("path"))


def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("title"))
    return catalog.list_page(o, 20, 40)


def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("term"))
    p = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("manufacturer"))
    return catalog.search_catalog(p, terms, ["title", "manufacturer"], 20).select("term", "rank", "product_id", "total")


def catalog_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "lineitem").where("l_quantity >= 49").select((F.col("l_partkey") * 2).cast("string").alias("slug"))
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("slug"), F.concat(F.col("p_partkey"), F.lit(".jpg")).alias("image_path"))
    return catalog.with_media_urls(catalog.by_slugs(p, asked), ["image_path"])


def catalog_search_page(spark: SparkSession, d: str) -> DataFrame:
    """Terms of every kind: short ones, wildcards, empty ones, backslashes, and names of parts; the second page of each."""
    n = F.col("n_nationkey")
    odd = F.element_at(F.array(*map(F.lit, ["", "%", "_", "r_n", "B%#1_", "\\\\a", "ING", "e", "zz%", "d w"])), (n % 10 + 1).cast("int"))
    terms = table(spark, d, "nation").select(F.when(n < 10, odd).otherwise(F.substring("n_name", 1, 2)).alias("term")).unionByName(table(spark, d, "part").where("p_partkey % 50 = 7").select(F.substring("p_name", 3, 6).alias("term")))
    p = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("manufacturer"), F.concat("p_type", F.lit("\\a"), "p_size").alias("slug"))
    return catalog.search_catalog(p, terms, ["title", "manufacturer", "slug"], 10, 5).select("term", "rank", "product_id", "total")


def part_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"))


def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("a "), F.element_at(F.array(*map(F.lit, ["small ring", "red widgit", "old gear", "blue", "large bolt set"])), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("text"))
    out = names.name_lookup(texts, part_names(spark, d), "n_nationkey", "text")
    return out.select("n_nationkey", "product_id", F.round("similarity", 6).alias("similarity"))


def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every part asked for by its name without a letter, with its words turned, with a sign in it, or within a sentence."""
    k, name = F.col("p_partkey"), F.col("p_name")
    less = F.concat(F.substring(name, F.lit(1), (k % 7).cast("int")), F.substring(name, (k % 7 + 2).cast("int"), F.lit(99)))
    turned = F.concat_ws(" ", F.reverse(F.split(name, " ")))
    said = F.when(k % 4 == 0, less).when(k % 4 == 1, turned).when(k % 4 == 2, F.concat(F.upper(name), F.lit("!?"), k % 10)).otherwise(F.concat(F.lit("is the "), name, F.lit(" a good one?")))
    out = names.name_lookup(table(spark, d, "part").select(k, said.alias("said")), part_names(spark, d), "p_partkey", "said")
    return out.select("p_partkey", "product_id", F.round("similarity", 6).alias("similarity"), "inside")


def names_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """The longest of some documents' openings inside each whole document."""
    docs = table(spark, d, "documents")
    titles = docs.where("doc_id % 25 = 0").select(F.col("doc_id").alias("product_id"), F.substring("text", 1, 16).alias("title"))
    out = names.name_lookup(docs, titles, "doc_id", "text")
    return out.where("inside").select("doc_id", "product_id")


def manifest_errors(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.manifest_errors(feed(spark, d), images(spark, d))
    return out.select("row_number", F.array_join("errors", "; ").alias("errors"))


def manifest_first_error(spark: SparkSession, d: str) -> DataFrame:
    return ingest.first_error(ingest.manifest_errors(feed(spark, d), images(spark, d)))


def counts(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("model"))
    return ingest.vector_counts(vectors, MODELS)


def vector_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d)


def ingest_plan(spark: SparkSession, d: str) -> DataFrame:
    there = images(spark, d).select(F.col("path").alias("image_path"), F.lit(True).alias("has_image"))
    rows = feed(spark, d).join(there, "image_path", "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))
    out = ingest.plan_ingest(rows, products(spark, d), counts(spark, d), MODELS, COMPLETE)
    return out.select("row_number", "product_id", "action")


def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return ingest_plan(spark, d).groupBy("action").agg(F.count("*").alias("n"))


def apply_ingest(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors a product has after its old ones are replaced."""
    li = table(spark, d, "lineitem")
    old = li.where("l_linestatus = 'O'").select(F.col("l_partkey").alias("product_id"), "l_orderkey", "l_linenumber")
    new = li.where("l_linestatus = 'F'").select(F.col("l_partkey").alias("product_id"), "l_orderkey", "l_linenumber")
    out = ingest.apply_ingest(old, ingest_plan(spark, d).where("product_id is not null"), new)
    return out.groupBy("product_id").agg(F.count("*").alias("n"))


def imported(spark: SparkSession, d: str) -> Versions:
    """A catalog of products and their vectors, and the feed applied to it as a second version."""
    li = table(spark, d, "lineitem")
    vectors = lambda flag: li.where(f"l_linestatus = '{flag}'").select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("model"), "l_orderkey", "l_linenumber")
    catalog = Versions(spark, folder(spark, "catalog"), imports.KEYS, 16)
    old = products(spark, d).select("product_id", "slug", "title", "manufacturer", F.lit("as it was").alias("description"), F.lit(None).cast("string").alias("image_path"))
    catalog.commit({"products": Change(old), "vectors": Change(vectors("O"), append=True)})
    plan = written(imports.planned(feed(spark, d), catalog.read("products"), li.select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("model")), images(spark, d), MODELS, COMPLETE), "import-plan")
    _, made = imports.changes(plan, F.col("row_number"), lambda rows: vectors("F").join(rows.select("product_id"), "product_id", "left_semi"))
    catalog.commit(made)
    return catalog


def import_products(spark: SparkSession, d: str) -> DataFrame:
    """The product rows after an import: updated, inserted, or as they were."""
    return imported(spark, d).read("products")


def import_vectors(spark: SparkSession, d: str) -> DataFrame:
    """How many vectors each product has after the same import."""
    return imported(spark, d).read("vectors").groupBy("product_id").agg(F.count("*").alias("n"))


def job_items(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    items = li.select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("row_number"), F.col("l_returnflag").alias("status"))
    return imports.last_items(items, 2).select("job_id", "rank", "row_number", "status")


def job_ledger(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "failed").when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45), "pending").otherwise("completed")
    items = li.select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).alias("row_number"), status.alias("status"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("no image for "), F.lpad(F.col("l_partkey").cast("string"), 8, "0"))).alias("error"))
    return ingest.job_ledger(items)


def missing_images(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    there = p.where("p_size % 3 = 1").select(F.concat(F.col("p_partkey"), F.lit(".jpg")).alias("path")).unionByName(p.where("p_size % 4 = 2").select(F.concat(F.translate("p_name", " ", "-"), F.lit("-"), F.col("p_partkey"), F.lit(".webp")).alias("path")))
    return ingest.missing_images(feed(spark, d), there).select("row_number", "title")


def url_targets(spark: SparkSession, d: str) -> DataFrame:
    return ingest.image_targets(table(spark, d, "pages").select("page_id", "url")).select("page_id", "target_url", "file_name")


def augmentation_plan(spark: SparkSession, d: str) -> DataFrame:
    return ingest.augmentation_plan(spread(table(spark, d, "part")).select(F.col("p_partkey").alias("product_id")))


def balanced_batches(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("image_id"))
    return ingest.balanced_batches(m, 8, 120, 20)


def sampled_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches over the lines of an order book, suppliers as groups."""
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("group_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id"))
    return sampling.sampled_batches(m, 8, 64, 40)


def boxes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    x, y = F.floor(F.col("l_quantity") * 17 % 700), F.floor(F.col("l_extendedprice") % 500)
    return li.select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("box_id"), F.lit(800).alias("width"), F.lit(600).alias("height"), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 90).alias("y2"), F.col("l_discount").alias("conf"))


def best_box(spark: SparkSession, d: str) -> DataFrame:
    return ingest.clamp_crop(ingest.best_box(boxes(spark, d))).select("image_id", "box_id", "cx1", "cy1", "cx2", "cy2")


def crop_audit(spark: SparkSession, d: str) -> DataFrame:
    return ingest.crop_audit(table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id")), boxes(spark, d))


def best_polygon(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    square = F.array(point(q * 0, q * 0), point(q, q * 0), point(q, q + k), point(q * 0, q))
    points = F.when(F.col("l_tax") > 0.06, F.slice(square, 1, 3)).otherwise(square)
    rows = li.select(F.col("l_orderkey").alias("image_id"), (k * 1_000_000 + F.col("l_partkey")).alias("polygon_id"), points.alias("points"))
    return ingest.best_polygon(rows).select("image_id", "polygon_id", F.round("area", 4).alias("area"))


def rectification_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return ingest.rectification_summary(e.select("event_id", F.when(F.col("event_type") == "error", "x").alias("error"), (F.col("value") > 100).alias("fallback")))


def insert_unique_slug(spark: SparkSession, d: str) -> DataFrame:
    fresh, taken = ingest.insert_unique_slug(feed(spark, d).where("slug is not null").select("row_number", "slug"), products(spark, d))
    return fresh.withColumn("accepted", F.lit(True)).unionByName(taken.withColumn("accepted", F.lit(False)))


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.round("value", 2).alias("ms"))
    p95 = evaluate.at_index(e, ["event_type"], "ms", evaluate.p95_index(), "p95")
    mid = evaluate.at_index(e, ["event_type"], "ms", evaluate.upper_median_index(), "median")
    return p95.join(mid, "event_type").join(e.groupBy("event_type").agg(F.max("ms").alias("most"), F.count("*").alias("n")), "event_type")


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "found").when(F.col("event_type") == "click", "probable").when(F.col("event_type") == "view", "not_in_catalog")
    return evaluate.batch_summary(e.select(status.alias("status"), F.when(F.col("event_type") == "error", "x").alias("error"), "value", F.round("value", 2).alias("latency_ms")))


def pooled_totals(spark: SparkSession, d: str) -> DataFrame:
    packs = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("correct"), F.count("*").alias("total"), F.avg("value").alias("avg_ms"))
    return evaluate.pooled_totals(packs)


def evaluate_pack(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    lines = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("line"), F.col("event_type").alias("predicted"))
    want = e.where("event_type <> 'signup'").groupBy("user_id").agg(F.min("event_type").alias("expected")).withColumnRenamed("user_id", "query_id")
    return evaluate.evaluate_pack(lines, want)


def demote_unknown(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderstatus") == "P", "skip").otherwise("in").alias("kind"), F.array((F.col("o_custkey") % 40).cast("string"), (F.col("o_orderkey") % 60).cast("string")).alias("accepted"))
    known = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("slug"))
    return evaluate.demote_unknown(labels, known).select("query_id", "kind", F.array_join("accepted", ",").alias("accepted"))


def dense_index(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    ids = li.select(F.col("l_partkey").alias("product_id"))
    vectors = li.select(F.col("l_partkey").alias("product_id"), "l_orderkey")
    out = files.export_feature_matrices(ids, vectors)
    return out.groupBy("product_id", "index").agg(F.count("*").alias("n"))


def augmentation_manifest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    path = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("d/"), F.col("p_partkey"), F.lit("/catalog.webp"))).when(F.col("p_partkey") % 10 == 1, F.lit("d/odd-name.png")).otherwise(F.concat(F.lit("d/"), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_size"), F.lit(".webp")))
    return files.augmentation_manifest(p.select("p_partkey", path.alias("path"))).select("p_partkey", "aug_name", "aug_seed")


def feedback_exclusions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 50).alias("wine"), (F.col("event_type") != "error").alias("liked"))
    return sessions.feedback_exclusions(e).select("session", F.array_join(F.col("excluded").cast("array<string>"), ",").alias("excluded"))


def wish_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the users of ``events``: kinds of events as wishes, errors as resets; the events are days apart, so five days end a session."""
    kind = F.when(F.col("event_type") == "error", wishes.RESET).when(F.col("event_type") != "view", F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("wish"), F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 50).cast("string")).alias("value"))
    stated = F.array_join(F.transform("wishes", lambda w: F.concat_ws("=", w["wish"], w["value"])), ",")
    return wishes.wish_sessions(e, 5 * 86400).select("session_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "turns", stated.alias("wishes"))


def session_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user by gaps in time, and what each holds."""
    e = sessions.session_numbers(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts")
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


_FEED = """feed AS (SELECT p_partkey AS row_number, CASE WHEN p_partkey % 37 <> 5 THEN p_name || ' ' || p_partkey END AS title, CASE WHEN p_partkey % 41 <> 7 THEN p_brand END AS manufacturer, p_type AS description,
    CASE WHEN p_partkey % 29 = 3 THEN '../' || p_partkey || '.jpg' WHEN p_partkey % 31 = 4 THEN NULL ELSE p_partkey || '.jpg' END AS image_path, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') || '-' || CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE p_partkey END END AS slug FROM part),
  images AS (SELECT p_partkey || '.jpg' AS path FROM part WHERE p_size % 3 <> 0),
  prods AS (SELECT p_partkey AS product_id, lower(p_name || ' ' || p_partkey) AS t, lower(p_brand) AS m, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') || '-' || p_partkey END AS slug FROM part WHERE p_partkey % 3 <> 0)"""
_ERRORS = f"""{_FEED}, errs AS (SELECT row_number, list_filter([CASE WHEN title IS NULL THEN 'title is missing' END, CASE WHEN manufacturer IS NULL THEN 'manufacturer is missing' END, CASE WHEN description IS NULL THEN 'description is missing' END,
    CASE WHEN image_path IS NULL THEN 'image_path is missing' END, CASE WHEN image_path LIKE '../%' THEN 'image is outside the batch' END, CASE WHEN image_path IS NOT NULL AND path IS NULL THEN 'image is not in the batch' END,
    CASE WHEN slug IS NOT NULL AND count(*) OVER (PARTITION BY slug) > 1 THEN 'slug is repeated' END], lambda x: x IS NOT NULL) AS e FROM feed LEFT JOIN images ON path = image_path)"""
_PLAN = f"""{_FEED}, cnt AS (SELECT l_partkey AS product_id, count(*) FILTER (l_returnflag = 'A') AS n_A, count(*) FILTER (l_returnflag = 'N') AS n_N FROM lineitem GROUP BY ALL),
  bs AS (SELECT f.*, (SELECT min(product_id) FROM prods p WHERE p.slug = f.slug) AS a, (SELECT min(product_id) FROM prods p WHERE p.t = lower(f.title) AND p.m = lower(f.manufacturer)) AS b, image_path IN (SELECT path FROM images) AS img FROM feed f),
  mt AS (SELECT row_number, CASE WHEN slug IS NOT NULL THEN a ELSE b END AS product_id, slug, title, manufacturer, coalesce(img, false) AS has_image, title IS NULL OR manufacturer IS NULL AS invalid FROM bs),
  ky AS (SELECT *, coalesce(product_id::VARCHAR, 's:' || slug, 'n:' || lower(title) || '|' || lower(manufacturer)) AS k, NOT invalid AND has_image AS usable FROM mt),
  ag AS (SELECT *, row_number() OVER (PARTITION BY k, usable ORDER BY row_number) > 1 AS again FROM ky),
  plan AS (SELECT ag.row_number, ag.product_id, CASE WHEN invalid THEN 'invalid' WHEN NOT has_image THEN 'missing_image' WHEN again THEN 'skip' WHEN ag.product_id IS NULL THEN 'new' WHEN coalesce(n_A, 0) = {COMPLETE} AND coalesce(n_N, 0) = {COMPLETE} THEN 'skip' ELSE 'repair' END AS action
    FROM ag LEFT JOIN cnt USING (product_id))"""


def _permuted(x: str, n: str, key: str) -> str:
    """``x`` among 0..n-1 after the rounds of a keyed permutation, in SQL."""
    keyed = lambda *parts: f"('0x' || substr(md5(concat_ws(':', {', '.join((key, *parts))})), 1, 15))::BIGINT"
    mirror = f"(({keyed('r')} % {n} - x + {n}) % {n})"
    return f"list_reduce(range({sampling.ROUNDS}), lambda x, r: CASE WHEN {keyed('r', f'greatest(x, {mirror})')} % 2 = 1 THEN {mirror} ELSE x END, {x}::BIGINT)"


_BOXES = """bx AS (SELECT l_orderkey AS image_id, l_linenumber * 1000000 + l_partkey AS box_id, floor((l_quantity * 17) % 700)::BIGINT AS x1, floor(l_extendedprice % 500)::BIGINT AS y1, l_discount AS conf FROM lineitem),
  gp AS (SELECT *, x1 + 60 AS x2, y1 + 90 AS y2, CASE WHEN x1 <= 400 AND 400 <= x1 + 60 THEN 0.0 ELSE least(abs(x1 - 400), abs(x1 + 60 - 400)) END AS gx, CASE WHEN y1 <= 300 AND 300 <= y1 + 90 THEN 0.0 ELSE least(abs(y1 - 300), abs(y1 + 90 - 300)) END AS gy FROM bx),
  bb AS (SELECT * FROM gp QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY gx, CASE WHEN gx = 0 THEN gy ELSE 0 END, conf DESC, box_id) = 1), best AS (SELECT * FROM bb WHERE gx <= 0.15 * 800)"""

#: The longest name inside, else the largest ratio by matching blocks: the longest common piece, first in the name, then in the text, and what lies left and right of it anew.
_BEST_NAME = """t AS (SELECT k, lower(said) AS t, regexp_replace(lower(said), '[^\\w\\s]', '', 'g') AS w FROM ({texts})), n AS (SELECT min(p_partkey) AS product_id, lower(p_name) AS name FROM part GROUP BY ALL),
  i AS (SELECT k, product_id, 1.0::DOUBLE AS similarity, true AS inside FROM t JOIN n ON length(name) > 5 AND contains(t, name) QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(name) DESC, product_id) = 1),
  pairs AS (SELECT DISTINCT w, name FROM t JOIN n ON 2.0 * least(length(w), length(name)) / greatest(1, length(w) + length(name)) >= 0.6 WHERE k NOT IN (SELECT k FROM i)),
  blocks AS (SELECT w, name, name AS x, w AS y, 0::BIGINT AS size FROM pairs UNION ALL
    SELECT w, name, unnest([substr(x, 1, b.i - 1), substr(x, b.i - b.k)]), unnest([substr(y, 1, b.j - 1), substr(y, b.j - b.k)]), unnest([-b.k, 0]) FROM (SELECT w, name, x, y, list_min(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(y) + 1), lambda j:
      {{'k': -len(list_filter(range(1, least(length(x) - i, length(y) - j) + 2), lambda k: substr(x, i, k) = substr(y, j, k))), 'i': i, 'j': j}})))) AS b FROM blocks WHERE length(x) > 0 AND length(y) > 0) WHERE b.k < 0),
  r AS (SELECT w, name, 2.0 * sum(size) / (length(w) + length(name)) AS s FROM blocks GROUP BY w, name),
  best AS (SELECT * FROM i UNION ALL SELECT k, product_id, s, false FROM t JOIN r USING (w) JOIN n USING (name) WHERE s >= 0.6 AND k NOT IN (SELECT k FROM i) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, name DESC) = 1)"""

SQL = {
    "catalog_page": "SELECT o_orderkey AS product_id, o_orderdate AS created_at, o_orderpriority AS title, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
    "catalog_search": "WITH m AS (SELECT n_nationkey::VARCHAR AS term, p_partkey AS product_id, p_name AS title FROM nation, part WHERE p_name ILIKE '%' || n_nationkey || '%' OR p_brand ILIKE '%' || n_nationkey || '%') SELECT term, row_number() OVER (PARTITION BY term ORDER BY title, product_id)::INT AS rank, product_id, count(*) OVER (PARTITION BY term) AS total FROM m QUALIFY rank <= 20",
    "catalog_lookup": "SELECT p_partkey::VARCHAR AS slug, p_partkey || '.jpg' AS image_path, '/api/media/' || p_partkey || '.jpg' AS image_path_url FROM part WHERE p_partkey IN (SELECT l_partkey * 2 FROM lineitem WHERE l_quantity >= 49)",
    "catalog_search_page": r"""WITH t AS (SELECT CASE WHEN n_nationkey < 10 THEN ['', '%', '_', 'r_n', 'B%#1_', '\\a', 'ING', 'e', 'zz%', 'd w'][n_nationkey % 10 + 1] ELSE substr(n_name, 1, 2) END AS term FROM nation UNION SELECT substr(p_name, 3, 6) FROM part WHERE p_partkey % 50 = 7),
  m AS (SELECT term, p_partkey AS product_id, p_name AS title FROM t, part WHERE p_name ILIKE '%' || term || '%' OR p_brand ILIKE '%' || term || '%' OR (p_type || '\a' || p_size) ILIKE '%' || term || '%')
  SELECT term, row_number() OVER (PARTITION BY term ORDER BY title, product_id)::INT AS rank, product_id, count(*) OVER (PARTITION BY term) AS total FROM m QUALIFY rank BETWEEN 6 AND 15""",
    "name_lookup": "WITH RECURSIVE " + _BEST_NAME.format(texts="SELECT n_nationkey AS k, 'a ' || ['small ring', 'red widgit', 'old gear', 'blue', 'large bolt set'][n_nationkey % 5 + 1] AS said FROM nation") + " SELECT k AS n_nationkey, product_id, round(similarity, 6) AS similarity FROM best",
    "name_matches": "WITH RECURSIVE " + _BEST_NAME.format(texts="""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, (p_partkey % 7)::INT) || substr(p_name, (p_partkey % 7 + 2)::INT) WHEN 1 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ')
    WHEN 2 THEN upper(p_name) || '!?' || p_partkey % 10 ELSE 'is the ' || p_name || ' a good one?' END AS said FROM part""") + " SELECT k AS p_partkey, product_id, round(similarity, 6) AS similarity, inside FROM best",
    "names_in_texts": """WITH n AS (SELECT min((doc_id, length(substr(text, 1, 16)))) AS m, lower(substr(text, 1, 16)) AS name FROM documents WHERE doc_id % 25 = 0 AND text IS NOT NULL GROUP BY ALL)
  SELECT doc_id, m[1] AS product_id FROM documents JOIN n ON length(name) > 5 AND contains(lower(text), name) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m[2] DESC, m[1]) = 1""",
    "manifest_errors": f"WITH {_ERRORS} SELECT row_number, array_to_string(e, '; ') AS errors FROM errs",
    "manifest_first_error": f"WITH {_ERRORS} SELECT row_number, e[1] AS error FROM errs WHERE len(e) > 0 ORDER BY row_number LIMIT 1",
    "vector_counts": "SELECT l_partkey AS product_id, count(*) FILTER (l_returnflag = 'A') AS n_A, count(*) FILTER (l_returnflag = 'N') AS n_N FROM lineitem GROUP BY ALL",
    "ingest_plan": f"WITH {_PLAN} SELECT * FROM plan",
    "ingest_summary": f"WITH {_PLAN} SELECT action, count(*) AS n FROM plan GROUP BY ALL",
    "apply_ingest": f"WITH {_PLAN}, tc AS (SELECT DISTINCT product_id FROM plan WHERE action IN ('new', 'repair', 'force') AND product_id IS NOT NULL) SELECT l_partkey AS product_id, count(*) AS n FROM lineitem WHERE (l_linestatus = 'O' AND l_partkey NOT IN (FROM tc)) OR (l_linestatus = 'F' AND l_partkey IN (FROM tc)) GROUP BY ALL",
    "import_products": f"""WITH {_PLAN}, tc AS (SELECT coalesce(p.product_id, p.row_number) AS product_id, f.slug, f.title, f.manufacturer, f.description, f.image_path FROM plan p JOIN feed f ON f.row_number = p.row_number WHERE action IN ('new', 'repair', 'force'))
  SELECT * FROM tc UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') || '-' || p_partkey END, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || p_partkey, p_brand, 'as it was', NULL
  FROM part WHERE p_partkey % 3 <> 0 AND p_partkey NOT IN (SELECT product_id FROM tc)""",
    "import_vectors": f"""WITH {_PLAN}, tc AS (SELECT coalesce(product_id, row_number) AS product_id FROM plan WHERE action IN ('new', 'repair', 'force'))
  SELECT l_partkey AS product_id, count(*) AS n FROM lineitem WHERE (l_linestatus = 'O' AND l_partkey NOT IN (FROM tc)) OR (l_linestatus = 'F' AND l_partkey IN (FROM tc)) GROUP BY ALL""",
    "job_items": "SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100 + l_quantity::INT DESC, l_returnflag)::INT AS rank, l_linenumber * 100 + l_quantity::INT AS row_number, l_returnflag AS status FROM lineitem QUALIFY rank <= 2",
    "job_ledger": """WITH i AS (SELECT l_orderkey AS job_id, l_linenumber * 100 + l_quantity::INT AS rn, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' AND l_quantity > 45 THEN 'pending' ELSE 'completed' END AS st, CASE WHEN l_returnflag = 'R' THEN 'no image for ' || lpad(l_partkey::VARCHAR, 8, '0') END AS er FROM lineitem)
  SELECT job_id, count(*) AS total, count(*) FILTER (st = 'completed') AS completed, count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (st = 'pending') AS pending, CASE WHEN bool_or(st IN ('failed', 'pending')) THEN 'failed' ELSE 'completed' END AS status, min((rn, er)) FILTER (er IS NOT NULL)[2] AS error FROM i GROUP BY ALL""",
    "missing_images": f"""WITH {_FEED} SELECT f.row_number, f.title FROM feed f JOIN part p ON p.p_partkey = f.row_number WHERE title IS NOT NULL AND manufacturer IS NOT NULL AND NOT coalesce(image_path IN (SELECT p_partkey || '.jpg' FROM part WHERE p_size % 3 = 1), false)
  AND NOT coalesce(slug IN (SELECT replace(p_name, ' ', '-') || '-' || p_partkey FROM part WHERE p_size % 4 = 2), false)""",
    "url_targets": r"WITH u AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/?$', 1) AS f FROM pages) SELECT page_id, regexp_replace(url, '/(\d+)/(\d+)/', '/1600/1600/', 'g') AS target_url, CASE WHEN f <> '' THEN f ELSE 'index' END AS file_name FROM u",
    "augmentation_plan": """WITH r AS (SELECT p_partkey AS product_id, unnest(range(116)) AS i FROM part), n AS (SELECT product_id, i, CASE WHEN i = 0 THEN 'catalog' ELSE 'aug' || lpad(((i - 1) // 5)::VARCHAR, 2, '0') END AS aug_name FROM r)
  SELECT product_id, aug_name, CASE WHEN i = 0 THEN 0 ELSE ('0x' || substr(md5('42:' || product_id || ':' || aug_name || ':' || i), 1, 8))::BIGINT % 2147483647 END AS aug_seed FROM n""",
    "balanced_batches": """WITH g AS (SELECT DISTINCT p_brand AS group_id FROM part), s AS (SELECT group_id, unnest(range(20))::INT AS step FROM g), d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY step ORDER BY md5('batch:' || step || ':' || group_id), group_id) <= 8),
  i AS (SELECT step, group_id, p_partkey AS image_id, row_number() OVER (PARTITION BY step, group_id ORDER BY md5('batch:' || step || ':' || p_partkey), p_partkey) - 1 AS i, count(*) OVER (PARTITION BY step, group_id) AS n FROM d JOIN part ON p_brand = group_id), k AS (SELECT unnest(range(120))::INT AS slot)
  SELECT step, group_id, image_id, slot FROM i JOIN k ON slot % n = i""",
    "sampled_batches": f"""WITH i AS (SELECT l_suppkey AS group_id, l_orderkey * 10 + l_linenumber AS image_id FROM lineitem WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY image_id) - 1 AS no FROM i), g AS (SELECT group_id, count(*) AS n, row_number() OVER (ORDER BY group_id) - 1 AS no, count(*) OVER () AS all_groups FROM i GROUP BY group_id),
  s AS (SELECT unnest(range(40)) AS step), p AS (SELECT step, unnest(range(least(8, (SELECT count(*) FROM g)))) AS place, (SELECT count(*) FROM g) AS n FROM s),
  c AS (SELECT step, {_permuted("place", "n", "'batch:' || step")} AS no FROM p), k AS (SELECT step, group_id, n, unnest(range(least(64, n))) AS kth FROM c JOIN g USING (no)),
  q AS (SELECT *, {_permuted("kth", "n", "'batch:' || step || ':' || group_id")} AS no FROM k)
  SELECT step::INT AS step, q.group_id, image_id, unnest(range(kth, 64, n))::INT AS slot FROM q JOIN r ON r.group_id = q.group_id AND r.no = q.no""",
    "best_box": f"WITH {_BOXES} SELECT image_id, box_id, greatest(0, least(800, x1))::INT AS cx1, greatest(0, least(600, y1))::INT AS cy1, greatest(0, least(800, x2))::INT AS cx2, greatest(0, least(600, y2))::INT AS cy2 FROM best",
    "crop_audit": f"WITH {_BOXES} SELECT count(*) AS images, count(*) FILTER (box_id IS NULL) AS no_box, count(*) FILTER (NOT (x1 <= 400 AND 400 <= x2)) AS off_centre FROM (SELECT DISTINCT o_orderkey AS image_id FROM orders) o LEFT JOIN best USING (image_id)",
    "best_polygon": """WITH a AS (SELECT l_orderkey AS image_id, l_linenumber * 1000000 + l_partkey AS polygon_id, abs(l_quantity * (l_quantity + l_linenumber) + l_quantity * l_quantity) / 2 AS area FROM lineitem WHERE NOT l_tax > 0.06)
  SELECT image_id, polygon_id, round(area, 4) AS area FROM a QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, polygon_id) = 1""",
    "rectification_summary": "SELECT count(*) FILTER (event_type <> 'error' AND NOT value > 100) AS ok, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'error' AND value > 100) AS fallbacks FROM events",
    "insert_unique_slug": f"WITH {_FEED} SELECT row_number, slug, slug NOT IN (SELECT slug FROM prods WHERE slug IS NOT NULL) AS accepted FROM feed WHERE slug IS NOT NULL",
    "latency_p95": """WITH e AS (SELECT event_type, round(value, 2) AS ms FROM events), l AS (SELECT event_type, list_sort(list(ms)) AS l FROM e GROUP BY ALL)
  SELECT event_type, l[greatest(0, floor(0.95 * len(l))::INT - 1) + 1] AS p95, l[len(l) // 2 + 1] AS median, l[-1] AS most, len(l) AS n FROM l""",
    "batch_summary": "SELECT count(*) FILTER (event_type = 'purchase') AS found, count(*) FILTER (event_type = 'click') AS probable, count(*) FILTER (event_type = 'view') AS not_in_catalog, count(*) FILTER (event_type = 'error') AS errors, list_sort(list(round(value, 2)))[count(*) // 2 + 1] AS median_ms FROM events",
    "pooled_totals": "WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS correct, count(*) AS total, avg(value) AS a FROM events GROUP BY ALL) SELECT sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total, round(sum(a * total) / sum(total), 4) AS avg_ms FROM p",
    "evaluate_pack": """WITH l AS (SELECT user_id AS query_id, arg_max(event_type, event_id) AS predicted, count(*) AS lines FROM events GROUP BY ALL), w AS (SELECT user_id AS query_id, min(event_type) AS expected FROM events WHERE event_type <> 'signup' GROUP BY ALL)
  SELECT query_id, predicted, expected, coalesce(predicted = expected, false) AS correct, lines FROM l LEFT JOIN w USING (query_id)""",
    "demote_unknown": """WITH l AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'P' THEN 'skip' ELSE 'in' END AS kind, list_sort(list_distinct(list_filter([o_custkey % 40, o_orderkey % 60], lambda x: x < 25))::VARCHAR[]) AS a FROM orders)
  SELECT query_id, CASE WHEN kind = 'in' AND len(a) = 0 THEN 'out' ELSE kind END AS kind, CASE WHEN len(a) > 0 THEN array_to_string(a, ',') END AS accepted FROM l""",
    "dense_index": "SELECT l_partkey AS product_id, dense_rank() OVER (ORDER BY l_partkey) - 1 AS index, count(*) AS n FROM lineitem GROUP BY l_partkey",
    "augmentation_manifest": "SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'catalog' WHEN 1 THEN 'odd-name' ELSE replace(p_name, ' ', '_') END AS aug_name, CASE WHEN p_partkey % 10 < 2 THEN 0 ELSE p_size END::BIGINT AS aug_seed FROM part",
    "feedback_exclusions": "SELECT user_id AS session, array_to_string(list_sort(list_distinct(list(event_id % 50))), ',') AS excluded FROM events WHERE event_type = 'error' GROUP BY ALL",
    "wish_sessions": """WITH e AS (SELECT user_id::VARCHAR AS session_id, epoch_us(ts) AS us, CASE event_type WHEN 'error' THEN 'reset' WHEN 'view' THEN NULL ELSE event_type END AS wish, CASE WHEN event_id % 7 <> 0 THEN (event_id % 50)::VARCHAR END AS value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY session_id ORDER BY us) > 432000000000, false)::INT AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY us) AS n FROM g),
  w AS (SELECT session_id, n, min(us) AS first, max(us) AS last, count(*) AS turns, max(us) FILTER (wish = 'reset') AS reset FROM s GROUP BY ALL),
  l AS (SELECT session_id, n, wish, value FROM s JOIN w USING (session_id, n) WHERE wish <> 'reset' AND (reset IS NULL OR us > reset) QUALIFY row_number() OVER (PARTITION BY session_id, n, wish ORDER BY us DESC, value DESC NULLS LAST) = 1),
  t AS (SELECT session_id, n, string_agg(concat_ws('=', wish, value), ',' ORDER BY wish) AS wishes FROM l GROUP BY ALL)
  SELECT session_id, first, last, turns, coalesce(wishes, '') AS wishes FROM w LEFT JOIN t USING (session_id, n)""",
    "session_contexts": """WITH g AS (SELECT user_id, event_type, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000, false)::INT AS new FROM events),
  s AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS types FROM s GROUP BY ALL""",
}

QUERIES = {
    f.__name__: f
    for f in (
        catalog_page, catalog_search, catalog_search_page, catalog_lookup, name_lookup, name_matches, names_in_texts, manifest_errors, manifest_first_error, vector_counts, ingest_plan, ingest_summary, apply_ingest, import_products, import_vectors, job_items, job_ledger, missing_images, url_targets, augmentation_plan, balanced_batches, sampled_batches, best_box, crop_audit,
        best_polygon, rectification_summary, insert_unique_slug, latency_p95, batch_summary, pooled_totals, evaluate_pack, demote_unknown, dense_index, augmentation_manifest, feedback_exclusions, session_contexts, wish_sessions,
    )
}
