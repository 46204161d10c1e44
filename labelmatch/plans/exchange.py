"""Files made of the given tables, in the formats of feeds, manifests, labels, predictions, reports and snapshots, and read again.

Each query writes its table to a folder of its own in the shared folder, so that its work grows with the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmatch.functions.storage import shared_dir, table
from labelmatch.functions.vectors import check_dimension
from labelmatch.operators import catalog, decide
from labelmatch.sources import files


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/exchange-{uuid.uuid4().hex}/{name}"


def named_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as text, with quotes, line ends, separators and missing values in their names."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit('say "'), F.col("p_name"), F.lit('", twice'))).when(k % 7 == 0, F.concat(F.col("p_name"), F.lit("\nnext line"))).when(k % 11 != 0, F.col("p_name"))
    return table(spark, d, "part").select(k.cast("string").alias("id"), name.alias("name"), F.col("p_brand").alias("brand"))


def feed_file(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "feed.csv")
    named_parts(spark, d).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return files.read_catalog_csv(spark, path)


def manifest_file(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "manifest.json")
    named_parts(spark, d).groupBy(F.expr("cast(id as bigint) % 64").alias("part")).agg(F.collect_list(F.struct("id", "name", "brand")).alias("products")).write.partitionBy("part").option("ignoreNullFields", False).json(path)  # a document a file
    return files.read_manifest(spark, path, most=10_000_000)


def predictions_of(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(k.cast("string").alias("query_id"), F.concat(k, F.lit(".jpg")).alias("image_path"), F.sha2(k.cast("string"), 256).alias("image_sha256"), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("s-"), F.col("l_partkey"))).alias("predicted_slug"), F.col("l_quantity").cast("bigint").alias("latency_ms"))


def predictions_file(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "predictions")
    files.write_predictions(predictions_of(spark, d), path)
    return files.read_predictions(spark, path)


def label_files(spark: SparkSession, d: str) -> DataFrame:
    """A mapping for all parts, and a label table that overrides half of them."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, F.concat(k, F.lit(".jpg")).alias("image_path"))
    case = F.struct(k.cast("string").alias("query_id"), "image_path", F.lit("x").alias("label"), F.when(k % 3 != 0, F.concat(F.lit("s-"), k)).alias("expected_slug"))
    held, tsv = folder(spark, "mapping"), folder(spark, "labels")
    p.groupBy(F.expr("p_partkey % 64").alias("part")).agg(F.collect_list(case).alias("cases")).write.partitionBy("part").json(held)
    status = F.when(k % 8 == 0, "in_catalog").when(k % 8 == 2, "not_in_catalog").otherwise("unsure")
    files.write_report(p.where("p_partkey % 2 = 0").select("image_path", F.concat(F.lit("t-"), k).alias("expected_slug"), status.alias("status"), F.when(k % 16 == 0, "a, b").alias("alt_slugs")), tsv)
    out = files.read_labels(spark, held, tsv)
    return out.select("image_path", "kind", F.array_join("accepted", "|").alias("accepted"))


def query_manifest_file(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "queries.tsv")
    k = F.col("o_orderkey")
    table(spark, d, "orders").select(F.concat(F.lit("q."), k).alias("query_id"), F.concat(k, F.lit(".jpg")).alias("image_path")).write.option("header", True).option("sep", "\t").csv(path)
    return files.read_query_manifest(spark, path)


def vectors_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of three models, of which one is read."""
    path = folder(spark, "vectors")
    files.write_vectors(table(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("m"), F.col("vec_id") % 3).alias("model")), path)
    out = files.read_vectors(spark, path, "m1")
    return out.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate(F.col("embedding"), F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def report_file(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "report.tsv")
    files.write_report(named_parts(spark, d), path)
    return files.read_catalog_csv(spark, path, sep="\t")


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Three tables exported and restored against their manifest."""
    path = folder(spark, "snapshot")
    files.export_snapshot({name: table(spark, d, name) for name in ("part", "supplier", "customer")}, path)
    restored, out = files.restore_snapshot(spark, path), None
    for name, key in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey")):
        row = restored[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


def feedback_file(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "feedback")
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ts"), F.concat(F.lit("w"), F.col("l_partkey")).alias("wine"), (F.col("l_quantity") > 25).alias("liked"), F.col("l_returnflag").alias("dish"), F.round(F.col("l_discount"), 2).cast("double").alias("score"))
    e.write.mode("append").json(path)
    return files.read_feedback(spark, path).groupBy("wine", "liked").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def image_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of up to 16, with lengths and hashes of their bytes; what has another extension is not listed."""
    path = folder(spark, "images")
    p = table(spark, d, "pages").where("page_id is not null and html is not null").select(F.expr("page_id div 16").alias("lot"), "page_id", F.col("html").alias("value"))
    p.repartition("lot").sortWithinPartitions("lot", "page_id", "value").select("lot", "value").write.partitionBy("lot").text(path)
    found = files.image_inventory(spark, path, "*.txt")
    return found.select(F.regexp_extract("path", r"lot=(-?[0-9]+)", 1).cast("long").alias("lot"), "length", "sha256")


def threshold_errors(spark: SparkSession, d: str) -> DataFrame:
    """Discounts and taxes as bounds, some of them missing."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return decide.threshold_errors(table(spark, d, "lineitem").select(k.alias("name"), F.when(k % 13 != 0, F.col("l_discount")).alias("reject_below"), F.col("l_tax").alias("found_similarity")))


def ratio_test(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("product_id"), F.col("l_tax").alias("d1"), F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("d2"))
    m = m.withColumns({"product_id": F.col("product_id") % 2, "query_id": F.col("query_id") % 1000})
    return decide.ratio_test(m)


def dimension_check(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of which some are cut short, or null, and are set aside."""
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 60)).when(F.col("vec_id") % 10 != 7, F.col("embedding")))
    good, bad = check_dimension(e, "embedding", 64)
    return good.select("vec_id", F.lit(True).alias("fits")).unionByName(bad.select("vec_id", F.lit(False).alias("fits")))


def product_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The part of an id, that of a slug, and none of an unknown id."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("s-"), F.col("p_partkey")).alias("slug"), F.col("p_name").alias("title"))
    return catalog.by_id(p, 7).unionByName(catalog.by_slug(p, "s-11")).unionByName(catalog.by_id(p, -1))


_NAME = "CASE WHEN p_partkey % 5 = 0 THEN 'say \"' || p_name || '\", twice' WHEN p_partkey % 7 = 0 THEN p_name || chr(10) || 'next line' WHEN p_partkey % 11 <> 0 THEN p_name END"
_K = "(l_orderkey * 10 + l_linenumber)"

SQL = {
    "feed_file": f"SELECT p_partkey::VARCHAR AS id, coalesce({_NAME}, '') AS name, p_brand AS brand FROM part",
    "manifest_file": f"SELECT p_partkey::VARCHAR AS id, {_NAME} AS name, p_brand AS brand FROM part",
    "predictions_file": f"SELECT {_K}::VARCHAR AS query_id, {_K} || '.jpg' AS image_path, sha256({_K}::VARCHAR) AS image_sha256, CASE WHEN l_partkey % 3 <> 0 THEN 's-' || l_partkey END AS predicted_slug, l_quantity::BIGINT AS latency_ms FROM lineitem",
    "label_files": """SELECT p_partkey || '.jpg' AS image_path, CASE WHEN p_partkey % 2 = 0 THEN CASE p_partkey % 8 WHEN 0 THEN 'in' WHEN 2 THEN 'out' ELSE 'skip' END WHEN p_partkey % 3 <> 0 THEN 'in' ELSE 'out' END AS kind,
  CASE WHEN p_partkey % 2 = 0 THEN 't-' || p_partkey || CASE WHEN p_partkey % 16 = 0 THEN '|a|b' ELSE '' END WHEN p_partkey % 3 <> 0 THEN 's-' || p_partkey ELSE '' END AS accepted FROM part""",
    "query_manifest_file": "SELECT 'q.' || o_orderkey AS query_id, o_orderkey || '.jpg' AS image_path FROM orders",
    "vectors_by_model": "SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings WHERE vec_id % 3 = 1",
    "report_file": f"SELECT p_partkey::VARCHAR AS id, coalesce(replace({_NAME}, chr(10), ' '), '') AS name, p_brand AS brand FROM part",
    "snapshot": "SELECT 'part' AS name, count(*) AS n, sum(p_partkey)::BIGINT AS total FROM part UNION ALL SELECT 'supplier', count(*), sum(s_suppkey)::BIGINT FROM supplier UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM customer",
    "feedback_file": "SELECT 'w' || l_partkey AS wine, l_quantity > 25 AS liked, count(*) AS n, round(sum(round(l_discount, 2)::DOUBLE), 6) AS score FROM lineitem GROUP BY ALL",
    "image_inventory": "WITH f AS (SELECT page_id // 16 AS lot, string_agg(html || chr(10), '' ORDER BY page_id, html) AS content FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL GROUP BY ALL) SELECT lot, octet_length(encode(content)) AS length, sha256(content) AS sha256 FROM f",
    "threshold_errors": f"SELECT {_K} AS name, CASE WHEN {_K} % 13 = 0 OR l_discount IS NULL OR l_tax IS NULL THEN 'missing' ELSE 'exceeds' END AS error FROM lineitem WHERE {_K} % 13 = 0 OR l_discount IS NULL OR l_tax IS NULL OR l_discount > l_tax",
    "ratio_test": """SELECT l_orderkey % 1000 AS query_id, l_suppkey % 2 AS product_id, count(*) FILTER (l_linenumber <> 7 AND l_tax < 0.75 * l_discount) AS good, count(*) FILTER (l_linenumber <> 7 AND l_tax < 0.75 * l_discount) >= 4 AS usable FROM lineitem GROUP BY ALL""",
    "dimension_check": "SELECT vec_id, coalesce(vec_id % 10 NOT IN (3, 7) AND len(embedding) = 64, false) AS fits FROM embeddings",
    "product_by_key": "SELECT p_partkey AS product_id, 's-' || p_partkey AS slug, p_name AS title FROM part WHERE p_partkey IN (7, 11)",
}

QUERIES = {f.__name__: f for f in (feed_file, manifest_file, predictions_file, label_files, query_manifest_file, vectors_by_model, report_file, snapshot, feedback_file, image_inventory, threshold_errors, ratio_test, dimension_check, product_by_key)}
