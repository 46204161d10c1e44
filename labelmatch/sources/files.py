"""Feeds, manifests, labels, predictions, vectors, images, reports and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION = "query_id string, image_path string, image_sha256 string, predicted_slug string, latency_ms bigint"
CASE = "query_id string, image_path string, label string, expected_slug string, expected_external_id bigint, image_sha256 string"
FEEDBACK = "ts bigint, wine string, liked boolean, dish string, score double"


def read_catalog_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A feed with a header, quoted fields over lines, a byte-order mark or not; all text, null as empty."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', encoding="UTF-8", inferSchema=False)
    return df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns]).na.fill("")


def read_manifest(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """A JSON list, a JSON object with ``products``, or a CSV; empty ones and ones above ``most`` rows are errors."""
    if path.endswith(".csv"):
        rows = read_catalog_csv(spark, path)
    elif path.endswith(".json"):
        held = spark.read.json(path, multiLine=True)
        rows = held.select(F.explode("products").alias("p")).select("p.*") if "products" in held.columns else held
    else:
        raise ValueError("a manifest is .json or .csv")
    n = rows.limit(most + 1).count()
    if not 0 < n <= most:
        raise ValueError(f"a manifest has 1 to {most} rows")
    return rows


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and broken lines are left out."""
    df = spark.read.schema(f"{PREDICTION}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return df.where("_corrupt_record is null and query_id is not null").drop("_corrupt_record")


def read_labels(spark: SparkSession, json_path: str | None = None, tsv_path: str | None = None) -> DataFrame:
    """``(image_path, kind in|out|skip, accepted)`` from a mapping's cases and a label table; the table wins."""
    parts = []
    if json_path:
        cases = spark.read.schema(f"cases array<struct<{', '.join(x.replace(' ', ':') for x in CASE.split(', '))}>>").json(json_path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
        parts.append(cases.select("image_path", F.when(F.col("expected_slug").isNotNull(), "in").otherwise("out").alias("kind"), F.array_compact(F.array("expected_slug")).alias("accepted"), F.lit(0).alias("priority")))
    if tsv_path:
        rows = spark.read.csv(tsv_path, header=True, sep="\t")
        kind = F.when(F.col("status") == "in_catalog", "in").when(F.col("status") == "not_in_catalog", "out").otherwise("skip")
        accepted = F.array_distinct(F.filter(F.concat(F.array("expected_slug"), F.split(F.coalesce("alt_slugs", F.lit("")), r"\s*,\s*")), lambda s: s.isNotNull() & (s != "")))
        parts.append(rows.select("image_path", kind.alias("kind"), accepted.alias("accepted"), F.lit(1).alias("priority")))
    if not parts:
        raise ValueError("name a mapping or a table")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("image_path").agg(F.max_by(F.struct("kind", "accepted"), "priority").alias("l")).select("image_path", "l.*")


def read_query_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``query_id<TAB>image_path``; ids of letters, digits and ._- once each; paths inside the folder; one row at least."""
    from labelmatch.operators.ingest import unsafe_path

    rows = spark.read.csv(path, header=True, sep="\t")
    if rows.columns != ["query_id", "image_path"]:
        raise ValueError("the header must be query_id and image_path")
    bad = F.coalesce(~F.col("query_id").rlike("^[A-Za-z0-9._-]+$"), F.lit(True)) | F.col("image_path").isNull() | unsafe_path(F.col("image_path"))
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("ids"), F.count_if(bad).alias("bad")).first()
    if not seen["n"] or seen["bad"] or seen["ids"] != seen["n"]:
        raise ValueError(f"{seen['n']} rows, {seen['ids']} ids, {seen['bad']} invalid")
    return rows


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if model is None else rows.where(F.col("model") == model)


def write_vectors(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by model, so that a search reads its own model only."""
    rows.write.mode(mode).partitionBy("model").parquet(path)


def image_inventory(spark: SparkSession, folder: str, pattern: str = "*.{jpg,jpeg,png,webp}", with_hash: bool = True) -> DataFrame:
    """``(path, length[, sha256])`` of the files that are not empty; contents are read only for the hash."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).where("length > 0")
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256")) if with_hash else rows.select("path", "length")


def write_predictions(rows: DataFrame, path: str) -> None:
    """JSON lines, nulls written; an empty slug is null. The job's commit publishes all or nothing."""
    rows.withColumn("predicted_slug", F.nullif("predicted_slug", F.lit(""))).write.option("ignoreNullFields", "false").json(path)


def write_report(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """A table of text; tabs and line ends inside fields become a space, quotes are doubled, as the readers here expect."""
    flat = [F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[\t\r\n]+", " ").alias(c) for c in rows.columns]
    rows.select(*flat).write.csv(path, header=True, sep=sep, quote='"', escape='"')


def export_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as Parquet, and a manifest ``(name, rows, checksum)`` of what was written."""
    spark = next(iter(tables.values())).sparkSession
    marks = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        mark = _mark(spark.read.parquet(f"{path}/{name}"), name)
        marks = mark if marks is None else marks.unionByName(mark)
    marks.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("name string, rows bigint, checksum string").json(f"{path}/manifest")


def _mark(df: DataFrame, name: str) -> DataFrame:
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("checksum"))


def restore_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, each held against the manifest first."""
    out = {}
    for want in spark.read.schema("name string, rows bigint, checksum string").json(f"{path}/manifest").collect():  # a row for each table
        df = spark.read.parquet(f"{path}/{want['name']}")
        if _mark(df, want["name"]).first()[:] != want[:]:
            raise ValueError(f"{want['name']} is not what the manifest says")
        out[want["name"]] = df
    return out


def export_feature_matrices(products: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors with the dense number 0..n-1 of their product, by the order of ids.

    Numbers come from counts of id ranges, so no task holds all products.
    """
    ids = products.select("product_id").distinct().repartitionByRange("product_id").sortWithinPartitions("product_id").withColumn("part", F.spark_partition_id())
    from labelmatch.functions.storage import written

    held = written(ids, "dense-ids")
    from pyspark.sql import Window

    sizes = held.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "before")
    numbered = held.join(F.broadcast(sizes), "part").withColumn("index", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("product_id")) - 1)
    return vectors.join(numbered.select("product_id", "index"), "product_id")


def augmentation_manifest(paths: DataFrame, path: str = "path") -> DataFrame:
    """``<name>_<seed>.webp`` -> (name, seed); ``catalog.webp`` and other names -> (stem, 0)."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    seeded = name.rlike(r"^.+_\d+\.webp$")
    return paths.withColumn("aug_name", F.when(seeded, F.regexp_extract(name, r"^(.+)_(\d+)\.webp$", 1)).otherwise(stem)).withColumn("aug_seed", F.when(seeded, F.regexp_extract(name, r"^(.+)_(\d+)\.webp$", 2)).otherwise("0").cast("long"))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).json(path)


def stream_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).json(path)
