"""Tables cut out of a lineage and written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a folder of this machine only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="labelmatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables this process has written, as (path, name in the catalog or None); ``release`` deletes them.
_MADE: list[tuple[str, str | None]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, which ``release`` deletes too."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((path, None))
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((path, None))
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """``df`` as a Parquet table in the shared folder in ``n`` buckets of ``key``: grouping by it later moves no row."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    _MADE.append((f"{shared_dir(spark)}/{name}", name))
    df.write.format("parquet").option("compression", "uncompressed").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Delete all tables that this process has written, and their names in the catalog: when no result that reads them will be evaluated again."""
    for path, name in _MADE:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        held = spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)
    _MADE.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, read from a table, dealt over all cores where the table has fewer parts than these, before work that is heavy per row.

    Large tables have parts enough and are not shuffled; the rows and what is made of them are the same either way.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
