"""Tables in versions: a change of several tables becomes visible at once, or not at all.

A folder holds ``data`` and ``log``. A table is kept in buckets of its key; a change writes new files for the buckets it
touches only, and then one small manifest that names the files of all buckets of all tables. The manifest's number is the
version; it appears by one rename, which is the commit. Files of a change that never got its manifest are read by nobody, so a
crash at any point leaves the version before. A manifest also says which batch of each stream was the last to be committed,
so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Change:
    """Rows to add to a table, and keys whose old rows go; keys of added rows are replaced too unless ``append``."""

    rows: DataFrame
    removed: DataFrame | None = None
    append: bool = False


class Versions:
    """Versioned tables below ``path``; ``keys`` names the key column of each table."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _at(self, path: str):
        held = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return held.getFileSystem(self.spark._jsc.hadoopConfiguration()), held

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        fs, log = self._at("log")
        if not fs.exists(log):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version, by default the last, consists of; before the first one, nothing."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}, "batches": {}}
        number = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/log/{number:020d}.json", wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as it was in a version, by default the last."""
        return self._read(self.manifest(version), table)

    def _read(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        held = manifest["tables"].get(table)
        if held is None:
            raise KeyError(f"no table {table} in version {manifest['version']}")
        schema = T.StructType.fromJson(held["schema"])
        paths = [f"{self.path}/{p}" for b, p in held["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def commit(self, changes: dict[str, Change], stream: str | None = None, batch: int | None = None) -> int:
        """Apply the changes as one new version and return its number; of a ``stream`` only batches after the last committed one.

        Only buckets that hold a removed or added key are read and written. Null keys are refused.
        """
        old = self.manifest()
        if stream is not None and old["batches"].get(stream, -1) >= batch:
            return old["version"]
        new = {"version": old["version"] + 1, "tables": dict(old["tables"]), "batches": dict(old["batches"]) | ({stream: batch} if stream is not None else {})}
        for table, change in changes.items():
            new["tables"][table] = self._changed(old, table, change)
        self._publish(new)
        return new["version"]

    def _changed(self, old: dict, table: str, change: Change) -> dict:
        key = self.keys[table]
        rows = change.rows.withColumn("_bucket", self._bucket(key))
        gone = None if change.removed is None else change.removed.select(key)
        if not change.append:
            gone = change.rows.select(key) if gone is None else gone.unionByName(change.rows.select(key))
        gone = None if gone is None else gone.distinct()
        touched = rows.select("_bucket", F.col(key).isNull().alias("lost"))
        if gone is not None:
            touched = touched.unionByName(gone.select(self._bucket(key).alias("_bucket"), F.col(key).isNull().alias("lost")))
        told = touched.groupBy("_bucket").agg(F.max("lost").alias("lost")).collect()  # a row for each bucket
        if any(r.lost for r in told):
            raise ValueError(f"{table} has null keys")
        numbers = [r["_bucket"] for r in told]
        held = old["tables"].get(table, {"schema": json.loads(change.rows.schema.json()), "buckets": {}})
        if held["buckets"]:
            kept = self._read(old, table, numbers)
            if gone is not None:
                kept = kept.join(gone, key, "left_anti")
            rows = rows.select(*kept.columns, "_bucket").unionByName(kept.withColumn("_bucket", self._bucket(key)))
        folder = f"data/{table}/{uuid.uuid4().hex}"
        if numbers:
            rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, place = self._at(folder)
        found = {n.split("=")[1] for n in (f.getPath().getName() for f in fs.listStatus(place)) if n.startswith("_bucket=")} if numbers and fs.exists(place) else set()
        buckets = {b: p for b, p in held["buckets"].items() if int(b) not in numbers}
        return {"schema": held["schema"], "buckets": buckets | {b: f"{folder}/_bucket={b}" for b in found}}

    def _publish(self, manifest: dict) -> None:
        """The manifest under its number, by a rename; an error if another writer has taken the number."""
        fs, done = self._at(f"log/{manifest['version']:020d}.json")
        _, draft = self._at(f"log/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if fs.exists(done) or not fs.rename(draft, done):
            fs.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} was committed by another writer")

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last ``keep`` versions names, and the manifests before these; how many folders went."""
        known = self.versions()
        named = {p.rsplit("/", 1)[0] for v in known[-keep:] for t in self.manifest(v)["tables"].values() for p in t["buckets"].values()}
        gone = 0
        for table in self.keys:
            fs, place = self._at(f"data/{table}")
            for folder in fs.listStatus(place) if fs.exists(place) else []:
                if f"data/{table}/{folder.getPath().getName()}" not in named:
                    gone += bool(fs.delete(folder.getPath(), True))
        for v in known[:-keep]:
            fs, place = self._at(f"log/{v:020d}.json")
            fs.delete(place, False)
        return gone
