"""Tables on Parquet that change by commits: touched buckets are written anew, and one small file makes them count.

A store has named tables, each dealt into BUCKETS folders by its key.  A commit
writes the buckets it touches under a new name and then a manifest, numbered one
higher, that lists the folders of all tables.  Readers take the folders of one
manifest, so they see all of a commit or nothing; a run that ends before its manifest
leaves only folders that nobody reads.  A commit's run name is kept: doing it again
changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32
_BUCKET = "__bucket"


class Conflict(Exception):
    """Another commit took the number: read again and retry."""


class Store:
    """Versioned tables under one folder.  ``keys`` names each table's key columns; a null key is a key like others."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of; the last one by default, version 0 before any commit."""
        version = version if version is not None else max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}, "runs": []}
        text = self.spark.read.text(f"{self.root}/versions/{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        """Write aside, then rename: the number exists once or not at all."""
        folder = f"{self.root}/versions"
        aside, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{manifest['version']:08d}.json")
        out = self._files.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._files.exists(final) or not self._files.rename(aside, final):
            self._files.delete(aside, False)
            raise Conflict(f"version {manifest['version']} exists")

    # reading

    def read(self, table: str, version: int | None = None, only: Iterable[int] | None = None) -> DataFrame | None:
        """Rows of a table at a version (of some buckets only); None before its first commit."""
        return self._rows(self.manifest(version), table, only)

    def _rows(self, manifest: dict, table: str, only: Iterable[int] | None = None) -> DataFrame | None:
        if table not in manifest["tables"]:
            return None
        entry = manifest["tables"][table]
        schema = T.StructType.fromJson(entry["schema"])
        folders = [f for b, f in entry["buckets"].items() if only is None or int(b) in set(only)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # committing

    def _with_bucket(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys[table]), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, table: str, touched: list[int]) -> dict[str, str | None]:
        """Folders of the touched buckets' new rows; None for one that is left without rows."""
        folder = f"{self.root}/data/{table}-{uuid.uuid4().hex}"
        self._with_bucket(table, rows).repartition(max(1, len(touched)), _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        there = {f.getPath().getName().partition("=")[2] for f in self._files.listStatus(self._path(folder)) if f.isDirectory()}
        return {str(b): f"{folder}/{_BUCKET}={b}" if str(b) in there else None for b in touched}

    def _touched(self, table: str, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys; at most ``buckets`` numbers reach the driver."""
        return sorted(r[0] for r in self._with_bucket(table, rows.select(*self.keys[table])).select(_BUCKET).distinct().collect())

    def commit(self, run: str, changes: dict[str, tuple[DataFrame, DataFrame | None]]) -> int:
        """One version from changes to some tables: {table: (touching, make)}.

        ``touching`` has the keys whose buckets change; ``make`` takes the old rows of those
        buckets (None before the first commit) to the new ones.  A run that is in the
        manifest already changes nothing.
        """
        base = self.manifest()
        if run in base["runs"]:
            return base["version"]
        tables = dict(base["tables"])
        for table, (touching, make) in changes.items():
            touched = self._touched(table, touching)
            old = self._rows(base, table, touched)
            new = make(old)
            entry = tables.get(table, {"buckets": {}})
            found = {**entry["buckets"], **self._write(new, table, touched)}
            tables[table] = {"schema": new.schema.jsonValue(), "buckets": {b: f for b, f in found.items() if f}}
        manifest = {"version": base["version"] + 1, "tables": tables, "runs": [*base["runs"], run]}
        self._publish(manifest)
        return manifest["version"]

    def upsert(self, run: str, table: str, rows: DataFrame, touching: DataFrame | None = None) -> int:
        """Rows by key: new ones are added, of known ones each column that is not null replaces the old value.

        Of several given rows with one key the greatest, column by column from the left, counts.
        ``touching`` has the keys of ``rows`` where these are costly: then they are made once.
        """
        keys = self.keys[table]
        values = [c for c in rows.columns if c not in keys]
        fresh = rows.groupBy(*keys).agg(F.max(F.struct(*values)).alias("__new")) if values else rows.distinct()

        def make(old: DataFrame | None) -> DataFrame:
            if not values:
                return fresh if old is None else old.union(fresh).distinct()
            plain = fresh.select(*keys, *[F.col("__new")[c].alias(c) for c in values])
            if old is None:
                return plain
            a, b = plain.alias("a"), old.alias("b")
            same = F.lit(True)
            for k in keys:
                same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
            there = F.lit(1)
            both = plain.withColumn("__a", there).alias("a").join(old.withColumn("__b", there).alias("b"), same, "full")
            picked = [F.when(F.col("__a").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
            return both.select(*picked, *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in values])

        return self.commit(run, {table: (fresh if touching is None else touching, make)})

    def replace(self, run: str, table: str, rows: DataFrame) -> int:
        """All rows of the given keys: what the table had of a key goes, what is given comes.  Keys may have many rows."""
        keys = self.keys[table]

        def make(old: DataFrame | None) -> DataFrame:
            if old is None:
                return rows
            return self._without(old, rows.select(*keys).distinct(), keys).unionByName(rows)

        return self.commit(run, {table: (rows, make)})

    def delete(self, run: str, keys_of: dict[str, DataFrame]) -> int:
        """The rows of the given keys go, from all the tables in one commit."""

        def without(table: str, gone: DataFrame):
            return lambda old: self._without(old, gone, self.keys[table]) if old is not None else gone.limit(0)

        known = self.manifest()["tables"]
        return self.commit(run, {t: (gone, without(t, gone)) for t, gone in keys_of.items() if t in known})

    @staticmethod
    def _without(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
        named = gone.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return old.join(named, same, "left_anti")

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the last ``keep`` versions reads; how many went.  Not beside a running commit."""
        used = {f for v in self.versions()[-keep:] for t in self.manifest(v)["tables"].values() for f in t["buckets"].values()}
        data = self._path(f"{self.root}/data")
        gone = 0
        for folder in self._files.listStatus(data) if self._files.exists(data) else []:
            for bucket in self._files.listStatus(folder.getPath()):
                if bucket.isDirectory() and f"{self.root}/data/{folder.getPath().getName()}/{bucket.getPath().getName()}" not in used:
                    self._files.delete(bucket.getPath(), True)
                    gone += 1
        return gone
