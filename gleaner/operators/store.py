"""A table by key in versions: upsert, drop and recreate, and readers on a snapshot.

Rows are in buckets by the hash of their key, each a folder of Parquet files that is never changed. A
version is a manifest, which names the folder of every bucket. A write reads only the buckets that its
keys fall into, writes new folders for them, and puts the next manifest in its place in one rename; a
crash before that leaves the old version as it was, and data that no manifest names. Of two writers
that start from the same version the rename of one fails, and it merges its rows into the other's
version. A reader keeps to the version that it opened until ``vacuum`` removes that.

A bucket is written by one task, so ``buckets`` follows the size of the table: some hundred MB each.
Of several rows with a key in one write the largest stays. Nulls in a key are a value like any other.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import storage

ATTEMPTS = 8


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema)
        self.rest = [f.name for f in self.schema if f.name not in key]

    def versions(self) -> list[int]:
        found = storage.names(self.spark, f"{self.path}/manifests")
        return sorted(int(n.removesuffix(".json")) for n in found if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, of the last one if none is given, of an empty table if there is none."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "count": self.buckets, "buckets": {}}
        return json.loads(storage.read_text(self.spark, f"{self.path}/manifests/{known[-1] if version is None else version:012d}.json"))

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        some = manifest["buckets"] if buckets is None else {str(b): manifest["buckets"][str(b)] for b in buckets if str(b) in manifest["buckets"]}
        if not some:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}" for folder in some.values()])

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The table as of a version; later writes do not change it."""
        return self._read(self.manifest(version))

    def _bucket(self, count: int) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(count)).cast("int")

    def matching(self, keys: DataFrame) -> DataFrame:
        """Rows of the table with one of the keys; only the buckets of these are read."""
        manifest = self.manifest()
        # At most as many as there are buckets.
        asked = [r[0] for r in keys.select(self._bucket(manifest["count"]).alias("bucket")).distinct().collect()]
        rows = self._read(manifest, asked)
        return rows.alias("s").join(keys.select(*self.key).distinct().alias("k"), self._same("s", "k"), "left_semi")

    def _same(self, a: str, b: str) -> F.Column:
        return F.expr(" AND ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in self.key))

    def _once(self, rows: DataFrame) -> DataFrame:
        told = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        if not self.rest:
            return told.distinct()
        return told.groupBy(*self.key).agg(F.max(F.struct(*self.rest)).alias("rest")).select(*self.key, *[F.col("rest")[c].alias(c) for c in self.rest]).select(*self.schema.names)

    def upsert(self, rows: DataFrame) -> int:
        """Put rows in, in place of those with the same key; the new version."""
        new = storage.keep(self._once(rows))
        return self._commit(lambda old, _: old.alias("o").join(new.alias("n"), self._same("o", "n"), "left_anti").unionByName(new), new)

    def insert(self, rows: DataFrame, over: F.Column) -> int:
        """Put in the rows whose key is not there, or has a row for which ``over`` holds; the new version."""
        new = storage.keep(self._once(rows))

        def merged(old: DataFrame, _: int) -> DataFrame:
            stay = old.filter(~over)
            return stay.unionByName(new.alias("n").join(stay.alias("o"), self._same("o", "n"), "left_anti"))

        return self._commit(merged, new)

    def remove(self, keys: DataFrame) -> int:
        gone = storage.keep(keys.select(*self.key).distinct())
        return self._commit(lambda old, _: old.alias("o").join(gone.alias("n"), self._same("o", "n"), "left_anti"), gone)

    def replace(self, rows: DataFrame) -> int:
        """Drop the table and create it from ``rows``, in one step for readers."""
        new = storage.keep(self._once(rows))
        return self._commit(lambda old, _: new, None)

    def _commit(self, merged, touched: DataFrame | None) -> int:
        for attempt in range(ATTEMPTS):
            manifest = self.manifest()
            count = manifest["count"]
            asked = None if touched is None else [r[0] for r in touched.select(self._bucket(count).alias("bucket")).distinct().collect()]
            if asked == []:
                return manifest["version"]
            folder = f"data/{uuid.uuid4().hex}"
            out = merged(self._read(manifest, asked), attempt)
            out.withColumn("bucket", self._bucket(count)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            written = {n.removeprefix("bucket="): f"{folder}/{n}" for n in storage.names(self.spark, f"{self.path}/{folder}") if n.startswith("bucket=")}
            left = {} if asked is None else {b: f for b, f in manifest["buckets"].items() if int(b) not in asked}
            version = manifest["version"] + 1
            if self._put({"version": version, "count": count, "buckets": left | written}):
                return version
            storage.remove(self.spark, f"{self.path}/{folder}")
        raise TimeoutError(f"{ATTEMPTS} other writers came first")

    def _put(self, manifest: dict) -> bool:
        draft = f"{self.path}/manifests/draft-{uuid.uuid4().hex}"
        storage.write_text(self.spark, draft, json.dumps(manifest))
        if storage.rename_new(self.spark, draft, f"{self.path}/manifests/{manifest['version']:012d}.json"):
            return True
        storage.remove(self.spark, draft)
        return False

    def vacuum(self, versions: int = 2, age: float = 86_400) -> None:
        """Remove all but the last versions, and data of at least ``age`` seconds that none of those names."""
        known = self.versions()
        for version in known[:-versions]:
            storage.remove(self.spark, f"{self.path}/manifests/{version:012d}.json")
        used = {folder.split("/")[1] for version in known[-versions:] for folder in self.manifest(version)["buckets"].values()}
        for name, changed in storage.names(self.spark, f"{self.path}/data").items():
            if name not in used and time.time() - changed / 1000 >= age:
                storage.remove(self.spark, f"{self.path}/data/{name}")
