"""A catalog store: products by id in buckets, with versions.

    <path>/data/version=<n>/bucket=<b>/*.parquet     what version n wrote of bucket b
    <path>/manifest/<n>.json                         of version n: which version holds each bucket

A bucket is a hash of the id. An update reads and writes the buckets that its ids fall into and no other; it writes them to its own folder and then
creates its manifest, which must not exist yet. So readers see a version whole or not at all, one that dies leaves only a folder that no
manifest names, and of two that update at once the second fails (Conflict) and may try again. A lookup's bucket is known from its id: one folder is read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestrata import schemas
from lodestrata.functions.materialize import materialized

BUCKETS = 64


class Conflict(RuntimeError):
    """Another update made the version first."""


class CatalogStore:
    """Products (id, columns of schemas.PRODUCT) under a path that all executors reach. `buckets` counts where the store is new."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, ddl: str = schemas.PRODUCT):
        self.spark, self.path, self.new_buckets = spark, path.rstrip("/"), buckets
        self.shape = StructType.fromDDL(f"id string, {ddl}")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # --- manifests ---

    def _place(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._place("manifest")
        fs = folder.getFileSystem(self._conf)
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known and version is None:
            return {"version": 0, "buckets": self.new_buckets, "held": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"there is no version {version}")
        place = self._place("manifest", f"{version}.json")
        stream = place.getFileSystem(self._conf).open(place)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Writes a manifest beside its place and renames it there, which fails if it exists."""
        draft, place = self._place("manifest", f".{uuid.uuid4().hex}"), self._place("manifest", f"{manifest['version']}.json")
        fs = draft.getFileSystem(self._conf)
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, place, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(place):
                raise Conflict(f"version {manifest['version']} exists") from e
            raise

    # --- reading ---

    def _bucket(self, key: Column, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(manifest["buckets"]))

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        """The rows of a version with their bucket; of some buckets only, if given."""
        shape = StructType([*self.shape.fields, StructField("version", LongType()), StructField("bucket", LongType())])
        held = [(int(b), v) for b, v in manifest["held"].items() if only is None or int(b) in only]
        if not held:
            return self.spark.createDataFrame([], shape)
        data = f"{self.path}/data"
        return self.spark.read.schema(shape).option("basePath", data).parquet(*(f"{data}/version={v}/bucket={b}" for b, v in sorted(held)))

    def read(self, version: int | None = None) -> DataFrame:
        """id and the product's columns, as of a version (the last one, if none is given)."""
        return self._rows(self._manifest(version)).drop("version", "bucket")

    def lookup(self, product_id: str, version: int | None = None) -> DataFrame:
        """The row of an id: its bucket is a filter on folders, so the others aren't listed or read."""
        manifest = self._manifest(version)
        wanted = F.lit(product_id)
        found = self._rows(manifest).filter((F.col("bucket") == self._bucket(wanted, manifest)) & (F.col("id") == wanted))
        return found.drop("version", "bucket")

    # --- writing ---

    def upsert(self, products: DataFrame) -> int:
        """Puts products in, in place of those with the same id; gives the new version. Rows without an id are left out; of rows that
        share an id one stays, that of the greatest hash of all columns.
        """
        names = self.shape.fieldNames()
        given = products.filter("id is not null").select(*names)
        one = given.groupBy("id").agg(F.max_by(F.struct(*names), F.xxhash64(*(F.to_json(F.struct(n)) for n in names))).alias("row")).select("row.*")
        return self._replace(one, one.select("id"))

    def remove(self, ids: DataFrame) -> int:
        """Takes the products with these ids (column id) out; gives the new version."""
        return self._replace(self.spark.createDataFrame([], self.shape), ids.select("id").distinct())

    def _replace(self, rows: DataFrame, ids: DataFrame) -> int:
        manifest = self._manifest()
        version = manifest["version"] + 1
        new = materialized(rows.withColumn("bucket", self._bucket(F.col("id"), manifest)))
        gone = materialized(ids.withColumn("bucket", self._bucket(F.col("id"), manifest)))
        touched = {r.bucket for r in gone.select("bucket").distinct().collect()}
        kept = self._rows(manifest, touched).drop("version").join(gone.select("id"), "id", "left_anti")
        whole = kept.select(*self.shape.fieldNames(), "bucket").unionByName(new.select(*self.shape.fieldNames(), "bucket"))
        # no two runs share a folder, so that what a failed one left is never read
        folder = f"{version}{uuid.uuid4().int % 10**9:09d}"
        whole.repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{self.path}/data/version={folder}")
        filled = {r.bucket for r in self.spark.read.schema(StructType([StructField("bucket", LongType())])).parquet(f"{self.path}/data/version={folder}").select("bucket").distinct().collect()} if touched else set()
        held = {b: v for b, v in manifest["held"].items() if int(b) not in touched} | {str(b): int(folder) for b in filled}
        self._commit({"version": version, "buckets": manifest["buckets"], "held": held})
        return version

    def vacuum(self, keep: int = 2) -> list[int]:
        """Removes all but the last versions' manifests, and folders that no manifest left names; gives the versions that are left."""
        known = self.versions()
        data = self._place("data")
        fs = data.getFileSystem(self._conf)
        for version in known[:-keep]:
            fs.delete(self._place("manifest", f"{version}.json"), False)
        named = {v for version in known[-keep:] for v in self._manifest(version)["held"].values()}
        for x in fs.listStatus(data) if fs.exists(data) else []:
            if int(x.getPath().getName().removeprefix("version=")) not in named:
                fs.delete(x.getPath(), True)
        return known[-keep:]
