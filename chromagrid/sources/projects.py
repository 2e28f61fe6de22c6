"""A keyed table on disk with versions: changes write new files for the buckets they touch and name them in the next version.

A version is one small file that lists the folder of each bucket.  It is made by a create that fails where the name is
taken, so of two writers that began from one version the first wins and the other gets a Conflict and changes nothing.  A reader
holds the version it began with; files of old versions stay until ``vacuum``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import sinks


class Conflict(Exception):
    """Another writer has made the version that this change was to become."""


class Projects:
    """Rows of ``schema`` by the column ``key``, under ``folder`` (any file system of Hadoop's)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "id", buckets: int = 16):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        store, path = self._path("versions")
        return sorted(int(f.getPath().getName()) for f in store.listStatus(path)) if store.exists(path) else []

    def _folders(self, version: int | None) -> tuple[int, dict[str, str]]:
        """Number and bucket folders of a version, the newest by default; 0 and none before the first."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, {}
        text = self.spark.read.text(f"{self.folder}/versions/{version:09d}", wholetext=True).first()[0]
        return version, json.loads(text)

    def _commit(self, version: int, folders: dict[str, str]) -> int:
        store, path = self._path(f"versions/{version:09d}")
        try:
            out = store.create(path, False)
        except Exception as e:
            if "exist" in str(e):
                raise Conflict(f"version {version} is there already") from None
            raise
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        return version

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{f}" for f in sorted(folders)))

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        return self._read(list(self._folders(version)[1].values()))

    def load(self, key, version: int | None = None) -> DataFrame:
        """The row of a key, from its bucket alone."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(key).cast(self.schema[self.key].dataType))).first()[0]
        folder = self._folders(version)[1].get(str(bucket))
        return self._read([folder] if folder else []).where(F.col(self.key) == F.lit(key))

    def _change(self, keys: DataFrame, new: Callable[[DataFrame], DataFrame], base: int | None) -> int:
        """The next version, with ``new`` of the rows of all buckets that ``keys`` fall into.

        ``base``: the version that the change was made for, if it isn't the newest."""
        now, folders = self._folders(base)
        touched = [str(r[0]) for r in keys.select(self._bucket(F.col(self.key))).distinct().collect()]
        old = self._read([folders[b] for b in touched if b in folders])
        made = f"data/{uuid.uuid4().hex}"
        out = new(old).select(*self.schema.names).withColumn("_bucket", self._bucket(F.col(self.key)))
        # one folder of a few files for each bucket: rows of a bucket are dealt to a task
        out.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{made}")
        store, path = self._path(made)
        there = {f.getPath().getName().removeprefix("_bucket="): f.getPath().getName() for f in store.listStatus(path) if f.isDirectory()}
        kept = {b: f for b, f in folders.items() if b not in touched}
        return self._commit(now + 1, kept | {b: f"{made}/{f}" for b, f in there.items()})

    def save(self, rows: DataFrame, base: int | None = None) -> int:
        """Creates rows, or replaces those of equal key."""
        return self._change(rows, lambda old: sinks.upserted(old, rows.select(*self.schema.names), self.key), base)

    def copy(self, rows: DataFrame, new_key: str, base: int | None = None, **changes: Column) -> int:
        """Copies of the rows whose keys ``rows`` has, under its column ``new_key`` and with the given columns changed."""
        pairs = rows.select(F.col(self.key).alias("_from"), F.col(new_key).alias("_to"))
        found = self.rows(base).join(pairs, F.col(self.key) == F.col("_from")).withColumns(changes).withColumn(self.key, F.col("_to"))
        return self.save(found.select(*self.schema.names), base)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        return self._change(keys, lambda old: sinks.deleted(old, keys, self.key), base)

    def touch(self, keys: DataFrame, stamp: str, at: Column, base: int | None = None) -> int:
        return self._change(keys, lambda old: sinks.touched(old, keys, self.key, stamp, at), base)

    def vacuum(self) -> None:
        """Removes the files that the newest version doesn't name, and all versions before it."""
        now, folders = self._folders(None)
        store, path = self._path("data")
        used = {f.split("/")[1] for f in folders.values()}
        for f in store.listStatus(path) if store.exists(path) else []:
            if f.getPath().getName() not in used:
                store.delete(f.getPath(), True)
        for v in self.versions():
            if v != now:
                store.delete(self._path(f"versions/{v:09d}")[1], False)
