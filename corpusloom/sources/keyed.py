"""A table that is upserted by key, of which only the buckets with touched keys are written anew (B-4).

    data/<version>-<id>/bucket=b   the rows whose key hashes to b, as they were written in that version
    versions/<version>.parquet     where each bucket's rows are, and the number of buckets

A version is one small Parquet file, moved to its name when its data is complete; where moving to a name that exists fails, as on HDFS, of two writers that
began from the same version one is told to start again, and nothing is overwritten. (A store without such a move needs one writer at a time.) A reader opens the newest version and goes on
reading its files whatever is written meanwhile. Old versions' data stays until `vacuum`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made this version."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        at, fs = self._files(f"{self.path}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n.removesuffix(".parquet")) for n in names if n.removesuffix(".parquet").isdigit()), default=0)

    def _places(self, version: int) -> dict[int, str]:
        """Where each bucket's rows are: a row for each of `buckets` at most."""
        if not version:
            return {}
        return {r.bucket: r.place for r in self.spark.read.schema("bucket int, place string, buckets int").parquet(f"{self.path}/versions/{version}.parquet").collect()}

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, places: dict[int, str], schema) -> DataFrame:
        paths = sorted({f"{self.path}/data/{place}/bucket={b}" for b, place in places.items()})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default. schema: of the rows."""
        return self._read(self._places(self.version() if version is None else version), schema)

    def upsert(self, changes: DataFrame) -> int:
        """Rows of equal key replaced, new ones added; the last version's number. changes: one row a key; a null key is a key."""
        before = self.version()
        places = self._places(before)
        dealt = changes.withColumn("bucket", self._bucket())
        touched = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())  # `buckets` numbers at most
        if not touched:
            return before
        held = self._read({b: p for b, p in places.items() if b in set(touched)}, changes.schema)
        same = held[self.key].eqNullSafe(F.col("__key"))
        rest = held.join(changes.select(F.col(self.key).alias("__key")), same, "left_anti")
        place = f"{before + 1}-{uuid.uuid4().hex[:12]}"
        rows = rest.withColumn("bucket", self._bucket()).unionByName(dealt)
        rows.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{place}")
        now = places | dict.fromkeys(touched, place)
        staged = f"{self.path}/staged/{place}"
        self.spark.createDataFrame([(b, p, self.buckets) for b, p in sorted(now.items())], "bucket int, place string, buckets int").coalesce(1).write.parquet(staged)
        folder, fs = self._files(staged)
        source = next(x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
        target, _ = self._files(f"{self.path}/versions/{before + 1}.parquet")
        fs.mkdirs(target.getParent())
        moved = not fs.exists(target) and fs.rename(source, target)
        fs.delete(folder, True)
        if not moved:
            fs.delete(self._files(f"{self.path}/data/{place}")[0], True)
            raise Conflict(f"version {before + 1} of {self.path} was written by another")
        return before + 1

    def vacuum(self) -> None:
        """Drops data that the newest version doesn't refer to, and the versions before it."""
        newest = self.version()
        used = set(self._places(newest).values())
        at, fs = self._files(f"{self.path}/data")
        for x in fs.listStatus(at) if fs.exists(at) else []:
            if x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)
        at, _ = self._files(f"{self.path}/versions")
        for x in fs.listStatus(at) if fs.exists(at) else []:
            if x.getPath().getName() != f"{newest}.parquet":
                fs.delete(x.getPath(), True)
