"""Tables in and out: Parquet, JSON lines, keyed upserts, column replacement, resume."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below this application's own part of the shared folder that the cluster names in spark.checkpoint.dir. Only
    in local mode a temporary folder stands in where that isn't set. What is below goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            local = tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            base = f"file://{local}"
        else:
            atexit.register(_forget, spark, app)
        _scratch[app] = f"{base.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
    return f"{_scratch[app]}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, app: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop(app))
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have ended before
        pass


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and what uses it twice doesn't run it twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """Zstandard Parquet, by partition if asked (B-1, B-3). The commit protocol makes it all or nothing."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that df has (B-2, B-5)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; an empty input is an error (A-15)."""
    df = spark.read.schema(schema).json(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_variants(spark: SparkSession, glob: str, schema: str, pattern: str) -> DataFrame:
    """Many JSON files with the variant that each file's path names (A-18)."""
    return spark.read.schema(schema).json(glob).withColumn("variant", F.regexp_extract(F.input_file_name(), pattern, 1))


def row_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.count("*").alias("n"))  # A-12: from footers alone, as no column is read


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with rows of equal key replaced and new ones added (B-4)."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes)


def replace_columns(df: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with columns taken from `new` where it has the key (B-5)."""
    n = new.select(key, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__new"))
    return df.join(n, key, "left").withColumns({c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def todo(all_rows: DataFrame, done: DataFrame, keys: list[str], fingerprint: tuple[str, str] | None = None) -> DataFrame:
    """Rows not done yet; with a fingerprint (column, value) only what was done under it counts (B-2, B-6, B-7, JN-E, JN-F)."""
    if fingerprint:
        done = done.where(F.col(fingerprint[0]) == fingerprint[1])
    return all_rows.join(done.select(*keys).distinct(), keys, "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file (B-8)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def trace(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Events with their payloads cut to the sizes that a trace may hold (B-9)."""
    return df.withColumns({c: F.substring(c, 1, n) for c, n in limits.items()})
