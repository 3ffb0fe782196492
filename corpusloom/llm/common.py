"""Shared pieces of the training-data operators: tables, the shared scratch folder, prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scratch: dict[str, str] = {}
_kept: list[str] = []  # scratch tables, in the order they were made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; opened by Spark's reader only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir, which all executors share.

    Where that setting is absent (tests, local mode) a temporary folder is made.
    The folder goes when the driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        _scratch[app] = f"{base.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, app)
    return _scratch[app]


def _forget(spark: SparkSession, app: str) -> None:
    path = _scratch.pop(app, None)
    try:
        if path and spark.sparkContext._jsc is not None:
            drop(spark, path)
    except Exception:  # the JVM may have ended before
        pass


def kept_now() -> list[str]:
    """The scratch tables that there are."""
    return list(_kept)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        if path in _kept:
            _kept.remove(path)
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage.

    A lost executor costs at most the tasks it was running: what has been written
    is in the shared store. Returns the table and its path (for drop()).
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _kept.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(totals: dict[int, int]) -> dict[int, int]:
    """Exclusive prefix sums over partition numbers (a few bytes for each partition)."""
    out, total = {}, 0
    for k in sorted(totals):
        out[k], total = total, total + totals[k]
    return out


def text_bytes(name: str = "text"):
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def row_of(docs: DataFrame) -> Column:
    """All of a row's columns as one struct, so that no name an operator needs beside it can clash with theirs."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


_remembering: weakref.WeakSet = weakref.WeakSet()


def remembering(tool) -> None:
    """Has `alone` know a tool that remembers results; tool.forget() empties it."""
    _remembering.add(tool)


def alone(*mine) -> None:
    """Empties what the tools of other operators that this Python worker has served remember, and returns their memory
    to the system: workers outlive a stage, and an executor has as many as it has cores."""
    others = [x for x in _remembering if all(x is not m for m in mine)]
    for x in others:
        x.forget()
    if others:
        trim()


def trim() -> None:
    """Returns freed memory to the system where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
    pa.default_memory_pool().release_unused()


class Remembered:
    """Results (binary columns) by binary key, in Arrow columns: no Python object for a key that is known.

    When more than `size` keys are remembered, only those asked for last stay; keys over `longest` bytes aren't remembered.
    """

    def __init__(self, columns: int, size: int = 1_500_000, longest: int = 64):
        self.width, self.size, self.longest = columns, size, longest
        self.forget()
        remembering(self)

    def forget(self) -> None:
        self.keys = pa.array([], pa.binary())
        self.columns = [self.keys] * self.width

    def values(self, keys: pa.Array, make) -> list[pa.Array]:
        """The columns for different keys; make(keys not remembered) gives theirs."""
        where = pc.index_in(keys, value_set=self.keys)
        new = keys.filter(where.is_null())
        made = make(new)
        place = where.to_numpy(zero_copy_only=False).astype(np.float64)
        place[np.isnan(place)] = len(self.keys) + np.arange(len(new))
        place = pa.array(place.astype(np.int64))
        out = [pa.concat_arrays([c, m]).take(place) for c, m in zip(self.columns, made, strict=True)]
        if len(self.keys) + len(new) <= self.size:
            short = pc.less_equal(pc.binary_length(new), self.longest)
            self.keys = pa.concat_arrays([self.keys, new.filter(short)])
            self.columns = [pa.concat_arrays([c, m.filter(short)]) for c, m in zip(self.columns, made, strict=True)]
        else:
            short = pc.less_equal(pc.binary_length(keys), self.longest)
            self.keys, self.columns = keys.filter(short), [c.filter(short) for c in out]
        pa.default_memory_pool().release_unused()  # what the columns held before
        return out


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes, and where each value starts in them (one more entry at the end)."""
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int32)
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def binary(offsets: np.ndarray, data) -> pa.Array:
    """A binary column of what lies between the offsets."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def utf8(column: pa.Array) -> pa.Array:
    """The column's bytes; what isn't UTF-8 in them is replaced."""
    try:
        column.cast(pa.string())
        return column
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace").encode() for x in column.to_pylist()], pa.binary())


def in_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows that have the same keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(c).to_numpy() for c in by])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if held and tuple(keys[s]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = tuple(keys[s])
    if held:
        yield pa.Table.from_batches(held)
