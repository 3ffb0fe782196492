"""Resumable ingestion as a file stream: what a checkpoint has seen isn't processed again (B-2, B-6, B-7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_at_once: int = 20) -> None:
    """Processes all files of `source` that are new to the checkpoint, `files_at_once` in a batch, and ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
