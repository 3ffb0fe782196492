"""All queries of this library but the training-data ones, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import catalog_eval, catalog_probes, catalog_rank, catalog_text


def wide(df: DataFrame) -> DataFrame:
    """Integers as long and floats as double, so that results have the types of SQL's."""
    casts = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
    return df.select(*(F.col(f"`{c}`").cast(casts[t]).alias(c) if t in casts else F.col(f"`{c}`") for c, t in df.dtypes))


def all_queries() -> dict:
    return catalog_rank.Q | catalog_text.Q | catalog_eval.Q | catalog_probes.Q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: (lambda s, d, f=f: wide(f(s, d))) for n, (f, _) in all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in all_queries().items() if sql is not None}
