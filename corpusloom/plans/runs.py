"""The run driver: cases by systems through the loop, into a table that a crash leaves whole (N-15).

The table is partitioned by the retriever's fingerprint, the system and a unit, which is a share of the cases by a hash of their id. A
unit is one plan for all its cases and one write, which replaces the unit's partition or leaves it alone. A unit
that has all its cases is not run again, one that lacks any is run and written whole; so a sweep that was killed goes on
where it was when it is started again, and gives the same table. Other settings of the retriever have another fingerprint and
touch nothing of what was there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import postings

KEYS = ["fingerprint", "system", "unit"]


def fingerprint(index: postings.Index, **settings: object) -> str:
    """Sixteen hex digits of what a retriever's results depend on: its index's size and its settings."""
    said = json.dumps({"documents": index.n, "length": round(index.avgdl, 6), **settings}, sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def _recall(gold: Column, got: Column) -> Column:
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, got)) / F.size(F.array_distinct(gold)))


def measured(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """A row a case: outcome, and how much of the gold was retrieved, accepted and cited. cases: case_id, question, kind, expected_route, gold;
    answers: those of agent.ask, with query_id for case_id."""
    rows = cases.join(answers.withColumnRenamed("query_id", "case_id"), "case_id")
    gold = F.col("gold")
    return rows.select(
        "case_id", "kind", "language", "expected_route", "outcome", "reason", F.size("retrieved_documents").alias("n_retrieved"), F.size("cited_documents").alias("n_cited"),
        *(_recall(gold, F.col(f"{c}_documents")).alias(n) for c, n in (("retrieved", "union_recall"), ("accepted", "accepted_recall"), ("cited", "citation_recall"))),
    )


def done(spark: SparkSession, path: str) -> DataFrame | None:
    """What was written before; None if nothing was."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def sweep(cases: DataFrame, systems: list[str], ask: Callable[[DataFrame, str], DataFrame], path: str, mark: str, units: int = 8) -> DataFrame:
    """Runs what is missing of cases x systems and returns the runs of this fingerprint. cases: case_id, question and what `measured` takes; ask: (questions
    (query_id, question), system) -> answers. A driver-side loop over systems and units, each a plan of its own."""
    spark = cases.sparkSession
    cases = cases.withColumn("unit", F.pmod(F.xxhash64(F.col("case_id").cast("string")), F.lit(units)).cast("int"))
    for system in systems:
        before = done(spark, path)
        lacking = cases
        if before is not None:
            held = before.where((F.col("fingerprint") == mark) & (F.col("system") == system)).select("case_id")
            lacking = cases.join(held, "case_id", "left_anti")
        for unit in sorted(r.unit for r in lacking.select("unit").distinct().collect()):  # `units` numbers at most
            mine = cases.where(F.col("unit") == unit)
            answers = ask(mine.select(F.col("case_id").alias("query_id"), "question"), system)
            rows = measured(mine, answers).withColumns({"fingerprint": F.lit(mark), "system": F.lit(system), "unit": F.lit(unit)})
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)
    found = done(spark, path)
    return cases.sparkSession.createDataFrame([], "case_id string") if found is None else found.where(F.col("fingerprint") == mark)
