"""The test tables in the roles that the operators need. Derived columns are the same expressions for Spark and
for the SQL that results are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import cells, retrieval
from corpusloom.sources import tables

DOCS = {
    "doc_id": "doc_id",
    "volume_id": "source",
    "document_id": "concat('d', CAST(doc_id AS STRING))",
    "document": "concat(source, ':d', CAST(doc_id AS STRING))",
    "subtype": "CASE WHEN lang = 'en' THEN 'historical-document' ELSE 'editorial-note' END",
    "lang": "lang",
    "date_from": "CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(CAST(1900 + doc_id % 80 AS STRING), '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) END",
    "date_to": "CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat(CAST(1900 + doc_id % 80 + doc_id % 3 AS STRING), '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) END",
    "head": "split_part(text, '\n', 1)",
    "text": "text",
}

ROUTES = ["simple", "lookup", "timeline", "complex", "status"]
_ROUTE = "CASE {} WHEN 0 THEN 'simple' WHEN 1 THEN 'lookup' WHEN 2 THEN 'timeline' WHEN 3 THEN 'complex' ELSE 'status' END"

RUNS = {
    "run_id": "event_id",
    "case_id": "concat('c', CAST(user_id % 40 AS STRING))",
    "system": "CASE WHEN event_type = 'click' THEN 'B0' WHEN event_type = 'view' THEN 'B1' WHEN event_type = 'purchase' THEN 'B2' ELSE 'B3' END",
    "language": "CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'zh' END",
    "kind": "CASE user_id % 5 WHEN 0 THEN 'lookup' WHEN 1 THEN 'multihop' WHEN 2 THEN 'correction' WHEN 3 THEN 'correction_matched' ELSE 'unanswerable' END",
    "answerable": "user_id % 5 <> 4",
    "outcome": "CASE WHEN event_id % 13 = 0 THEN 'error' WHEN event_id % 4 = 0 THEN 'abstained' ELSE 'answered' END",
    "expected_route": _ROUTE.format("user_id % 5"),
    "actual_route": "CASE WHEN event_id % 3 = 0 THEN " + _ROUTE.format("event_id % 5") + " ELSE " + _ROUTE.format("user_id % 5") + " END",
    "intent": "concat('i', CAST(user_id % 25 AS STRING))",
    "union_recall": "CASE WHEN user_id % 5 <> 4 THEN CAST(event_id % 5 AS DOUBLE) / 4.0E0 END",
    "accepted_recall": "CASE WHEN user_id % 5 <> 4 THEN CAST(event_id % 4 AS DOUBLE) / 4.0E0 END",
    "citation_recall": "CASE WHEN user_id % 5 <> 4 THEN CAST(event_id % 3 AS DOUBLE) / 4.0E0 END",
    "judge_score": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 9 AS DOUBLE) / 8.0E0 END",
    "llm_calls": "event_id % 5",
    "retrieval_calls": "1 + event_id % 3",
    "latency_s": "value",
    "mode": "CASE WHEN event_id % 6 = 0 THEN 'partial' ELSE 'hybrid' END",
}

#: A volume's record, from its documents.
MANIFEST = "SELECT volume_id, concat('Volume ', volume_id) AS title, concat('Series ', substring(volume_id, 4, 1)) AS sub_series, CASE WHEN volume_id IN ('src3', 'src7') THEN 'planned' ELSE 'published' END AS status, CAST(count(*) AS BIGINT) AS n_documents, CAST(sum(CASE WHEN subtype = 'historical-document' THEN 1 ELSE 0 END) AS BIGINT) AS n_historical FROM docs GROUP BY volume_id"

#: Eight words of each benchmark passage, and the documents that hold the whole passage.
QUERY_WORDS = 8


_indexes: dict[tuple, retrieval.Index | cells.Cells] = {}


def _shared(spark: SparkSession, sf_dir: str, name: str, kind: str, make):
    """What is made of a table's files when it is first asked for, and shared by all queries of the application on the same files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    known = (spark.sparkContext.applicationId, sf_dir, kind, status.getModificationTime(), status.getLen())
    if known not in _indexes:
        _indexes[known] = make(tables.scratch(spark, kind))
    return _indexes[known]


def index(spark: SparkSession, sf_dir: str, field: str) -> retrieval.Index:
    """The lexical index of a field of the documents."""
    return _shared(spark, sf_dir, "documents", f"index-{field}", lambda path: retrieval.write_index(docs(spark, sf_dir), path, field))


def vector_cells(spark: SparkSession, sf_dir: str) -> cells.Cells:
    """The inverted file of the vectors."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS vector")
    return _shared(spark, sf_dir, "embeddings", "cells", lambda path: cells.write_cells(rows, path))


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {n}" for n, e in DOCS.items()))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} AS {n}" for n, e in RUNS.items()))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MANIFEST.replace("FROM docs", "FROM {docs}"), docs=docs(spark, sf_dir))


SQL_DOCS = f"docs AS (SELECT {_columns(DOCS)} FROM documents)"
SQL_RUNS = f"runs AS (SELECT {_columns(RUNS)} FROM events)"
SQL_MANIFEST = f"manifest AS ({MANIFEST})"
SQL_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
