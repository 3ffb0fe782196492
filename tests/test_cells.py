"""The inverted file: recall against the exact ranking, files read, reopening, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cells, retrieval


def made(n, dim, seed, clusters):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, dim))
    return [(int(k), [float(c) for c in v]) for k, v in enumerate(centres[r.integers(0, clusters, n)] + 0.3 * r.standard_normal((n, dim)))]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [*made(3000, 18, 1, 40), (5000, None), (5001, [0.0] * 18), (5002, [1.0] * 7), (5003, [float("nan")] * 18), (5004, [None, *[1.0] * 17]), (None, [1.0] * 18)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    at = str(tmp_path_factory.mktemp("cells"))
    cells.write_cells(df, at)
    return df, at


def recall(got, true):
    return sum(len(got.get(q, set()) & t) for q, t in true.items()) / sum(map(len, true.values()))


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add(r.id)
    return out


def test_recall_and_files(spark, index):
    df, at = index
    opened = cells.read_cells(spark, at)  # nothing but the path
    assert opened.rows == 3000 == opened.codes.count() == opened.vectors.select("id").distinct().count() and len(opened.centroids) == 54
    queries = df.where("id % 100 = 0 and id < 3000").select(F.col("id").alias("query_id"), F.col("vector").alias("q_vector"))
    exact = retrieval.dense(queries, df.where("id is not null"), 10)
    true = sets(exact)
    got = cells.search(queries, opened, 8, 10)
    assert recall(sets(got), true) >= 0.9
    score = {(r.query_id, r.id): r.score for r in exact.collect()}
    assert all(abs(score[r.query_id, r.id] - r.score) < 2e-6 for r in got.collect() if (r.query_id, r.id) in score)
    assert recall(sets(cells.search(queries, opened, 54, 10, refine=300)), true) == 1.0  # every cell, every candidate
    one = queries.limit(1)
    files = lambda n: opened.codes.where(F.col("cell").isin(sorted(r[0] for r in one.mapInArrow(cells._probed(opened, n), "query_id long, q binary, cells array<int>").select(F.explode("cells")).collect()))).select(F.input_file_name()).distinct().count()
    assert files(1) < files(6) < files(54)
    plan = cells.search(one, opened, 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_odd(spark, tmp_path, index):
    _, at = index
    opened = cells.read_cells(spark, at)
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 18), (3, [1.0] * 5)], "query_id long, q_vector array<double>")
    assert cells.search(odd, opened, 3, 10).count() == 0
    none = cells.write_cells(spark.createDataFrame([(1, None)], "id long, vector array<double>"), str(tmp_path / "none"))
    assert none.rows == 0 and cells.search(odd, none, 3, 10).count() == 0
    few = cells.write_cells(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 2.0])], "id string, vector array<float>"), str(tmp_path / "few"))
    got = cells.search(spark.createDataFrame([("q", [3.0, 0.1])], "query_id string, q_vector array<double>"), few, 9, 2).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b"]
