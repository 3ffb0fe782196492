"""The run driver: a sweep that was killed half-way and started again gives the table of one that wasn't."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings
from corpusloom.plans import runs

CASES = [(f"c{k}", f"question {k}", "lookup", "simple", [f"d{k}", "d0"] if k % 3 else []) for k in range(20)]
SCHEMA = "case_id string, question string, kind string, expected_route string, gold array<string>"


def model(asked, fail_at=None):
    def ask(questions, system):
        if len(asked) == fail_at:
            raise RuntimeError("killed")
        asked.append((system, sorted(r.query_id for r in questions.collect())))
        docs = F.array(F.concat(F.lit("d"), F.substring("query_id", 2, 9)), F.lit("x"))
        none = F.array().cast("array<string>")
        return questions.select("query_id", F.when(F.col("query_id") == "c3", "abstained").otherwise("answered").alias("outcome"), F.lit("en").alias("language"), docs.alias("retrieved_documents"), docs.alias("accepted_documents"), (docs if system == "B3" else none).alias("cited_documents"), F.lit(None).cast("string").alias("reason"))

    return ask


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def test_killed_and_resumed(spark, tmp_path):
    cases = spark.createDataFrame(CASES, SCHEMA)
    whole, asked = [], []
    want = rows(runs.sweep(cases, ["B0", "B3"], model(whole), str(tmp_path / "a"), "f1", 4))
    assert len(want) == 40
    with pytest.raises(RuntimeError):
        runs.sweep(cases, ["B0", "B3"], model(asked, 5), str(tmp_path / "b"), "f1", 4)
    assert len(asked) == 5
    assert rows(runs.sweep(cases, ["B0", "B3"], model(asked), str(tmp_path / "b"), "f1", 4)) == want
    assert sorted(asked) == sorted(whole)  # nothing was asked twice
    again = []
    assert rows(runs.sweep(cases, ["B0", "B3"], model(again), str(tmp_path / "b"), "f1", 4)) == want and not again
    more = cases.union(spark.createDataFrame([("new", "q", "lookup", "simple", ["dew"])], SCHEMA))
    got = runs.sweep(more, ["B0"], model(again), str(tmp_path / "b"), "f1", 4)
    assert len(again) == 1 and got.count() == 41  # the unit of the new case, whole
    assert runs.sweep(cases, ["B0"], model(again), str(tmp_path / "b"), "f2", 4).count() == 20 and rows(runs.sweep(cases, ["B0", "B3"], model([]), str(tmp_path / "b"), "f1", 4).where("case_id <> 'new'")) == want


def test_measures(spark, tmp_path):
    got = {r.case_id: r for r in runs.sweep(spark.createDataFrame(CASES, SCHEMA), ["B3"], model([]), str(tmp_path), "f", 1).collect()}
    assert got["c1"].union_recall == 0.5 and got["c1"].citation_recall == 0.5 and got["c3"].union_recall is None and got["c3"].outcome == "abstained"
    assert runs.sweep(spark.createDataFrame([], SCHEMA), ["B3"], model([]), str(tmp_path / "none"), "f", 1).count() == 0


def test_fingerprint():
    i = postings.Index(None, None, 5, 2.5, 8)
    assert runs.fingerprint(i, top_k=10) == runs.fingerprint(i, top_k=10) != runs.fingerprint(i, top_k=9) != runs.fingerprint(postings.Index(None, None, 6, 2.5, 8), top_k=9)
