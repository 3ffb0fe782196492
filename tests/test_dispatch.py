"""The dispatcher's tools and the full loop over a small collection."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans import agent, dispatch

DOCS = [
    ("src1", "d1", 0, "historical-document", "1950-01-01", "1950-02-01", "alpha beta gamma treaty"), ("src1", "d1", 1, "historical-document", "1950-01-01", "1950-02-01", "second part of it"),
    ("src1", "d2", 0, "historical-document", "1960-05-01", "1960-05-02", "alpha treaty signed"), ("src2", "d1", 0, "historical-document", "", "", "alpha undated paper"),
    ("src2", "d2", 0, "editorial-note", "1955-01-01", "1955-01-01", "alpha note by editors"), ("src3", "d9", 0, "historical-document", "1970-01-01", "1970-01-01", "delta epsilon"),
]
HOPS = "query_id long, hop string, query string, route string, volumes array<string>, q_from string, q_to string"


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    rows = spark.createDataFrame([(f"{v}:{d}:{o}", v, d, o, *r) for v, d, o, *r in DOCS], "id string, volume_id string, document_id string, ordinal int, subtype string, date_from string, date_to string, text string")
    index = retrieval.write_index(rows, str(tmp_path_factory.mktemp("chunks")), id_col="id")
    manifest = spark.createDataFrame([("src1", "One", "A", "published"), ("src2", "Two", "A", "planned"), ("src3", "Three", "B", "published")], "volume_id string, title string, sub_series string, status string")
    return lambda **k: dispatch.Dispatcher(lambda q, a, n: retrieval.bm25(q, index, n, a), rows, manifest, **k)


def by_hop(df):
    out = {}
    for r in df.orderBy("query_id", "hop", "rank").collect():
        out.setdefault((r.query_id, r.hop), []).append((r.id, r.tool, r.relaxed))
    return out


def test_tools_by_route(spark, tools):
    hops = [
        (1, "h0", "Show src1 document 1", "lookup", None, None, None), (2, "h0", "Show src1 document 77 alpha", "lookup", None, None, None), (3, "h0", "alpha", "timeline", None, "1940-01-01", "1965-01-01"),
        (4, "h0", "alpha", "simple", ["src3"], None, None), (5, "h0", "alpha", "simple", ["src2", "src2"], None, None), (6, "h0", "Is src2 or src1 published", "status", None, None, None),
        (7, "h0", "zeta", "simple", None, None, None), (8, "h0", "alpha treaty", "complex", None, None, "1955-01-01"), (8, "h1", "delta", "complex", None, None, None),
    ]
    d = tools(top_k=2, per_hop=3)
    hops = spark.createDataFrame(hops, HOPS)
    got = by_hop(d(hops))
    assert got[1, "h0"] == [("src1:d1:0", "lookup_document", False), ("src1:d1:1", "lookup_document", False)]
    assert {t for _, t, _ in got[2, "h0"]} == {"hybrid_search"} and len(got[2, "h0"]) == 2
    assert got[3, "h0"] == [("src1:d1:0", "timeline_search", False), ("src1:d2:0", "timeline_search", False)]  # undated rows fall to a lower bound
    assert [r for _, _, r in got[4, "h0"]] == [True, True]
    assert got[5, "h0"] == [("src2:d1:0", "hybrid_search", False)]  # the editors' note can't be cited
    assert (6, "h0") not in got and (7, "h0") not in got
    assert {i for i, _, _ in got[8, "h0"]} == {"src1:d1:0", "src2:d1:0"} and got[8, "h1"] == [("src3:d9:0", "hybrid_search", False)]
    assert sorted(map(tuple, d.status(hops).collect())) == [(6, "src1", "published"), (6, "src2", "planned")]


def test_withheld(spark, tools):
    gone = spark.createDataFrame([("src1", "d1")], "volume_id string, document_id string")
    got = by_hop(tools(withheld=gone)(spark.createDataFrame([(1, "h0", "Show src1 document 1 alpha", "lookup", None, None, None)], HOPS)))
    assert {i for i, _, _ in got[1, "h0"]} == {"src1:d2:0", "src2:d1:0"}


def test_union_is_reranked_against_the_question(spark, tools):
    hops = spark.createDataFrame([(1, "h0"), (1, "h1"), (2, "h0")], "query_id long, hop string")
    merged = spark.createDataFrame([(q, i, "h0", 1.0, k) for q in (1, 2) for k, i in enumerate(["src2:d1:0", "src1:d2:0", "src1:d1:0", "src3:d9:0"], 1)], "query_id long, id string, hop string, score double, position long")
    asked = spark.createDataFrame([(1, "alpha beta gamma treaty"), (2, "delta")], "query_id long, question string")
    rows = dispatch.reranked(merged, hops, asked, tools().passages, top_k=3, union=2).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.id) for r in rows] == [(1, "src1:d1:0"), (1, "src1:d2:0"), *((2, i) for i in ("src2:d1:0", "src1:d2:0", "src1:d1:0", "src3:d9:0"))]


def test_neighbours_and_focus(spark, tools):
    one = spark.createDataFrame([(1, "src1:d1:0", "h0", 2.0, 1), (1, "src1:d2:0", "h0", 1.0, 2)], "query_id long, id string, hop string, score double, position long")
    assert [r.id for r in dispatch.expanded(one, tools().passages).orderBy("position").collect()] == ["src1:d1:0", "src1:d1:1", "src1:d2:0"]
    long = " ".join(f"Sentence {k} says {'alpha' if k == 12 else 'nothing'} and fills up some room." for k in range(30))
    rows = spark.createDataFrame([(1, "a", 1, long), (1, "b", 2, "Short. Text.")], "query_id long, id string, position long, text string")
    got = {r.id: r.text for r in dispatch.focused(rows, spark.createDataFrame([(1, "alpha")], "query_id long, question string")).collect()}
    assert "Sentence 12 says alpha" in got["a"] and "Sentence 11" in got["a"] and len(got["a"]) < len(long) / 2 and got["b"] == "Short. Text."


def test_loop_by_system(spark, tools):
    asked = spark.createDataFrame([(1, "alpha treaty"), (2, "Is src1 published alpha"), (3, "沒有 zeta"), (4, "Show src1 document 2")], "query_id long, question string")
    d = tools()

    def quote(window):
        return window.groupBy("query_id").agg(F.max_by("text", "score").alias("text")).select("query_id", F.lit(0).alias("claim"), F.coalesce("text", F.lit("alpha treaty")).alias("text"), F.array(F.lit("src9:d9:9")).alias("ids"), F.lit("few sources").alias("limitations"))

    got = {n: {r.query_id: r for r in agent.ask(asked, d, quote, d.manifest, agent.SYSTEMS[n], None if "B0" in n else -20.0).collect()} for n in ("B0", "B0-2step", "B3")}
    assert got["B0"][1].outcome == "answered" and got["B0"][1].cited_documents and "src9:d9" not in got["B0"][1].cited_documents  # the model's ids are discarded
    assert got["B0"][2].retrieved_documents == [] and len(got["B0-2step"][2].retrieved_documents) == 3  # status has no passages; the fixed pipeline searches all the same
    assert got["B0"][4].retrieved_documents == ["src1:d2"] and len(got["B0-2step"][4].retrieved_documents) == 0
    assert got["B3"][3].outcome == "abstained" and got["B3"][3].language == "zh-TW" and got["B3"][3].answer_text == agent.ABSTAINED["zh-TW"] and got["B3"][3].limitations == ""
    assert got["B3"][1].limitations == "few sources" and set(got["B3"][1].cited_documents) <= set(got["B3"][1].accepted_documents) <= set(got["B3"][1].retrieved_documents)
