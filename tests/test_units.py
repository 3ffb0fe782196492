import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import chunks, cite, evaluate, filters, retrieval, select
from corpusloom.plans import agent, catalog, plugs
from corpusloom.sources import pages, tables, volumes
from corpusloom.streaming import ingest

XML = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:xml="http://www.w3.org/XML/1998/namespace" xml:id="vol1x">
<teiHeader><title type="complete">Papers,  Volume I</title><title type="volume">Volume I</title><title type="sub-series">Papers</title>
<editor>A. Editor</editor><editor> </editor><idno type="isbn">1</idno><idno type="series">vol1</idno><date type="publication-date">1950</date><date type="content-date" notBefore="1940-01-01T00:00" notAfter="1941-12-31"/></teiHeader>
<text><body>
<div type="document" subtype="historical-document" xml:id="d1" n="1" doc-dateTime-min="1940-02-03T00:00:00" doc-dateTime-max="1940-02-04T00:00:00">
<head>1. A <persName>Mr. Head</persName> note<note type="source">Source: file 5.</note></head><opener><dateline>Paris, <date when="1940-02-03">3 February</date></dateline></opener>
<p>One<!-- hidden --> and<note>foot <persName>Hidden</persName></note> two <pb/>three with <persName>Jean  Monnet</persName> and <persName>Jean Monnet</persName>.</p>
<p>Last; see <ref target="#d2">2</ref> and <ref target="#d1">1</ref>.</p></div>
<div type="document" subtype="editorial-note" xml:id="d2"><head>Note</head><p>Editorial.</p></div>
<div type="document" subtype="historical-document" xml:id="d3"><head>Empty</head></div>
</body></text></TEI>"""
STUB = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title type="complete">Planned</title></teiHeader><text><body/></text></TEI>'


@pytest.fixture(scope="module")
def xml(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("xml")
    (d / "b.xml").write_text(XML)
    (d / "planned.xml").write_text(STUB)
    return volumes.files(spark, str(d))


def test_manifest(xml):
    rows = {r.volume_id: r for r in volumes.scan_manifest(xml).collect()}
    v = rows["vol1"]
    assert (v.title, v.title_volume, v.editors, v.publication_date) == ("Papers, Volume I", "Volume I", ["A. Editor"], "1950")
    assert (v.content_date_from, v.content_date_to, v.n_documents, v.n_historical, v.status) == ("1940-01-01", "1941-12-31", 3, 2, "published")
    assert rows["planned"].status == "planned" and len(v.sha256) == 64


def test_documents(xml):
    rows = volumes.scan_documents(xml).collect()
    assert [r.document_id for r in rows] == ["d1"]
    d = rows[0]
    assert d.text == "Paris, 3 February One and two three with Jean Monnet and Jean Monnet. Last; see 2 and 1."
    assert (d.head, d.source_note, d.date_display, d.date_from, d.date_to) == ("1. A Mr. Head note", "Source: file 5.", "Paris, 3 February", "1940-02-03", "1940-02-04")
    assert d.persons == ["Mr. Head", "Jean Monnet"]
    assert {r.document_id for r in volumes.scan_documents(xml, True).collect()} == {"d1", "d2"}


def test_references(xml):
    assert volumes.with_references(xml).count() == 1
    assert {(r.document_id, r.target) for r in volumes.references(xml).collect()} == {("d1", "d2"), ("d1", "d1")}


def test_page():
    assert pages.parse("<html><head><title>A &amp; B</title><style>x</style></head><body><nav><ul><li>n</ul></nav><div class=ad>buy <div>now</div></div><p>One<p>two<script>var t='</p>'</script></body>") == ("A & B", "One two")


@pytest.mark.parametrize(
    "given,wanted",
    [
        ("He met Mr. Smith. They talked.", ["He met Mr. Smith.", "They talked."]),
        ("J. Doe went home. Then he slept! Why?", ["J. Doe went home.", "Then he slept!", "Why?"]),
        ("no boundary here", ["no boundary here"]),
        ("First part.\n\nSecond part", ["First part.", "Second part"]),
        ("It ended with No.\n\nFive followed.", ["It ended with No. Five followed."]),
        ("", []),
    ],
)
def test_sentences(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "t string").select(text.sentences(F.col("t"))).first()[0] == wanted


@pytest.mark.parametrize("kept,wanted", [([0, 1], "A. B."), ([0, 3], "A. […] D."), ([4, 0], "A. […] E."), ([], "")])
def test_assemble(spark, kept, wanted):
    df = spark.createDataFrame([(["A.", "B.", "C.", "D.", "E."], kept)], "p array<string>, k array<int>")
    assert df.select(text.assemble(F.col("p"), F.col("k"))).first()[0] == wanted


@pytest.mark.parametrize("n,wanted", [(0, 0), (1, 1), (512, 1), (513, 2), (960, 2), (961, 3), (1408, 3), (1409, 4)])
def test_windows(spark, n, wanted):
    assert spark.range(1).select(chunks.windows(F.lit(n))).first()[0] == wanted


def test_chunks_keep_bytes_and_ordinals(spark):
    body = " ".join(f"w{k}\n" if k % 7 == 0 else f"w{k}" for k in range(100))
    df = spark.createDataFrame([("v", "d", "historical-document", "H", "", "", body)], "volume_id string, document_id string, subtype string, head string, date_from string, date_to string, text string")
    rows = chunks.chunk(df, 40, 10).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == [0, 1, 2] and all(r.text.startswith("H\n\n") and r.text[3:] in body for r in rows)
    with pytest.raises(ValueError):
        chunks.windows(F.lit(1), 10, 10)


def test_filter_values_are_checked():
    with pytest.raises(ValueError):
        filters.Filters(("vol' OR '1'='1",))
    assert filters.Filters().conditions() == []


def test_filters_reach_the_scan(spark, data):
    from corpusloom.plans import inputs

    df = filters.apply(inputs.docs(spark, data), filters.Filters(("src1",))).select("document")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src1)" in plan and "lang" not in plan.partition("ReadSchema")[2]


def test_top_k_is_limited_before_the_shuffle(spark, data):
    plan = catalog.queries()["t1_w1_topk"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def _gate(spark, ids, accepted=("v:d1:0", "v:d2:0", "w:d1:0", "v:d9:0"), body="a claim", manifest=(("v", "published"), ("w", "planned"))):
    claims = spark.createDataFrame([(1, 1, body, list(ids))], "query_id int, claim int, text string, ids array<string>")
    ev = spark.createDataFrame([(1, "v:d1:0", "v", "historical-document"), (1, "v:d2:0", "v", "editorial-note"), (1, "w:d1:0", "w", "historical-document"), (1, "v:d3:0", "v", "historical-document")], "query_id int, id string, volume_id string, subtype string")
    acc = None if accepted is None else spark.createDataFrame([(1, x) for x in accepted], "query_id int, id string")
    man = spark.createDataFrame(list(manifest), "volume_id string, status string")
    checked = cite.cited(claims, ev, acc, man)
    queries = spark.createDataFrame([(1,)], "query_id int")
    return {r.id: r.refusal for r in checked.collect()}, cite.gate(queries, claims, checked).first().blocked, cite.repair(claims, checked).first().ids


def test_gate(spark):
    reasons, blocked, kept = _gate(spark, ["v:d1:0", "nonsense", "v:d7:0", "v:d3:0", "w:d1:0", "v:d2:0"])
    assert reasons == {"v:d1:0": None, "nonsense": "malformed", "v:d7:0": "not retrieved", "v:d3:0": "not accepted", "w:d1:0": "not published", "v:d2:0": "not citable"}
    assert blocked is None and kept == ["v:d1:0"]
    assert _gate(spark, ["nonsense"])[1] == "nothing cited"
    assert _gate(spark, ["v:d1:0"], body="see https://x.org")[1] == "written url"
    assert _gate(spark, ["v:d3:0"], accepted=None)[0] == {"v:d3:0": None}
    assert _gate(spark, ["w:d1:0"], manifest=())[0] == {"w:d1:0": None}


def test_selection_keeps_unscored_and_hops(spark):
    rows = spark.createDataFrame([(1, "a", 1, 1, 9.0), (1, "a", 2, 2, 1.0), (1, "b", 3, 3, 0.5), (1, "b", 4, 4, None)], "query_id int, hop string, id int, position int, score double")
    kept = {r.id for r in select.select_evidence(rows, None, 4.3, min_per_hop=1).where("kept").collect()}
    assert kept == {1, 3, 4}
    assert select.missing_hops(rows, rows.select("query_id", "hop").distinct(), None).count() == 0


def test_ann_recall(spark, data, tmp_path):
    from corpusloom.operators import cells
    from corpusloom.plans.catalog_rank import dense_hits, vector_questions, vectors

    c = cells.write_cells(vectors(spark, data), str(tmp_path / "cells"))
    exact = {(r.query_id, r.id) for r in dense_hits(spark, data, 10).collect()}
    found = {(r.query_id, r.id) for r in cells.search(vector_questions(spark, data), c, max(1, len(c.centroids) * 3 // 4), 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_recall_of_the_registered_ann(spark, data):
    from corpusloom.plans import catalog
    from corpusloom.plans.catalog_rank import dense_hits

    exact = {(r.query_id, r.id) for r in dense_hits(spark, data, 10).collect()}
    found = {(r.query_id, r.id) for r in catalog.queries()["r5_r6_dense_ann"](spark, data).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_plugs(spark):
    df = spark.createDataFrame([("a b", "a"), ("c", None)], "q string, t string")
    score = plugs.pair_scorer(lambda: lambda pairs: [float(len(q)) for q, _ in pairs])
    assert [r[0] for r in df.select(score("q", "t")).collect()] == [3.0, 1.0]
    m = plugs.ScriptedModel(["bad", "good"])
    assert m("?", lambda x: x == "good") == "good" and m.calls == 2 and m("?") is None


@pytest.mark.parametrize("system,missing,accepted,rounds,wanted", [("B2", 1, 1, 0, "rewrite_missing"), ("B2", 1, 1, 2, "synthesize"), ("B2", 0, 0, 0, "abstain"), ("B1", 1, 0, 0, "synthesize"), ("B3", 1, 0, 2, "abstain")])
def test_edges(spark, system, missing, accepted, rounds, wanted):
    st = spark.createDataFrame([(1, missing, accepted, rounds, 0, 0)], "query_id int, n_missing int, n_accepted int, rounds int, corrections int, calls int")
    assert agent.next_step(st, agent.SYSTEMS[system]).first().step == wanted


def test_quantile_definitions_differ(spark):
    df = spark.createDataFrame([(None, float(k)) for k in range(1, 5)] + [("b", 7.0), ("b", None), ("c", None)], "g string, x double")
    at = lambda q: {r.g: (r.near, r.floor) for r in evaluate.values_at(df, ["g"], F.col("x"), {"near": evaluate.nearest_rank(q), "floor": evaluate.floor_rank(q)}).collect()}
    assert at(0.5) == {None: (3.0, 3.0), "b": (7.0, 7.0)}  # 0.5 * 3 = 1.5 rounds to 2; floor(0.5 * 4) = 2
    assert at(0.8)[None] == (3.0, 4.0) and at(0.0)[None] == (1.0, 1.0) and at(1.0)[None] == (4.0, 4.0)


def test_a_cap_leaves_unscored_rows(spark):
    rows = [(1, "h0", k, k, 9.0 - k) for k in range(3)] + [(1, "h0", 10 + k, 10 + k, None) for k in range(5)] + [(1, None, 20 + k, 20 + k, 1.0 + k) for k in range(3)]
    df = spark.createDataFrame(rows, "query_id int, hop string, id int, position int, score double")
    kept = lambda *a, **b: sorted(r.id for r in select.select_evidence(df, *a, **b).where("kept").collect())
    assert kept(None, None, max_per_hop=2) == [0, 1, 10, 11, 12, 13, 14, 21, 22]
    assert kept(None, 1.5, min_per_hop=1) == [0, 1, 10, 11, 12, 13, 14, 22]
    assert kept(8.5, None, min_per_hop=3, max_per_hop=1) == [0, 10, 11, 12, 13, 14, 22]
    assert len(kept(None, None)) == len(rows)


def test_gates_without_measurements(spark):
    df = spark.createDataFrame([(k, "B3", "lookup", True, "answered", "simple", "simple", 1.0, 1.0, 1.0, None, 1, 1, 5.0, f"c{k}") for k in range(4)],
        "run_id int, system string, kind string, answerable boolean, outcome string, expected_route string, actual_route string, union_recall double, accepted_recall double, citation_recall double, judge_score double, llm_calls int, retrieval_calls int, latency_s double, case_id string")
    got = {r.gate: r.passed for r in evaluate.gates(df, "B0", "B3").collect()}
    assert got == {"1 multihop recall gain": False, "1 correctness gain": False, "1 retrieval budget": None, "2 route macro f1": True, "2 over-decomposed": True, "3 answers to the unanswerable": True, "4 citation recall": None, "5 latency": True}


def test_chunks_by_a_tokenizers_spans(spark):
    df = spark.createDataFrame([("v", "d1", "s", None, "", "", "abcdefghij  ", 7, ["p"]), ("v", "d2", "s", "Head", "", "", "", 8, [])], "volume_id string, document_id string, subtype string, head string, date_from string, date_to string, text string, doc_number int, persons array<string>")
    pairs = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(c) - 1), F.lit(2)), lambda k: F.struct(k.alias("start"), (k + 2).alias("end")))
    got = chunks.chunk(df, 3, 1, lambda c: F.when(F.length(c) > 0, pairs(c))).orderBy("ordinal").collect()
    assert [(r.chunk_id, r.text, r.n_tokens, r.n_chunks_in_doc, r.doc_number, r.persons) for r in got] == [("v:d1:0", "abcdef", 3, 3, 7, ["p"]), ("v:d1:1", "efghij", 3, 3, 7, ["p"]), ("v:d1:2", "ij", 2, 3, 7, ["p"])]


def test_greedy_subset():
    chosen, errors = evaluate.greedy_subset([[0, 0], [1, 1], [0.5, 0.4]], 2)
    assert chosen[0] == 2 and len(errors) == 2


def test_stream_resumes(spark, tmp_path):
    src, sink, mark = (str(tmp_path / x) for x in ("src", "sink", "mark"))
    for k in range(2):
        spark.range(3).withColumn("k", F.lit(k)).write.mode("append").parquet(src)
        ingest.ingest(spark, src, "id long, k int", sink, mark, lambda x: x)
    assert spark.read.parquet(sink).count() == 6


def test_json_lines_must_not_be_empty(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("")
    with pytest.raises(ValueError):
        tables.read_json_lines(spark, str(tmp_path), "a string")


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalog.queries()["r2_bm25"](spark, data).count() > 0


def test_containing_against_all_pairs(spark):
    import random

    r = random.Random(2)
    word = lambda: r.choice(["a", "ab", "b", "ba", "aba"])
    texts = [(k, r.choice([" ", "\n", "  "]).join(word() for _ in range(r.randrange(7)))) for k in range(60)]
    terms = [(k, " ".join(word() for _ in range(r.randrange(1, 5)))) for k in range(30)] + [(30, " a b "), (31, "a  b a"), (32, " "), (33, " a"), (34, "b\na"), (35, "a"), (36, "ba ")]
    got = filters.containing(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(terms, "q int, term string"), "doc_id").select("doc_id", "q").collect()
    assert sorted(map(tuple, got)) == sorted((i, q) for i, t in texts for q, term in terms if term in t)


def test_index_is_read_once_for_each_arm(spark, data):
    from corpusloom.plans import catalog_rank

    plan = catalog_rank.fused_hits(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 8 and "regexp_extract_all" not in plan.replace("regexp_extract_all(lower(trim(translate(", "")


def test_dense_ties_and_odd_vectors(spark):
    v = [(k, [1.0, 0.0] if k % 2 else [0.6, 0.8]) for k in range(40, 0, -1)] + [(99, None), (98, [0.0, 0.0]), (97, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(v, "id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [0.0, 3.0]), ("c", None), ("d", [0.0, 0.0])], "query_id string, q_vector array<double>")
    for block, asked in ((4096, 512), (7, 1)):
        got = [(r.query_id, r.id, r.score) for r in retrieval.dense(q, df, 3, block, asked).orderBy("query_id", "rank").collect()]
        assert got == [("a", 1, 1.0), ("a", 3, 1.0), ("a", 5, 1.0), ("b", 2, 0.8), ("b", 4, 0.8), ("b", 6, 0.8)]


def test_loop_corrects_and_plans(spark):
    """A missing hop is asked again; a plan's hops are used by the systems that plan; a grading model's rejections count only if all hops agree."""
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta")], "query_id long, question string")
    planned = spark.createDataFrame([(1, 0, "one", "simple"), (1, 1, "two", "simple")], "query_id long, place int, query string, route string")
    manifest = spark.createDataFrame([("v", "published")], "volume_id string, status string")
    seen = []

    def retrieve(hops):
        seen.append(sorted((r.query_id, r.hop, r.query) for r in hops.collect()))
        score = F.when(F.col("query") == "two", 1.0).when(F.col("hop").startswith("fix"), 8.0).otherwise(9.0)
        rows = hops.select("query_id", "hop", F.concat(F.lit("v:d"), F.col("query_id").cast("string"), F.lit(":"), F.length("hop").cast("string")).alias("id"), score.alias("score"))
        return rows.withColumns({"volume_id": F.lit("v"), "subtype": F.lit("historical-document"), "text": F.lit("t")})

    def generate(accepted):
        return accepted.groupBy("query_id").agg(F.min("id").alias("i")).select("query_id", F.lit(0).alias("claim"), F.lit("c").alias("text"), F.array("i").alias("ids"))

    run = lambda system, **more: [r.asDict() for r in agent.answer(asked, retrieve, generate, manifest, agent.SYSTEMS[system], planned=planned, **more).collect()]
    out = run("B3", floor=5.0)
    assert seen == [[(1, "h0", "one"), (1, "h1", "two"), (2, "h0", "beta")], [(1, "fix0", "two")]] and {r["outcome"] for r in out} == {"answered"}
    seen.clear()
    run("B0", floor=5.0)
    assert seen == [[(1, "h0", "alpha"), (2, "h0", "beta")]]
    seen.clear()
    grade = lambda evidence, hops: hops.select("query_id", "hop", F.when(F.col("query") == "two", "partial").otherwise("supported").alias("verdict"), F.lit("ask anew").alias("corrective"), F.array(F.lit("v:d2:2")).alias("rejected"))
    out = {r["query_id"]: r["outcome"] for r in run("B2", grade=grade)}
    assert seen[1] == [(1, "fix0", "ask anew")] and out[1] == "answered" and out[2] == "abstained"
