"""What leaves a task or moves in a join stays small: texts and words stay where they are, blocks give one best list a task."""

import shutil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import filters, retrieval
from corpusloom.plans import catalog_rank, inputs


def test_terms_of_many_words_need_no_vocabulary(spark):
    docs = spark.createDataFrame([(1, "a bb ccc d"), (2, "bb ccc"), (3, None), (4, "xa bb ccc dx")], "id long, text string")
    terms = spark.createDataFrame([(1, "a bb ccc d"), (1, "a bb ccc d"), (2, "a bb c"), (3, None)], "query_id long, term string")
    found = filters.containing(docs, terms, "id")
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(1, 1), (1, 1), (1, 4), (1, 4), (2, 1), (2, 4)]  # as a join of both tables, equal terms too
    assert "__word" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [3, 20, 1 << 20])
def test_a_task_gives_one_list_a_query(most):
    r = np.random.default_rng(3)
    q, v = r.normal(size=(4, 5)), r.normal(size=(60, 5))
    v[30:40] = v[20:30]  # equal scores: the least id
    names = ["ids", "matrix", "q_ids", "q_matrix", "dim"]
    block = lambda at: pa.RecordBatch.from_pydict(dict(zip(names, [[list(range(at, at + 10))], [v[at : at + 10].tobytes()], [list(range(4))], [q.tobytes()], [5]], strict=True)), pa.schema([("ids", pa.list_(pa.int64())), ("matrix", pa.binary()), ("q_ids", pa.list_(pa.int64())), ("q_matrix", pa.binary()), ("dim", pa.int32())]))
    got = [x for b in retrieval._products(3, most)(block(at) for at in range(0, 60, 10)) for x in zip(b["query_id"].to_pylist(), b["id"].to_pylist(), strict=True)]
    near = np.round(q @ v.T, 6)
    want = {(k, int(i)) for k in range(4) for i in np.lexsort((np.arange(60), -near[k]))[:3]}
    assert want <= set(got) and (most < 1 << 20 or len(got) == 12)


def test_texts_of_hits_alone_are_joined(spark, data):
    hits = spark.createDataFrame([(1, k, k) for k in range(1, 5)], "query_id long, id long, rank long")
    asked, passages = spark.createDataFrame([(1, "a b")], "query_id long, query string"), spark.createDataFrame([(k, "a") for k in range(2, 99)], "id long, text string")
    rows = retrieval.rerank(hits, passages, asked, 3)
    assert [r.id for r in rows.orderBy("rank_rerank").collect()] == [2, 3, 4]  # the first has no text
    assert "LeftSemi" in rows._jdf.queryExecution().executedPlan().toString()
    found = catalog_rank.dispatcher(spark, data)(catalog_rank.route_hops(spark, data))
    assert any("/hits-" in f for f in found.inputFiles()) and found.where(F.col("text").isNotNull()).count() == found.count() > 0


@pytest.fixture(scope="module")
def copies(data, tmp_path_factory):
    """The tables, and the tables with their documents eight times, in one file: as many words and queries, eight times the postings."""
    import pyarrow.parquet as pq

    out = {}
    for n in (1, 8):
        out[n] = str(shutil.copytree(data, tmp_path_factory.mktemp("copies") / str(n), copy_function=shutil.copyfile))
        rows = pq.read_table(f"{data}/documents.parquet")
        ids = rows.schema.get_field_index("doc_id")
        pq.write_table(pa.concat_tables([rows.set_column(ids, rows.schema.field(ids), pc.add(rows["doc_id"], k * 1_000_000).cast(rows.schema.field(ids).type)) for k in range(n)]), f"{out[n]}/documents.parquet")
    return out


def shuffled(spark, run):
    """Records that a run shuffles, by Spark's own count of its stages."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(60_000)
        some = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (some.apply(k) for k in range(some.size()))}

    known = stages()
    run()
    return sum(n for stage, n in stages().items() if stage > max(known))


@pytest.mark.parametrize("name", ["w6_synthesis_window", "n13_b0_2step", "n13_b1", "u2_documents", "n13_b2_corrections", "w3_select_evidence", "n4_graded_by_model", "n9_repair", "u5_jaccard"])
def test_searches_do_not_shuffle_postings_apart(spark, copies, name):
    """Eight times the documents in the same spans: lists get longer, what is shuffled doesn't get more."""
    rows = {}
    for n, d in copies.items():
        inputs.index(spark, d, "text"), inputs.index(spark, d, "head")
        rows[n] = shuffled(spark, lambda d=d: catalog_rank.Q[name][0](spark, d).collect())
    assert 0 < rows[8] < 2 * rows[1]


def test_claims_do_not_move_to_meet_evidence(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        checked = catalog_rank.gate_inputs(spark, data)[2]
        plan = checked._jdf.queryExecution().executedPlan().toString()
        assert any("/evidence-" in f for f in checked.inputFiles())
        assert not any("hashpartitioning(volume_id" in x for x in plan.splitlines())
        assert "SortMergeJoin [query_id" not in plan and "SortMergeJoin [volume_id" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
