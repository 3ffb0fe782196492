"""Arms as plans of their own, not tables: what is made of their union holds each row once, and hits stay without a model."""

from pyspark.sql import functions as F

from corpusloom.operators import retrieval, select


def arm(spark, seed, path):
    """Ranked hits whose second part turns out empty, as the other spans of a small index do."""
    rows = spark.range(2000).selectExpr("id % 40 AS query_id", f"CAST(hash(id, {seed}) & 255 AS LONG) AS id", f"CAST(hash(id, {seed + 1}) & 1023 AS DOUBLE) AS score").dropDuplicates(["query_id", "id"])
    for part, some in (("first", rows), ("others", rows.where("score < 0"))):
        some.write.parquet(f"{path}/{part}")
    first, others = (spark.read.parquet(f"{path}/{part}") for part in ("first", "others"))
    return retrieval.ranked(first.union(others.groupBy("query_id", "id").agg(F.sum("score").alias("score"))), 12)


def test_rejections_of_merged_arms(spark, tmp_path):
    one, two = (arm(spark, seed, f"{tmp_path}/{seed}") for seed in (1, 7))
    m = select.merge_hops(one.withColumns({"hop": F.lit("h0"), "seen": F.lit(0)}).unionByName(two.withColumns({"hop": F.lit("h1"), "seen": F.lit(1)})).drop("rank"))
    hops = m.select("query_id", "hop").distinct()
    own = m.where("id % 4 = 0").select("query_id", "id", "hop")
    other = m.where("id % 8 = 0").select("query_id", "id", F.col("hop").alias("o")).join(hops, "query_id").where("hop <> o").select("query_id", "id", "hop")
    got = [(r.query_id, r.id, r.by_all) for r in select.rejected_by_all(own.unionByName(other), hops).collect()]
    rows, n = [(r.query_id, r.id, r.hop) for r in m.collect()], {}
    for q, _, h in rows:
        n.setdefault(q, set()).add(h)
    assert sorted(got) == sorted((q, i, i % 8 == 0 or len(n[q]) == 1) for q, i, _ in rows if i % 4 == 0)


def test_hits_without_a_question_stay_without_a_model(spark):
    hits = spark.createDataFrame([(q, 10 * q + k, k) for q in (1, 2) for k in (1, 2, 3)], "query_id long, id long, rank long")
    asked, passages = spark.createDataFrame([(1, "a")], "query_id long, query string"), spark.createDataFrame([(11, "a")], "id long, text string")
    rows = retrieval.rerank(hits, passages, asked, 2, scorer=None).select("query_id", "id", "rank", "rerank_score", "rank_rerank").collect()
    assert sorted(map(tuple, rows)) == [(1, 11, 1, None, None), (1, 12, 2, None, None), (2, 21, 1, None, None), (2, 22, 2, None, None)]


def test_a_status_needs_no_index(spark, data, monkeypatch):
    from corpusloom.plans import catalog_rank, inputs

    def never(*_):
        raise AssertionError("a status reads the manifest alone")

    monkeypatch.setattr(inputs, "index", never)
    assert catalog_rank.Q["n3_status"][0](spark, data).count() > 0


def test_spans_of_few_texts_at_a_time(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.plans import plugs

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "one two", "ñandú é", "a" * 40, "", "three"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = df.select("id", plugs.tokenizer_spans(path, 10)(F.col("text")).alias("s")).orderBy("id").collect()
    tool = Tokenizer.from_file(path)
    assert [[tuple(x) for x in r.s] for r in got] == [tool.encode(t or "", add_special_tokens=False).offsets for t in texts]
