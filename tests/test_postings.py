"""Block postings: a pruned ranking equals a plain one, reads its terms' buckets only, and leaves spans out."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings as p


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(n):
        topic = words[(k // 40) * 7 % 250 :][:20]  # documents that are stored together share words
        docs.append((k * 3, " ".join(r.choice(topic if r.random() < 0.6 else words) for _ in range(r.randrange(1, 60)))))
    return [*docs, (10**6, ""), (10**6 + 1, None), (10**6 + 2, "W1 w1 unique")]


def plain(docs, queries, limit, allowed=lambda q, i: True):
    bags = {i: Counter((t or "").lower().split()) for i, t in docs}
    n, avgdl = len(bags), sum(map(Counter.total, bags.values())) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    out = []
    for q, words in queries:
        hits = []
        for i, b in bags.items():
            asked = [w for w in dict.fromkeys(words.lower().split()) if b[w]]
            if asked and allowed(q, i):
                dl = b.total()
                hits.append((-round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * dl / avgdl)) for w in asked), 6), i))
        out += [(q, i, -s, k) for k, (s, i) in enumerate(sorted(hits)[:limit], 1)]
    return sorted(out)


QUERIES = [(1, "w1 w2"), (2, "w17 unique"), (3, "nothing"), (4, ""), (5, " ".join(f"w{k}" for k in range(0, 300, 9))), (6, "W5 w5 w250"), (7, "w40 w41 w42 w43")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs = corpus(1500)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(3, "doc_id")
    at = str(tmp_path_factory.mktemp("postings"))
    p.write_index(df, at, span=16)
    return docs, at


class Rows(list):
    """Rows with scores, equal up to the rounding of the sixth decimal."""

    def __eq__(self, other):
        return [(q, i, k) for q, i, _, k in self] == [(q, i, k) for q, i, _, k in other] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(self, other, strict=True))


def rows(df):
    return Rows(sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect()))


@pytest.mark.parametrize("limit", [1, 5, 2000])
def test_equals_plain(spark, made, limit, monkeypatch):
    docs, at = made
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    for lead in (1, 8):
        monkeypatch.setattr(p, "LEAD", lead)
        assert rows(p.bm25(queries, p.read_index(spark, at), limit)) == plain(docs, QUERIES, limit)
    monkeypatch.setattr(p, "PUSHED", 3)
    assert rows(p.bm25(queries, p.read_index(spark, at), limit)) == plain(docs, QUERIES, limit)


def test_allowed(spark, made):
    docs, at = made
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    some = spark.range(0, 6000, 2)
    assert rows(p.bm25(queries, p.read_index(spark, at), 7, some)) == plain(docs, QUERIES, 7, lambda q, i: i % 2 == 0 and i < 6000)
    each = spark.range(0, 5000, 1).crossJoin(queries.select("query_id")).where((F.col("id") + F.col("query_id")) % 3 == 0)
    assert rows(p.bm25(queries, p.read_index(spark, at), 7, each)) == plain(docs, QUERIES, 7, lambda q, i: i < 5000 and (i + q) % 3 == 0)


def test_files_and_spans(spark, made):
    _, at = made
    index = p.read_index(spark, at)
    queries = spark.createDataFrame([(7, "w40 w41 w42 w43")], "query_id long, query string")
    terms = queries.select("query_id", F.explode(F.split("query", " ")).alias("term"))
    blocks, _ = p.of_terms(index, terms)
    held = {r[0] for r in index.blocks.where(F.col("term").isin("w40", "w41", "w42", "w43")).select("bucket").distinct().collect()}
    read = {r[0].split("bucket=")[1].split("/")[0] for r in blocks.select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in index.blocks.select("bucket").distinct().collect()}
    assert read == {str(x) for x in held} and len(held) < len(every)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term" in plan
    step = p.pruned(queries, index, 5)
    assert step.spans.where(F.col("place") <= p.LEAD).count() + step.others.count() < 0.6 * step.spans.count()  # the rest is never opened


def test_empty(spark, tmp_path):
    index = p.write_index(spark.createDataFrame([(1, "")], "doc_id long, text string").limit(0), str(tmp_path / "a"))
    assert p.bm25(spark.createDataFrame([(1, "a b")], "query_id long, query string"), index).count() == 0
    index = p.write_index(spark.createDataFrame([("x", "a"), ("y", "a a b"), ("z", None)], "doc_id string, text string"), str(tmp_path / "b"))
    assert [r.id for r in p.bm25(spark.createDataFrame([(1, "a b")], "query_id long, query string"), index).orderBy("rank").collect()] == ["y", "x"]


def test_spans_and_slabs(spark, tmp_path, monkeypatch):
    """A span's blocks are made where its documents are, in batches of any size, and are dealt to more tasks as documents grow."""
    monkeypatch.setattr(p, "SLAB_DOCS", 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = corpus(1500, 2)
        index = p.write_index(spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(3), str(tmp_path), span=16)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    bags = {i: Counter((t or "").lower().split()) for i, t in docs}
    assert sorted(map(tuple, index.postings.collect())) == sorted((w, i, k, b.total()) for i, b in bags.items() for w, k in b.items())
    assert all([x.id for x in r.postings] == sorted(x.id for x in r.postings) and (r.n, r.top_tf, r.least_dl) == (len(r.postings), max(x.tf for x in r.postings), min(x.dl for x in r.postings)) for r in index.blocks.collect())
    assert {r.term: (r.df, r.n) for r in p.read_vocabulary(index).collect()} == {w: (sum(w in b for b in bags.values()), k) for w, k in sum(bags.values(), Counter()).items()}
    assert max(len([r for r in rows]) for rows in [index.blocks.where(f"bucket = {k}").select(F.input_file_name()).distinct().collect() for k in range(index.buckets)]) > 1
    assert rows(p.bm25(spark.createDataFrame(QUERIES, "query_id long, query string"), index, 5)) == plain(docs, QUERIES, 5)


@pytest.mark.parametrize("together, picked", [(2, 0), (3, 10**6)])
def test_only_the_best_of_a_span_leave_it(spark, made, monkeypatch, together, picked):
    """Spans are scored where their blocks are, for some queries at a time, and hits that can't be ranked aren't shuffled."""
    docs, at = made
    monkeypatch.setattr(p, "TOGETHER", together)
    monkeypatch.setattr(p, "PICKED", picked)
    queries = spark.createDataFrame(QUERIES, "query_id long, query string")
    index = p.read_index(spark, at)
    step = p.pruned(queries, index, 5)
    assert step.first.groupBy("query_id").count().where("count > 5").count() == 0
    n = step.others.count()
    assert n and step.scored(step.others).count() <= 5 * n
    assert rows(p.bm25(queries, index, 5)) == plain(docs, QUERIES, 5)
    each = spark.createDataFrame([(2, 3), (2, 10**6 + 2), (5, 9)], "query_id long, id long")
    assert rows(p.bm25(queries, index, 5, each)) == plain(docs, QUERIES, 5, lambda q, i: (q, i) in {(2, 3), (2, 10**6 + 2), (5, 9)})


def test_ids_without_a_dictionary_are_differences(spark, tmp_path):
    """Ids that are all different, as in a large index, take far less than their eight bytes, and are read as they were."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(7_000_000_000 + k * 3, f"w{k:06d}") for k in range(4000)], "doc_id long, text string").coalesce(1)
    index = p.write_index(docs, str(tmp_path / "x"))
    sizes = []
    for f in (tmp_path / "x" / "blocks").rglob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        sizes += [(c.total_uncompressed_size, c.num_values) for g in range(m.num_row_groups) for c in (m.row_group(g).column(k) for k in range(m.num_columns)) if c.path_in_schema.endswith("element.id")]
    assert sum(n for _, n in sizes) == 4000 and sum(b for b, _ in sizes) < 4 * 4000
    assert sorted((r.term, r.id) for r in index.postings.collect()) == [(f"w{k:06d}", 7_000_000_000 + k * 3) for k in range(4000)]
