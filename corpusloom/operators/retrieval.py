"""Lexical, vector and hybrid ranking, for a whole table of queries in one plan.

The lexical index is in `postings`, the vector index in `cells`; both are tables that are written once and read by all queries. Ranks have
no ties left: scores are compared at 6 decimals, then by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.postings import B, K1, Index, bm25, ranked, read_index, write_index  # noqa: F401
from corpusloom.sources import tables

RRF_K = 60
WEIGHTS = {"bm25": 1.0, "head": 1.0, "dense": 0.5}
ARMS = ["bm25", "head", "dense"]


def _blocks(size: int):
    """Rows (id, vector) as blocks of at most `size` unit vectors of one length: ids, matrix in double precision, length. Zero and
    null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                lists = batch.column(1).cast(pa.list_(pa.float64()))
                lengths = np.diff(lists.offsets.to_numpy())
                for dim in np.unique(lengths[lengths > 0]):
                    some = pa.array(lengths == dim)
                    x = lists.filter(some).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    norm = np.sqrt((x * x).sum(axis=1))
                    good = np.isfinite(norm) & (norm > 0)
                    ids = batch.column(0).filter(some).filter(pa.array(good))
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([(x[good] / norm[good, None]).tobytes()], pa.binary()), pa.array([int(dim)], pa.int32())], ["ids", "matrix", "dim"])

    return run


def _best(rows: pa.Table, limit: int) -> pa.Table:
    """The best `limit` rows of each query, by scores at 6 decimals, then by id."""
    rows = rows.combine_chunks()
    near = pa.array(np.round(rows["score"].to_numpy(), 6))
    order = pc.sort_indices(pa.table({"q": rows["query_id"], "near": near, "id": rows["id"]}), [("q", "ascending"), ("near", "descending"), ("id", "ascending")])
    q = pc.index_in(rows["query_id"], value_set=pc.unique(rows["query_id"])).to_numpy()[order.to_numpy()]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return rows.take(order.filter(pa.array(nth < limit)))


def _products(limit: int, most: int = 1 << 20):
    """For pairs of blocks (ids, matrix, q_ids, q_matrix, dim): the best `limit` of all blocks of a task for each query. Some more than `most` rows
    are held at a time: what is best so far, which is let go when it alone is half of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            for k in range(batch.num_rows):
                dim = batch.column("dim")[k].as_py()
                ids, q_ids = batch.column("ids")[k].values, batch.column("q_ids")[k].values
                v, q = (np.frombuffer(batch.column(c)[k].as_py(), np.float64).reshape(-1, dim) for c in ("matrix", "q_matrix"))
                scores = q @ v.T
                near = np.round(scores, 6)
                best = np.partition(near, -limit, axis=1)[:, -limit] if len(v) > limit else np.full(len(q), -2.0)
                rows, cols = np.nonzero(near >= best[:, None])
                some = pa.table({"query_id": q_ids.take(pa.array(rows)), "id": ids.take(pa.array(cols)), "score": scores[rows, cols]})
                held.append(some)
                count += len(some)
                if count > most:
                    held = [_best(pa.concat_tables(held), limit)]
                    count = len(held[0])
                    if count > most // 2:
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held, count = [], 0
        if count:
            yield from _best(pa.concat_tables(held), limit).to_batches(max_chunksize=1 << 16)

    return run


def dense(queries: DataFrame, vectors: DataFrame, limit: int = 50, block: int = 4096, asked: int = 512) -> DataFrame:
    """Exact cosine ranking (R-6): every query against every vector, which is what a stated query set asks for, as matrix
    products of blocks; a task gives the best `limit` of its vectors for each query. queries: query_id, q_vector; vectors: id, vector (null: not
    embedded; neither null nor zero vectors rank). The queries' blocks are written, so that their size is known: where it is small they go to
    the vectors."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    q_type, v_type = kind(queries, "query_id"), kind(vectors, "id")
    q = queries.where("q_vector is not null").select("query_id", "q_vector").mapInArrow(_blocks(asked), f"ids array<{q_type}>, matrix binary, dim int")
    q = tables.kept(q, "asked")
    v = vectors.where("vector is not null").select("id", "vector").mapInArrow(_blocks(block), f"ids array<{v_type}>, matrix binary, dim int")
    pairs = v.crossJoin(q.select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("dim").alias("q_dim"))).where("dim = q_dim")
    best = pairs.select("ids", "matrix", "q_ids", "q_matrix", "dim").mapInArrow(_products(limit), f"query_id {q_type}, id {v_type}, score double")
    return ranked(best.select("query_id", "id", F.round("score", 6).alias("score")), limit)


def fuse(arms: dict[str, DataFrame], top_k: int, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion (R-7, JN-A): the sum of weight / (k + rank) over the arms; ties go to the arm named first,
    then to the better rank in it. Ranks of each arm stay, null where a row is absent. One grouping, no outer join; the union is written first (see
    `select.merge_hops`)."""
    weights = WEIGHTS | (weights or {})
    rows = None
    for place, (arm, hits) in enumerate(arms.items()):
        one = hits.select("query_id", "id", F.col("rank").alias("arm_rank"), F.lit(arm).alias("arm"), F.lit(place).alias("place"), F.lit(float(weights.get(arm, 1.0))).alias("weight"))
        rows = one if rows is None else rows.unionByName(one)
    fused = tables.kept(rows, "arms").groupBy("query_id", "id").agg(
        F.sum(F.col("weight") / (k + F.col("arm_rank"))).alias("exact"), F.min(F.struct("place", "arm_rank")).alias("first"), *(F.max(F.when(F.col("arm") == a, F.col("arm_rank"))).alias(f"rank_{a}") for a in arms)
    )
    order = Window.partitionBy("query_id").orderBy(F.round("exact", 9).desc(), "first", "id")
    out = fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)
    return out.select("query_id", "id", F.round("exact", 6).alias("score"), "rank", *(f"rank_{a}" for a in arms))


def coverage(query, body):
    """A stand-in for a cross-encoder's score: the share of the query's different terms that the passage has, in log-odds
    like units. It's for tests; it doesn't tell a model's quality."""
    q = F.array_distinct(text.tokens(query))
    return F.round(8.0 * F.size(F.array_intersect(q, F.array_distinct(text.tokens(body)))) / F.greatest(F.size(q), F.lit(1)) - 4.0, 6)


def rerank(hits: DataFrame, passages: DataFrame, queries: DataFrame, top_k: int, scorer: Callable | None = coverage, cut: int = 1800) -> DataFrame:
    """Rows scored against their query, best first (R-8, R-9, R-11, JN-B). hits: query_id, id, rank; passages: id, text. Without a
    scorer, with one row, or with no more rows than top_k, a query's rows stay as they are with a null score. Without a scorer
    nobody reads texts, so hits of queries that have none stay, too. The scorer sees only hits, which a top-k has cut before."""
    if scorer is None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        return hits.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rank_rerank", place).where(F.col("rank_rerank") <= top_k).withColumn("rank_rerank", F.lit(None).cast("long"))
    n = F.count("*").over(Window.partitionBy("query_id"))
    hits = tables.kept(hits, "hits")  # few, and known to be, so texts that nobody asks for don't move
    texts = passages.select("id", F.substring("text", 1, cut).alias("__text")).join(hits.select("id").distinct(), "id", "left_semi")
    rows = hits.withColumn("__n", n).join(texts, "id", "left").join(queries.select("query_id", F.col("query").alias("__query")), "query_id")
    score = scorer(F.col("__query"), F.coalesce("__text", F.lit("")))
    rows = rows.withColumn("rerank_score", F.when((F.col("__n") > 1) & (F.col("__n") > top_k), score))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    rows = rows.withColumn("rank_rerank", F.row_number().over(order).cast("long")).where(F.col("rank_rerank") <= top_k)
    return rows.withColumn("rank_rerank", F.when(F.col("rerank_score").isNotNull(), F.col("rank_rerank"))).drop("__n", "__text", "__query")


def timeline(hits: DataFrame) -> DataFrame:
    """Hits by date, undated ones last, then by id (R-12, T-2)."""
    order = Window.partitionBy("query_id").orderBy(F.coalesce(F.nullif("date_from", F.lit("")), F.lit("9999")), "id")
    return hits.withColumn("position", F.row_number().over(order).cast("long"))


def lookup(chunks: DataFrame, volume_id: str, document_id: str) -> DataFrame:
    """All chunks of one document in order (R-13, A-13)."""
    return chunks.where((F.col("volume_id") == volume_id) & (F.col("document_id") == document_id)).orderBy("ordinal")


def excerpt(chunks: DataFrame, limit: int = 60_000, mark: str = " [TRUNCATED]") -> DataFrame:
    """Each document's chunks joined in order, cut at a limit, after its id and head (R-14)."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    docs = chunks.groupBy("volume_id", "document_id").agg(F.min_by("head", "ordinal").alias("head"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("body"))
    return docs.select("volume_id", "document_id", F.concat_ws("\n", F.concat_ws(":", "volume_id", "document_id"), "head", text.truncated(F.col("body"), limit, mark)).alias("excerpt"))


def mode(vectors: DataFrame, reranks: bool = False, focuses: bool = False) -> DataFrame:
    """One row: rows, embedded, and the retriever's mode (R-15)."""
    s = vectors.agg(F.count("*").alias("rows"), F.count("vector").alias("embedded"))
    m = F.when(F.col("rows") == 0, "unavailable").when(F.col("embedded") == 0, "bm25-only").when(F.col("embedded") == F.col("rows"), "hybrid").otherwise("partial")
    return s.withColumn("mode", F.concat(m, F.lit("+rerank" if reranks else ""), F.lit("+focus" if focuses else "")))
