"""The lexical index as blocks of postings with score bounds, and a top-k that reads few of them (R-1 to R-3).

Layout, all Parquet. A span is `SPAN` documents that follow each other as the texts are stored; a block is a term's postings within one
span, so the blocks of different terms are aligned and a document lies in the same span of every term.

    blocks/bucket=b       term, span, n, top_tf, least_dl, postings (id, tf, dl): sorted by (term, span)
    frequencies/bucket=b  term, df
    stats                 n documents of avgdl tokens

A term's bucket is a hash, so a query opens the buckets of its terms only, and within them the row groups of its terms. A block
says the most occurrences and the shortest document in it, which bounds what it can add to a score for any k1 and b. A query
adds these bounds over its terms for each span, without the postings. It scores its most promising spans; the k-th score there is a
threshold, and of all other spans those alone are scored whose bound reaches it. Nothing is approximate: a span that is
left out holds no document of the first k. What is left to skip depends on the text: rare terms rule out most spans at once.

Statistics are those of the unfiltered corpus; filters restrict what may be ranked, below the scoring, so thresholds come from rows that pass. Ranks have
no ties left: scores are compared at 6 decimals, then by id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions import text
from corpusloom.sources import tables

K1, B = 1.2, 0.75
SPAN = 1024  # documents of a span, a power of two
BUCKET_DOCS, MOST_BUCKETS = 20_000, 4096  # documents for each bucket, were there no limit
SLAB_DOCS = 1 << 20  # documents whose blocks of a bucket are sorted by one task
LEAD = 8  # spans that give a query's threshold
TOGETHER = 4096  # queries that a span is scored for in one group
PICKED = 100_000  # pairs of term and span that pick blocks before the shuffle
PUSHED = 5_000  # terms that are pushed to the scan as a list; beyond it the buckets are


@dataclass(frozen=True)
class Index:
    """Blocks and frequencies as tables; n documents of avgdl tokens; number of buckets."""

    blocks: DataFrame
    frequencies: DataFrame
    n: int
    avgdl: float
    buckets: int

    @property
    def postings(self) -> DataFrame:
        """All postings: term, id, tf, dl."""
        return self.blocks.select("term", F.inline("postings"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _span_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (span, id, tokens), spans one after the other, to a row for each term of a span: its postings as lists, by id."""
    names = ["term", "span", "ids", "tfs", "dls"]

    def made(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pc.sort_indices(rows["id"])).combine_chunks()
        lists = rows["tokens"].combine_chunks()
        dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        words = lists.flatten().dictionary_encode()
        keys = words.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl)
        keys, tf = np.unique(keys, return_counts=True)  # by term, then by document
        doc = keys % len(dl)
        at = np.searchsorted(keys, np.arange(len(words.dictionary) + 1, dtype=np.int64) * len(dl)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), x) for x in (rows["id"].combine_chunks().take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(dl[doc]))]
        return pa.RecordBatch.from_arrays([words.dictionary, pa.array(np.full(len(at) - 1, rows["span"][0].as_py(), np.int64)), *lists], names)

    held: list[pa.Table] = []
    for batch in batches:
        spans = batch.column("span").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(spans)) + 1).tolist(), len(spans)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end > start:
                if held and held[0]["span"][0].as_py() != spans[start]:
                    yield made(pa.concat_tables(held))
                    held = []
                held.append(pa.Table.from_batches([batch.slice(start, end - start)]))
    if held:
        yield made(pa.concat_tables(held))


def write_index(docs: DataFrame, path: str, field: str = "text", id_col: str = "doc_id", span: int = SPAN) -> Index:
    """The index of one field. Texts are read and cut into tokens once. A span's documents follow each other in one task, which makes its blocks
    without a shuffle; these are then shuffled once, as lists, by bucket and by `SLAB_DOCS` documents. Both numbers grow with the
    documents, so that a task gets the blocks of as many postings whatever the size, and no task all of a frequent term."""
    spark = docs.sparkSession
    n = docs.count()
    buckets = min(MOST_BUCKETS, 2 ** max(3, math.ceil(math.log2(max(1, n / BUCKET_DOCS)))))
    slabs = max(1, math.ceil(n / SLAB_DOCS))
    nth = F.shiftright(F.monotonically_increasing_id(), int(math.log2(span)))
    tokens = docs.select(nth.alias("span"), F.col(id_col).alias("id"), text.tokens(F.col(field)).alias("tokens"))
    kind = tokens.schema["id"].dataType.simpleString()
    lists = tokens.mapInArrow(_span_blocks, f"term string, span long, ids array<{kind}>, tfs array<int>, dls array<int>").withColumn("bucket", _bucket(buckets))
    dealt = lists.repartitionById(buckets * slabs, (F.col("bucket") * slabs + F.pmod(F.xxhash64("span"), F.lit(slabs))).cast("int")).sortWithinPartitions("bucket", "term", "span")
    postings = F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl")).cast(f"array<struct<id: {kind}, tf: bigint, dl: bigint>>")  # `span` of them at most
    long = lambda c: c.cast("long")
    blocks = dealt.select("term", "span", long(F.size("ids")).alias("n"), long(F.array_max("tfs")).alias("top_tf"), long(F.array_min("dls")).alias("least_dl"), postings.alias("postings"), "bucket")
    # Ids don't fit in a dictionary page where documents are many: the second format then writes them as differences, not as eight bytes each.
    blocks.write.mode("overwrite").option("parquet.writer.version", "v2").partitionBy("bucket").parquet(f"{path}/blocks")
    written = spark.read.schema(blocks.schema).parquet(f"{path}/blocks")
    frequencies = written.select("bucket", "term", "n").repartitionById(buckets, "bucket").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    frequencies.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/frequencies")
    total = written.agg(F.sum(_sum(F.col("postings.tf"))).alias("tokens"))
    total.select(F.lit(n).cast("long").alias("n"), F.coalesce("tokens", F.lit(0).cast("long")).alias("tokens"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/stats")
    return read_index(spark, path)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def read_vocabulary(index: Index) -> DataFrame:
    """term, df, n (occurrences) of every term, from its blocks."""
    return index.blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum(_sum(F.col("postings.tf"))).alias("n")).select("term", "df", "n")


def read_index(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/stats").first()
    kept = {name: spark.read.parquet(f"{path}/{name}") for name in ("blocks", "frequencies")} if stats.tokens else {
        "blocks": spark.createDataFrame([], "term string, span long, n long, top_tf long, least_dl long, postings array<struct<id: long, tf: long, dl: long>>, bucket int"),
        "frequencies": spark.createDataFrame([], "term string, df long, bucket int"),
    }
    return Index(kept["blocks"], kept["frequencies"], stats.n, stats.tokens / stats.n if stats.n else 0.0, stats.buckets)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The best `limit` rows of each query, with ranks from 1 (T-1, W-1)."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def of_terms(index: Index, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index's blocks and frequencies, cut to the buckets and, if they aren't many, to the terms that are asked for."""
    keyed = terms.select("term", _bucket(index.buckets).alias("bucket")).distinct()
    asked = keyed.limit(PUSHED + 1).collect()
    few = len(asked) <= PUSHED
    held = {r.bucket for r in (asked if few else keyed.select("bucket").distinct().collect())}  # a number a bucket
    wanted = F.col("term").isin([r.term for r in asked]) if few else F.lit(True)
    here = F.col("bucket").isin(sorted(held)) & wanted
    return index.blocks.where(here), index.frequencies.where(here)


@dataclass(frozen=True)
class Pruned:
    """The steps of a pruned ranking: spans (query_id, span, terms, bound, place by bound) that have any of a query's terms, the best hits in
    the first of them, and the other spans that may matter."""

    spans: DataFrame
    first: DataFrame
    others: DataFrame
    scored: Callable[[DataFrame], DataFrame]


def _span_hits(limit: int | None, k1: float, b: float, avgdl: float, schema: pa.Schema):
    """Of one span its blocks (term, ids, tfs, dls) and what is asked of it (query_id, terms, threshold), to (query_id, id, score): for each query the hits
    that reach its threshold, the best `limit` if that is given. Holds one number a document of the span and the span's own postings."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not blocks.num_rows or not asked.num_rows:
            return schema.empty_table()
        at = {t: k for k, t in enumerate(blocks["term"].to_pylist())}
        flat = lambda c: (lambda x: (x.flatten(), x.offsets.to_numpy()))(blocks[c].combine_chunks())
        ids, cuts = flat("ids")
        cuts = cuts - cuts[0]
        tf, dl = (flat(c)[0].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("tfs", "dls"))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
        docs = pc.unique(ids)
        docs = docs.take(pc.sort_indices(docs))  # places are in the order of ids, which settles ties
        place = pc.index_in(ids, value_set=docs).to_numpy(zero_copy_only=False)
        rows, where, scores = [], [], []
        for k, (terms, threshold) in enumerate(zip(asked["terms"].to_pylist(), asked["threshold"].to_pylist(), strict=True)):
            total, hit = np.zeros(len(docs)), np.zeros(len(docs), bool)
            for term in sorted(terms, key=lambda x: x["term"]):
                if (i := at.get(term["term"])) is not None:
                    mine = place[cuts[i] : cuts[i + 1]]
                    total += np.bincount(mine, term["idf"] * part[cuts[i] : cuts[i + 1]], len(docs))
                    hit[mine] = True
            near = np.round(total, 6)
            some = np.flatnonzero(hit & (near >= threshold))
            if limit is not None and len(some) > limit:
                some = some[np.lexsort((some, -near[some]))[:limit]]
            rows.append(np.full(len(some), k))
            where.append(some)
            scores.append(near[some])
        return pa.Table.from_arrays([asked["query_id"].take(pa.array(np.concatenate(rows))), docs.take(pa.array(np.concatenate(where))), pa.array(np.concatenate(scores))], schema=schema)

    return run


def pruned(queries: DataFrame, index: Index, limit: int, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> Pruned:
    """What the steps share is written, some tens of bytes for each query and span and the leading hits, so no step runs twice. A span is scored
    where all its blocks are: these are shuffled, once for all queries, and of what they hold only hits that may be ranked leave the task."""
    terms = queries.select("query_id", F.explode(F.array_distinct(text.tokens(text.query_text(F.col("query"))))).alias("term"))
    each = allowed is not None and "query_id" in allowed.columns
    if each:  # a query that nothing is allowed to has no hits
        terms = terms.join(allowed.select("query_id").distinct(), "query_id", "left_semi")
    terms = tables.kept(terms, "terms")
    parts = max(1, math.ceil(terms.select("query_id").distinct().count() / TOGETHER))
    blocks, frequencies = of_terms(index, terms)
    idf = F.ln(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = tables.kept(terms.join(frequencies.select("term", "df"), "term").select("query_id", "term", idf.alias("idf")), "weighed")

    def part(tf: str, dl: str) -> Column:
        return F.col("idf") * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.lit(index.avgdl)))

    def scored(spans: DataFrame) -> DataFrame:
        """Hits of spans (query_id, span, terms, threshold), which are written: few pairs of term and span pick the blocks before these move."""
        pairs = spans.select("span", F.explode("terms.term").alias("term"))
        held = blocks.select("span", "term", F.col("postings.id").alias("ids"), F.col("postings.tf").cast("array<int>").alias("tfs"), F.col("postings.dl").cast("array<int>").alias("dls"))
        if (spans.select(F.sum(F.size("terms"))).first()[0] or 0) <= PICKED:
            held = held.join(F.broadcast(pairs.distinct()), ["span", "term"], "left_semi")
        held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))
        asked = spans.select("span", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", "terms", "threshold")
        types = {"query_id": asked.schema["query_id"].dataType, "id": held.schema["ids"].dataType.elementType, "score": T.DoubleType()}
        schema = pa.schema([(n, to_arrow_type(t)) for n, t in types.items()])
        run = _span_hits(limit if allowed is None else None, k1, b, index.avgdl, schema)
        hits = held.groupBy("span", "part").cogroup(asked.groupBy("span", "part")).applyInArrow(run, T.StructType([T.StructField(n, t) for n, t in types.items()]))
        return hits if allowed is None else hits.join(allowed.select(*(["query_id", "id"] if each else ["id"])), ["query_id", "id"] if each else ["id"], "left_semi")

    bounds = weighed.join(blocks.select("term", "span", "top_tf", "least_dl"), "term")
    spans = bounds.groupBy("query_id", "span").agg(F.sum(part("top_tf", "least_dl")).alias("bound"), F.collect_list(F.struct("term", "idf")).alias("terms"))
    most = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "span")
    spans = tables.kept(spans.withColumn("place", F.row_number().over(most)), "spans")
    lead = tables.kept(spans.where(F.col("place") <= LEAD).withColumn("threshold", F.lit(0.0)), "leading")
    first = tables.kept(ranked(scored(lead), limit), "lead")
    threshold = first.where(F.col("rank") == limit).select("query_id", F.col("score").alias("threshold"))
    others = spans.where(F.col("place") > LEAD).join(threshold, "query_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    return Pruned(spans, first.drop("rank"), tables.kept(others.where(F.col("bound") + 1e-6 >= F.col("threshold")), "others"), scored)


def bm25(queries: DataFrame, index: Index, limit: int = 50, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank) of documents with any of a query's terms (R-2, R-3). queries: query_id, query.
    allowed: ids that may be ranked, for all queries or, with a query_id, for each. A query without terms has no rows. Hits are written: what
    they are joined with may be as large as the texts, which stay where they are if the hits are known to be few."""
    p = pruned(queries, index, limit, allowed, k1, b)
    return tables.kept(ranked(p.first.union(p.scored(p.others)), limit), "hits")
