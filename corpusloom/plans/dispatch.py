"""Retrieval for a whole table of hops, each by the tool of its route, in one plan (N-3).

    status    the manifest's volumes that the question names; no passages
    lookup    all passages of the document that the hop names; if it has none, as below
    timeline  the best passages that pass the hop's filters, by date
    others    the best passages that pass the hop's filters

A hop may carry filters: volumes, and dates from and to. Only citable passages are searched, and none of the documents that are withheld. A hop
whose filters leave nothing is asked again without them (F-15). A question of one hop gets `top_k` passages, one of several
`per_hop` for each, whose union is then reranked against the question (`reranked`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import chunks, cite, filters, retrieval, select
from corpusloom.sources import tables

TOP_K, PER_HOP, UNION = 10, 50, 20
SEARCHED = ("simple", "complex", "timeline", "lookup")
EMPTY_FILTERS = {"volumes": "cast(null as array<string>)", "q_from": "cast(null as string)", "q_to": "cast(null as string)"}


def filtered(hops: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, id) of the passages that each hop's filters let pass, for hops that have any. hops: query_id, volumes, q_from, q_to."""
    dates = (F.col("q_from").isNull() | (F.col("date_to") >= F.col("q_from"))) & (F.col("q_to").isNull() | (F.col("date_from") <= F.col("q_to")))
    slim = passages.select("id", "volume_id", "date_from", "date_to")
    by_volume = hops.where("size(volumes) > 0").select("query_id", "q_from", "q_to", F.explode(F.array_distinct("volumes")).alias("volume_id")).join(slim, "volume_id").where(dates)
    by_date = hops.where("coalesce(size(volumes), 0) <= 0").where("q_from is not null or q_to is not null").join(slim, dates)  # a stated query set against all rows
    return by_volume.select("query_id", "id").union(by_date.select("query_id", "id"))


@dataclass
class Dispatcher:
    """search: (queries (query_id, query), allowed ids, for all or by query_id, limit) -> query_id, id, score, rank.
    passages: id (a chunk id), volume_id, document_id, ordinal, subtype, date_from, date_to, text; manifest: volume_id, title, sub_series, status;
    withheld: volume_id, document_id."""

    search: Callable[[DataFrame, DataFrame, int], DataFrame]
    passages: DataFrame
    manifest: DataFrame
    withheld: DataFrame | None = None
    top_k: int = TOP_K
    per_hop: int = PER_HOP
    series: str = r"src\d+"

    def citable(self) -> DataFrame:
        rows = self.passages.where(F.col("subtype").isin(*cite.CITABLE))
        return rows if self.withheld is None else rows.join(self.withheld.select("volume_id", "document_id").distinct(), ["volume_id", "document_id"], "left_anti")

    def status(self, hops: DataFrame) -> DataFrame:
        """query_id, volume_id, status: volumes that a status question names."""
        named = hops.where("route = 'status'").select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("query", F.lit(self.series), F.lit(0)))).alias("volume_id"))
        return named.join(self.manifest.select("volume_id", "status"), "volume_id").select("query_id", "volume_id", "status").distinct()

    def _lookup(self, hops: DataFrame) -> DataFrame:
        named = hops.where("route = 'lookup'").withColumn("ref", text.document_reference(F.col("query"), self.series))
        rows = self.passages if self.withheld is None else self.passages.join(self.withheld.select("volume_id", "document_id").distinct(), ["volume_id", "document_id"], "left_anti")
        found = named.select("key", F.col("ref.volume_id").alias("volume_id"), F.col("ref.document_id").alias("document_id")).join(rows.select("volume_id", "document_id", "id", "ordinal"), ["volume_id", "document_id"])
        place = F.row_number().over(Window.partitionBy("key").orderBy("ordinal", "id")).cast("long")
        return found.select("key", "id", F.lit(None).cast("double").alias("score"), place.alias("rank"), F.lit("lookup_document").alias("tool"))

    def __call__(self, hops: DataFrame) -> DataFrame:
        """hops: query_id, hop, query, route and, if there are any, volumes, q_from, q_to. Returns query_id, hop, id, score, rank, tool,
        relaxed and the passage's volume_id, document_id, ordinal, subtype, date_from, text."""
        hops = hops.withColumns({c: F.expr(e) for c, e in EMPTY_FILTERS.items() if c not in hops.columns})
        n = F.count("*").over(Window.partitionBy("query_id"))
        key = F.to_json(F.struct(F.col("query_id").cast("string").alias("q"), "hop"))
        hops = hops.withColumns({"k": F.when(n == 1, self.top_k).otherwise(self.per_hop), "key": key})
        looked_up = tables.kept(self._lookup(hops), "looked-up")
        asked = hops.where("route <> 'status'").join(looked_up.select("key").distinct(), "key", "left_anti")
        narrow = (F.coalesce(F.size("volumes"), F.lit(0)) > 0) | F.col("q_from").isNotNull() | F.col("q_to").isNotNull()
        asked = asked.withColumn("filtered", F.coalesce(narrow, F.lit(False)))
        keyed = asked.select(F.col("key").alias("query_id"), "query", "filtered", "volumes", "q_from", "q_to")
        citable = self.citable()
        limit = max(self.top_k, self.per_hop)
        wide = tables.kept(self.search(keyed.select("query_id", "query"), citable.select("id"), limit), "wide")
        pairs = filtered(keyed.where("filtered"), citable)
        some = tables.kept(self.search(keyed.where("filtered").select("query_id", "query"), pairs, limit), "narrow")
        narrowed = wide.join(keyed.where("not filtered").select("query_id"), "query_id", "left_semi").unionByName(some)
        hits = filters.relaxed(narrowed, wide.where(F.col("rank") <= self.top_k), keyed).withColumnRenamed("query_id", "key")
        tool = F.when((F.col("route") == "timeline") & ~F.col("relaxed"), "timeline_search").otherwise("hybrid_search")
        hits = hits.join(asked.select("key", "route", "k"), "key").where(F.col("rank") <= F.col("k")).select("key", "id", "score", "rank", tool.alias("tool"), "relaxed")
        every = hits.unionByName(looked_up.withColumn("relaxed", F.lit(False)))
        about = self.passages.select("id", "volume_id", "document_id", "ordinal", "subtype", "date_from", "text")
        out = tables.kept(every.join(hops.select("key", "query_id", "hop"), "key"), "hits").join(about, "id")  # few, and known to be: the texts don't move
        dated = Window.partitionBy("key").orderBy(F.coalesce(F.nullif("date_from", F.lit("")), F.lit("9999")), "id")
        rank = F.when(F.col("tool") == "timeline_search", F.row_number().over(dated)).otherwise(F.col("rank")).cast("long")
        return out.withColumn("rank", rank).select("query_id", "hop", "id", "score", "rank", "tool", "relaxed", "volume_id", "document_id", "ordinal", "subtype", "date_from", "text")


def reranked(merged: DataFrame, hops: DataFrame, questions: DataFrame, passages: DataFrame, top_k: int = TOP_K, union: int = UNION, scorer: Callable = retrieval.coverage) -> DataFrame:
    """Merged evidence (query_id, id, hop, score, position); of a question with several hops and more than top_k passages the best `union` by a score
    against the question itself (R-11)."""
    several = hops.groupBy("query_id").agg((F.count_distinct("hop") > 1).alias("several"))
    rows = merged.withColumn("n", F.count("*").over(Window.partitionBy("query_id"))).join(several, "query_id").withColumn("turn", F.col("several") & (F.col("n") > top_k))
    rows = tables.kept(rows, "merged")
    said = tables.kept(rows.where("turn").join(questions.select("query_id", "question"), "query_id"), "said").join(passages.select("id", "text"), "id")
    said = said.withColumn("score", scorer(F.col("question"), F.substring("text", 1, 1800)))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "position")).cast("long")
    said = said.withColumn("position", best).where(F.col("position") <= union)
    kept = ["query_id", "id", "hop", "score", "position"]
    return rows.where("not turn").select(*kept).unionByName(said.select(*kept))


def expanded(evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """Evidence (query_id, id, hop, score, position) with each passage's neighbours after it (C-3)."""
    rows = passages.select("volume_id", "document_id", "ordinal", F.col("id").alias("chunk_id"))
    out = chunks.with_neighbours(evidence.withColumnRenamed("id", "chunk_id"), rows)
    return out.select("query_id", F.col("chunk_id").alias("id"), "hop", "score", F.col("place").alias("position"))


def focused(evidence: DataFrame, questions: DataFrame, scorer: Callable = retrieval.coverage) -> DataFrame:
    """Evidence (query_id, id, position, text, ...) whose long passages keep the sentences that matter to the question and their neighbours (W-7)."""
    said = evidence.join(questions.select("query_id", "question"), "query_id").select("query_id", F.struct("position", "id").alias("passage"), "question", F.posexplode(text.sentences(F.col("text"))).alias("idx", "sentence"))
    said = said.withColumn("n_chars", F.length("sentence")).withColumn("score", scorer(F.col("question"), F.col("sentence")))
    short = select.focus(said).where("kept").groupBy("query_id", "passage").agg(F.array_sort(F.collect_list(F.struct("idx", "sentence"))).alias("s"))
    short = short.select("query_id", F.col("passage.id").alias("id"), F.array_join("s.sentence", " ").alias("short"))
    return evidence.join(short, ["query_id", "id"], "left").withColumn("text", F.coalesce("short", "text")).drop("short")
