"""Aggregates over documents and chunks: statistics, reassembly, rare entities, distinctive titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text


def stats(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: volumes by status, document counts, chunks, embedded (G-1)."""
    m = manifest.agg(
        F.count_if(F.col("status") == "published").alias("published"), F.count_if(F.col("status") != "published").alias("planned"),
        F.sum("n_documents").alias("n_documents"), F.sum("n_historical").alias("n_historical"), (F.sum("n_documents") - F.sum("n_historical")).alias("n_editorial"),
    )
    return m.crossJoin(chunks.agg(F.count("*").alias("n_chunks"), F.count_if("embedded").alias("n_embedded")))


def reassemble(chunks: DataFrame, least: int = 400, n: int | None = None) -> DataFrame:
    """Documents from their chunks in order, with a sorted union of persons (G-2)."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    out = chunks.groupBy("volume_id", "document_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count("*").alias("n_chunks"), F.min_by("head", "ordinal").alias("head"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("persons")))).alias("persons")
    ).where(F.length("text") > least)
    return out.orderBy("volume_id", "document_id").limit(n) if n else out


def extrapolated(parsed_documents, parsed_chunks, documents):
    """Chunks to expect of all documents; 0 if none has been parsed (G-3)."""
    return F.when(parsed_documents > 0, F.bround(parsed_chunks / parsed_documents * documents)).otherwise(0).cast("long")


def rare_entities(docs: DataFrame, lo: int, hi: int) -> DataFrame:
    """Entities in lo to hi documents whose text has them (G-4). docs: document, text, persons."""
    rows = docs.select("document", "text", F.explode("persons").alias("entity")).where(F.contains("text", F.col("entity")))
    n = rows.groupBy("entity").agg(F.count_distinct("document").alias("df"), F.min("document").alias("first"))
    return n.where(F.col("df").between(lo, hi))


def name_shaped(c):
    return (F.length(c) >= 5) & F.regexp_replace(c, "[ .]", "").rlike(r"^\p{L}+$")  # F-19


def title_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(text.collapse(F.lower(text.unnumbered(F.col("head")))).alias("title")).agg(F.count("*").alias("n"))  # G-6


def distinctive_titles(docs: DataFrame, lo: int = 40, hi: int = 160) -> DataFrame:
    """Titles of one document, of more than lo and fewer than hi characters (G-7)."""
    return docs.groupBy("head").agg(F.count("*").alias("n"), F.min("document").alias("document")).where((F.col("n") == 1) & (F.length("head") > lo) & (F.length("head") < hi)).select("head", "document")


def unique_pairs(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Documents that are the only one with their (word, date) (G-8). words: a small dictionary (word); whole words count.
    Documents are matched by their tokens, an equi-join."""
    rows = docs.select("document", "date_from", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("word")).where("date_from <> ''").join(words, "word")
    return rows.groupBy("word", "date_from").agg(F.count("*").alias("n"), F.min("document").alias("document")).where("n = 1").select("word", "date_from", "document")


def dated_windows(docs: DataFrame, least: int = 12, lo: int = 3, hi: int = 8) -> DataFrame:
    """Volumes with enough dated documents: the dates of the lo-th and hi-th, and the documents between (G-9)."""
    dated = docs.where("date_from <> ''")
    n = Window.partitionBy("volume_id")
    rows = dated.withColumn("k", F.row_number().over(n.orderBy("date_from", "document"))).withColumn("n", F.count("*").over(n)).where(F.col("n") >= least)
    ends = rows.groupBy("volume_id").agg(F.max(F.when(F.col("k") == lo, F.col("date_from"))).alias("first"), F.max(F.when(F.col("k") == hi, F.col("date_from"))).alias("last"))
    return rows.join(ends, "volume_id").where(F.col("date_from").between(F.col("first"), F.col("last"))).groupBy("volume_id", "first", "last").agg(F.count("*").alias("n_inside"))


def edges_within(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """References to other documents that exist in the same volume; the first of each volume (A-17, JN-N)."""
    ok = edges.where("document_id <> target").join(docs.select("volume_id", F.col("document_id").alias("target")), ["volume_id", "target"], "left_semi")
    k = F.row_number().over(Window.partitionBy("volume_id").orderBy("position", "target"))
    return ok.withColumn("__k", k).where("__k = 1").select("volume_id", "document_id", "target")


def subset(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """One row: how many of a's values b lacks (JN-O)."""
    return a.select(on).distinct().join(b.select(on).distinct(), on, "left_anti").agg(F.count("*").alias("n_missing"))
