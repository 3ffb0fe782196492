"""The corpus pipeline: stages over documents, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.

Odd input, alike in all stages: a null text is empty; empty and wordless texts are documents like others (near-dedup keeps one
of them, the other stages change nothing in them); a text may be as long as a task's memory allows, some tens of times its size, and
is always read whole; equal rows count as copies; a null doc_id comes after all others; null source and lang are
groups of their own; an empty table gives an empty table; columns beside those of documents are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import mixing, pieces, quality, similar, substring
from corpusloom.llm.common import drop, keep, kept_now, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash links and, as these miss most pairs at a similarity
    of 0.8 of five-word shingles, bands of least shingles, all verified exactly."""
    return similar.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that started earlier in the corpus go; the documents stay."""
    return substring.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the source mixture. Files don't keep an order when read: the last stage gives each
    document its place."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to, and the document's slot and
    position in the source mixture."""
    import public_tokenizers

    placed = mixing.place(docs.select("doc_id", "source", "text")).select("row.doc_id", "row.text", "place.slot", "place.position")
    return pieces.encode_decode(placed, public_tokenizers.path(pieces.MODEL), with_values=True, also=("slot", "position")).drop("decoded")


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", encode),
]

#: None: the fingerprints and token ids of the stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again for the next. When a stage is written,
    its predecessor's table and its own intermediate ones go."""
    docs, before = table(spark, sf_dir, "documents"), set(kept_now())
    for name, stage in STAGES[:-1]:
        docs, path = keep(stage(spark, docs, sf_dir), name.split()[0])
        drop(spark, *(p for p in kept_now() if p not in before and p != path))
    return STAGES[-1][1](spark, docs, sf_dir)
