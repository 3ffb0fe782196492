"""Documents to overlapping chunks, and rows around a chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text

SIZE, OVERLAP = 512, 64


def windows(n, size: int = SIZE, overlap: int = OVERLAP):
    """Number of windows over n tokens: none over none, else up to the first that reaches the last token."""
    if size <= overlap:
        raise ValueError("the stride must be positive")
    return F.when(n > 0, 1 + F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap)))).otherwise(0).cast("int")


def chunk(
    docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, spans: Callable[[Column], Column] | None = None, cut: Callable[[Column, int, int], Column] | None = None
) -> DataFrame:
    """A row for each window of tokens (C-1): chunk_id, ordinal, n_chunks_in_doc, n_tokens (of the body), text (head and
    empty line, if there is a head, and the body), and those of the documents' doc_number and persons that they have. Tokens
    are what stands between white space, or what `spans` makes of the text: an array of structs of start and end, in characters from 0, the end
    excluded (X-4). The body is cut from the first token's start to the last one's end. A window whose body is blank gives no
    row, but its ordinal is used up. `cut` gives the windows themselves (an array of structs of ordinal, body and n_tokens), so that tokens needn't
    leave the function that makes them."""
    stride = size - overlap

    def window(k: Column) -> Column:
        part = F.slice("__t", k * stride + 1, F.lit(size))
        if spans is None:
            body = F.array_join(part, "")
        else:
            start, end = F.element_at(part, 1)["start"], F.element_at(part, -1)["end"]
            body = F.substr(F.col("text"), start + 1, end - start)
        return F.struct(k.alias("ordinal"), body.alias("body"), F.size(part).alias("n_tokens"))

    # A text's windows are made before they are dealt to rows, so no row but the text's own carries all its tokens. Texts without
    # any go with the blank windows: a condition on the tokens would be moved to where they are made, and make them twice.
    if cut is not None:
        made = docs.withColumn("__ws", cut(F.col("text"), size, overlap)).withColumn("__n", F.size("__ws"))
        rows = made.withColumn("__w", F.explode_outer("__ws")).drop("__ws")
    else:
        tokens = docs.withColumn("__t", F.regexp_extract_all(F.col("text"), F.lit(r"\s*\S+"), F.lit(0)) if spans is None else spans(F.col("text")))
        tokens = tokens.withColumn("__n", windows(F.size("__t"), size, overlap))
        rows = tokens.withColumn("__w", F.explode_outer(F.when(F.col("__n") > 0, F.transform(F.sequence(F.lit(0), F.col("__n") - 1), window)))).drop("__t")
    rows = rows.where(F.col("__w.body").rlike(f"[^{text.SPACE}]")).withColumns({"ordinal": F.col("__w.ordinal"), "__body": text.stripped(F.col("__w.body"))})
    prefix = F.when(F.coalesce("head", F.lit("")) != "", F.concat("head", F.lit("\n\n"))).otherwise(F.lit(""))
    return rows.select(
        F.concat_ws(":", "volume_id", "document_id", "ordinal").alias("chunk_id"), "volume_id", "document_id", "ordinal", F.col("__n").alias("n_chunks_in_doc"), "subtype", "head", "date_from", "date_to",
        *(c for c in ("doc_number", "persons") if c in docs.columns), F.concat(prefix, "__body").alias("text"), F.col("__w.n_tokens").alias("n_tokens"),
    )


def adjacent(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each anchor (chunk_id) its neighbours in the same document (C-2, JN-L). Ids that aren't chunk ids have none."""
    a = anchors.where(F.col("chunk_id").rlike(r"^[A-Za-z0-9\-.]+:[A-Za-z0-9_\-.]+:\d+$"))
    a = a.select(F.col("chunk_id").alias("anchor_id"), F.substring_index("chunk_id", ":", 1).alias("volume_id"), F.substring_index(F.substring_index("chunk_id", ":", -2), ":", 1).alias("document_id"), F.substring_index("chunk_id", ":", -1).cast("int").alias("at"))
    a = a.withColumn("ordinal", F.explode(F.array(F.col("at") - 1, F.col("at") + 1)))
    return a.join(chunks.select("volume_id", "document_id", "ordinal", "chunk_id"), ["volume_id", "document_id", "ordinal"]).select("anchor_id", "chunk_id", "ordinal")


def with_neighbours(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence (query_id, position, chunk_id, score, hop) with each row's neighbours after it, where they aren't there
    already and no earlier row has brought them (C-3)."""
    near = adjacent(evidence.select("chunk_id").distinct(), chunks).withColumnRenamed("chunk_id", "near_id")
    new = evidence.join(near, evidence.chunk_id == near.anchor_id).select("query_id", "position", F.col("near_id").alias("chunk_id"), (F.col("score") - 1e-6).alias("score"), "hop", "ordinal")
    new = new.join(evidence.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("position"))
    new = new.withColumn("__k", first).where("__k = 1").drop("__k")
    both = evidence.withColumn("ordinal", F.lit(-1)).select("query_id", "position", "chunk_id", "score", "hop", "ordinal").unionByName(new.select("query_id", "position", "chunk_id", "score", "hop", "ordinal"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position", "ordinal")).cast("long")
    return both.withColumn("place", place).drop("ordinal")


def sentence_rows(passages: DataFrame, sentences) -> DataFrame:
    """A row for each sentence of each passage (C-4)."""
    return passages.select("chunk_id", F.posexplode(sentences).alias("idx", "sentence"))
