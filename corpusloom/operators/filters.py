"""Filters over documents and chunks, and the relational steps around them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.sources import tables


@dataclass(frozen=True)
class Filters:
    """What a search may return. Dates are ISO text and compared as text: undated rows ("") fall to a lower
    bound and pass an upper one alone. Values are checked when the filter is made, though Column literals
    can't be taken for SQL anyway."""

    volume_ids: tuple[str, ...] = ()
    subtypes: tuple[str, ...] = ()
    date_from: str | None = None
    date_to: str | None = None
    exclude: tuple[str, ...] = ()  # volume:document
    persons: tuple[str, ...] = field(default=(), kw_only=True)
    match_persons: bool = field(default=False, kw_only=True)

    def __post_init__(self) -> None:
        for x in (*self.volume_ids, *self.subtypes, *self.exclude, self.date_from or "", self.date_to or ""):
            if not re.fullmatch(r"[\w\-.:/ ]{0,120}", x):  # F-6
                raise ValueError(f"not a filter value: {x!r}")

    def conditions(self) -> list[Column]:
        out = []
        if self.volume_ids:
            out.append(F.col("volume_id").isin(*self.volume_ids))  # F-1
        if self.subtypes:
            out.append(F.col("subtype").isin(*self.subtypes))  # F-2
        if self.date_from:
            out.append(F.col("date_to") >= self.date_from)  # F-3
        if self.date_to:
            out.append(F.col("date_from") <= self.date_to)
        for x in self.exclude:  # F-4; what isn't volume:document excludes nothing
            volume, colon, document = x.partition(":")
            if colon and volume and document:
                out.append(~((F.col("volume_id") == volume) & (F.col("document_id") == document)))
        if self.persons and self.match_persons:  # F-20, by choice
            out.append(F.arrays_overlap("persons", F.array(*map(F.lit, self.persons))))
        return out

    def column(self) -> Column:
        """All conditions together (F-5); true if there are none."""
        return reduce(lambda a, b: a & b, self.conditions(), F.lit(True))


def apply(df: DataFrame, filters: Filters) -> DataFrame:
    conditions = filters.conditions()
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def excluding(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Without the documents of a table (volume_id, document_id), however many (F-4, F-18)."""
    return df.join(excluded.select("volume_id", "document_id"), ["volume_id", "document_id"], "left_anti")


def guarded(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one identifier; none if it isn't one (F-7)."""
    return df.where(F.col(column) == value) if re.fullmatch(r"[A-Za-z0-9\-._]+", value) else df.where(F.lit(False))


def embedded(df: DataFrame, vector: str = "vector") -> DataFrame:
    return df.where(F.col(vector).isNotNull())  # F-10


def published(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("status") == "published")  # F-11


def containing(df: DataFrame, terms: DataFrame, id_col: str, body: str = "text") -> DataFrame:
    """(term, row) pairs where the row's text has the term (F-12); id_col tells rows apart. Rows and terms meet by an equi-join on
    a word of the text, and what meets is verified. A term of three words or more can only be where its inner words stand between
    white space, so the longest of these is the word. Of a shorter one, the longer part lies within a word (alone), at a word's end (the first of
    two parts) or start (the second): the words that have it so are found among the corpus's different words, not its
    texts. Only terms of nothing but white space are put to each text."""
    parts = F.split("term", r"\s+")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.reduce(inner, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    how = F.when(longest != "", "whole").when(F.size(parts) == 1, "within").when(F.length(first) >= F.length(last), "end").otherwise("start")
    keyed = terms.withColumn("__how", how).withColumn("__part", F.when(F.col("__how") == "whole", longest).when(F.col("__how") == "start", last).otherwise(first))
    keyed = tables.kept(keyed.withColumn("__n", F.monotonically_increasing_id()), "terms")  # numbers stand for terms in what is joined below
    own = [*terms.columns]
    hows = {r[0] for r in keyed.select(F.when(F.col("__part") == "", "blank").otherwise(F.col("__how"))).distinct().collect()}  # five at most
    words = df.select(F.col(id_col).alias("__id"), F.explode(F.array_distinct(F.split(body, r"\s+"))).alias("__word"))
    pairs = words.join(keyed.where("__how = 'whole'").select(F.col("__part").alias("__word"), "__n"), "__word").select("__id", "__n")
    if hows & {"within", "start", "end"}:  # only then are the corpus's different words asked for
        part, word, mode = F.col("__part"), F.col("__word"), F.col("__how")
        fits = F.when(mode == "within", F.contains(word, part)).when(mode == "end", F.endswith(word, part)).otherwise(F.startswith(word, part))
        short = tables.kept(words.select("__word").distinct().join(keyed.where("__how <> 'whole' and __part <> ''"), fits).select("__word", "__n"), "words")
        pairs = pairs.unionByName(words.join(short, "__word").select("__id", "__n"))
    pairs = tables.kept(pairs, "pairs").distinct()  # their size is known, so few of them don't move the texts
    texts = df.join(pairs, F.col(id_col) == F.col("__id")).drop("__id")
    found = texts.join(keyed.select("__n", *own), "__n").drop("__n").where(F.contains(F.col(body), F.col("term"))).select(*df.columns, *own)
    return found.unionByName(df.join(keyed.where("__part = ''").select(*own), F.contains(F.col(body), F.col("term")))) if "blank" in hows else found


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each titled, dated document (F-13)."""
    return chunks.where((F.col("subtype") == "historical-document") & (F.col("ordinal") == 0) & (F.col("head") != "") & (F.col("date_from") != ""))


def series_status(manifest: DataFrame, needle: str, n: int = 20) -> DataFrame:
    """The first n volumes, by id, whose id, title or series has the needle, with the totals of all that do (F-14)."""
    hits = [F.contains(F.lower(F.col(c)), F.lit(needle.lower())) for c in ("volume_id", "title", "sub_series")]
    found = manifest.where(hits[0] | hits[1] | hits[2])
    totals = found.agg(F.count_if(F.col("status") == "published").alias("n_published"), F.count_if(F.col("status") != "published").alias("n_planned"))
    return found.orderBy("volume_id").limit(n).crossJoin(totals).select("volume_id", "status", "n_published", "n_planned")


def relaxed(hits: DataFrame, wider: DataFrame, queries: DataFrame) -> DataFrame:
    """The hits; for queries with volume or date filters and without any, those of the wider search (F-15)."""
    none = queries.where("filtered").join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    return hits.withColumn("relaxed", F.lit(False)).unionByName(wider.join(none, "query_id", "left_semi").withColumn("relaxed", F.lit(True)))


def resolve_volumes(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """(candidate, volume_id, how): by exact id, else by the alias of an id or title, the least id first; else
    dropped (F-16, JN-D). An empty manifest lets all pass."""
    ids = manifest.select(F.col("volume_id").alias("exact"))
    aliases = manifest.select(F.explode(F.array(text.key(F.col("volume_id")), text.key(F.col("title")))).alias("alias"), "volume_id").where("alias <> ''")
    aliases = aliases.groupBy("alias").agg(F.min("volume_id").alias("by_alias"))
    known = manifest.agg((F.count("*") > 0).alias("known"))
    out = candidates.join(ids, F.col("candidate") == F.col("exact"), "left").withColumn("alias", text.key(F.col("candidate"))).join(aliases, "alias", "left").crossJoin(known)
    how = F.when(~F.col("known"), "passed").when(F.col("exact").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").otherwise("dropped")
    return out.select("candidate", F.when(~F.col("known"), F.col("candidate")).otherwise(F.coalesce("exact", "by_alias")).alias("volume_id"), how.alias("how"))


def overlapping(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose dates overlap each query's (JN-Q), bucketed by year so that it is an equi-join: a pair meets
    in the later of its two first years."""
    years = lambda a, b: F.explode(F.sequence(F.substring(a, 1, 4).cast("int"), F.substring(b, 1, 4).cast("int")))
    q = queries.where("q_from <= q_to").withColumn("year", years("q_from", "q_to"))
    d = docs.where("date_from <> '' and date_from <= date_to").withColumn("year", years("date_from", "date_to"))
    later = F.greatest(F.substring("q_from", 1, 4).cast("int"), F.substring("date_from", 1, 4).cast("int"))
    return q.join(d, "year").where((F.col("year") == later) & (F.col("date_to") >= F.col("q_from")) & (F.col("date_from") <= F.col("q_to"))).drop("year")


def latest_first(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order that has no ties left."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)
