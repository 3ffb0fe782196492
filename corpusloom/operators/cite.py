"""The citation gate: every id that a claim cites is held against what was retrieved, accepted and published."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.sources import tables

CITABLE = ("historical-document",)


def cited(claims: DataFrame, evidence: DataFrame, accepted: DataFrame | None, manifest: DataFrame) -> DataFrame:
    """A row for each id of each claim with `refusal`, null if the id is good (JN-J, N-8). claims: query_id, claim, ids;
    evidence: query_id, id, volume_id, subtype; accepted: query_id, id, or None if all that was retrieved counts;
    manifest: volume_id, status, not asked if empty. The first reason that holds is given. The manifest is often grouped from all documents: it is
    written, once, so that it is known to be small and the ids don't move to meet it, by volume or all those without one together."""
    manifest = tables.kept(manifest.select("volume_id", "status").distinct(), "manifest")
    rows = claims.select("query_id", "claim", F.explode("ids").alias("id"))
    got = evidence.select("query_id", "id", "volume_id", "subtype", F.lit(True).alias("__got")).dropDuplicates(["query_id", "id"])
    rows = rows.join(got, ["query_id", "id"], "left")
    if accepted is None:
        rows = rows.withColumn("__accepted", F.lit(True))
    else:
        rows = rows.join(accepted.select("query_id", "id", F.lit(True).alias("__accepted")).distinct(), ["query_id", "id"], "left")
    known = manifest.agg((F.count("*") > 0).alias("__known"))
    rows = rows.join(manifest, "volume_id", "left").crossJoin(known)
    reason = (
        F.when(~text.is_chunk_id(F.col("id")), "malformed")
        .when(F.col("__got").isNull(), "not retrieved")
        .when(F.col("__accepted").isNull(), "not accepted")
        .when(F.col("__known") & F.coalesce(F.col("status") != "published", F.lit(True)), "not published")
        .when(~F.col("subtype").isin(*CITABLE), "not citable")
    )
    return rows.select("query_id", "claim", "id", reason.alias("refusal"))


def gate(queries: DataFrame, claims: DataFrame, checked: DataFrame) -> DataFrame:
    """One row a query: number of claims, claims without a good id, claims with a URL of the model's own, and the blocking
    error, if any (N-7, N-8). claims: query_id, claim, text, ids."""
    good = checked.groupBy("query_id", "claim").agg(F.count_if(F.col("refusal").isNull()).alias("good"))
    per = claims.join(good, ["query_id", "claim"], "left").groupBy("query_id").agg(
        F.count("*").alias("n_claims"), F.count_if(F.coalesce("good", F.lit(0)) == 0).alias("n_uncited"), F.count_if(F.col("text").rlike(r"https?://")).alias("n_urls")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = queries.select("query_id").join(per, "query_id", "left").select("query_id", zero("n_claims").alias("n_claims"), zero("n_uncited").alias("n_uncited"), zero("n_urls").alias("n_urls"))
    return out.withColumn("blocked", F.when(F.col("n_claims") == 0, "no claims").when(F.col("n_uncited") == F.col("n_claims"), "nothing cited").when(F.col("n_urls") > 0, "written url"))


def repair(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """Claims with their good ids only, in their order (N-9)."""
    bad = checked.where("refusal is not null").groupBy("query_id", "claim").agg(F.collect_set("id").alias("__bad"))
    out = claims.join(bad, ["query_id", "claim"], "left")
    return out.withColumn("ids", F.when(F.col("__bad").isNull(), F.col("ids")).otherwise(F.array_except("ids", "__bad"))).drop("__bad")


def drop_uncited(claims: DataFrame) -> DataFrame:
    return claims.where(F.size("ids") > 0)  # N-9


def verified(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims that a verifier hasn't denied; one without a verdict counts as supported (N-10)."""
    v = verdicts.groupBy("query_id", "claim").agg(F.bool_and("supported").alias("__ok"))
    return claims.join(v, ["query_id", "claim"], "left").where(F.coalesce("__ok", F.lit(True))).drop("__ok")


def passage_share(n):
    """Characters of each of n passages that a verifier is shown (N-10)."""
    return F.greatest(F.lit(300), F.floor(F.lit(900) / n)).cast("int")


def citation_lines(rows: DataFrame, base: str) -> DataFrame:
    """A numbered line for each cited document, by volume and document: its first chunk's head and address (W-9)."""
    first = F.row_number().over(Window.partitionBy("query_id", "volume_id", "document_id").orderBy("id"))
    one = rows.withColumn("__k", first).where("__k = 1").drop("__k")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("volume_id", "document_id"))
    url = text.canonical_url(base, F.col("volume_id"), F.col("document_id"))
    return one.withColumn("number", number.cast("long")).withColumn("line", text.citation_line(F.col("number"), F.col("head"), F.col("volume_id"), F.col("document_id"), url))


def answers(queries: DataFrame, claims: DataFrame, evidence: DataFrame, gated: DataFrame) -> DataFrame:
    """One nested row a query: outcome, claims, cited and retrieved documents, reasons (N-11, N-14)."""
    c = claims.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("claim", "text", "ids"))).alias("claims"))
    e = evidence.groupBy("query_id").agg(F.count_distinct("id").alias("n_retrieved"))
    out = queries.select("query_id").join(gated, "query_id", "left").join(c, "query_id", "left").join(e, "query_id", "left")
    answered = F.col("blocked").isNull() & F.col("claims").isNotNull()
    return out.select("query_id", F.when(answered, "answered").otherwise("abstained").alias("outcome"), F.when(answered, F.col("claims")).alias("claims"), F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"), F.when(~answered, F.coalesce("blocked", F.lit("no claims"))).alias("reason"))
