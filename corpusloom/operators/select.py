"""Selection of evidence: merging rounds and hops, thresholds, synthesis windows, sentence focus, set steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources import tables

MARGIN = 4.3
NEAR_BEST = 2.0


def merge_hops(rows: DataFrame) -> DataFrame:
    """Rounds of evidence (query_id, id, hop, score, seen) as one list (W-2, U-1): an id once, with its best score and the hop
    that saw it first; hops take turns, each by score, the hop of the best score first. Rows are written
    first: Spark 4.1 takes a union of arms that are dealt alike as still dealt so when adaptive execution has rewritten them, and then groups
    parts of a query apart; dealing them anew doesn't help, as it takes that for done."""
    one = tables.kept(rows, "rounds").groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min_by("hop", "seen").alias("hop"))
    one = one.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", "hop").orderBy(F.col("score").desc(), "id")))
    one = one.withColumn("best", F.max("score").over(Window.partitionBy("query_id", "hop")))
    order = Window.partitionBy("query_id").orderBy("turn", F.col("best").desc(), "hop")
    return one.select("query_id", "id", "hop", "score", F.row_number().over(order).cast("long").alias("position"))


def select_evidence(rows: DataFrame, absolute: float | None = None, margin: float | None = MARGIN, min_per_hop: int = 3, max_per_hop: int | None = None) -> DataFrame:
    """rows (query_id, hop, id, position, score) with `kept` (W-3). The floor is the absolute one or the query's best less the
    margin, whichever is higher. Unscored rows stay, whatever the cap: nothing has judged them. Each hop keeps its best
    min_per_hop scored rows, and max_per_hop of them at most; the cap wins. Without scores or any threshold all rows stay. A null hop
    is the main one."""
    if absolute is None and margin is None and max_per_hop is None:
        return rows.withColumn("kept", F.lit(True))
    scored = F.col("score").isNotNull()
    hop = F.coalesce("hop", F.lit("main"))
    q, h = Window.partitionBy("query_id"), Window.partitionBy("query_id", hop).orderBy(F.col("score").desc_nulls_last(), "position")
    best = F.max("score").over(q)
    floors = [x for x in (F.lit(absolute) if absolute is not None else None, best - margin if margin is not None else None) if x is not None]
    floor = F.greatest(*floors) if len(floors) > 1 else floors[0] if floors else None
    place = F.row_number().over(h)  # scored rows come first
    kept = (F.col("score") >= floor) | (place <= min_per_hop) if floor is not None else F.lit(True)
    if max_per_hop is not None:
        kept = kept & (place <= max_per_hop)  # what is kept of a hop's scored rows are its best
    return rows.withColumn("kept", ~scored | kept)


def graded(evidence: DataFrame, judgements: DataFrame, window: int = 10) -> DataFrame:
    """evidence (query_id, id, position) with `kept` by a model's judgements (query_id, hop, rejected ids): what is within the window that it
    was shown goes if every hop rejects it; what it wasn't shown, and all of a query that it failed to judge, stays (N-4)."""
    shown = F.row_number().over(Window.partitionBy("query_id").orderBy("position")) <= window
    no = judgements.select("query_id", "hop", F.explode("rejected").alias("id"))
    gone = rejected_by_all(no, judgements).where("by_all").select("query_id", "id", F.lit(True).alias("__gone"))
    return evidence.withColumn("__shown", shown).join(gone, ["query_id", "id"], "left").withColumn("kept", ~F.col("__shown") | F.col("__gone").isNull()).drop("__shown", "__gone")


def unsupported(judgements: DataFrame) -> DataFrame:
    """Hops (query_id, hop, missing) that a model's judgement (verdict, corrective) doesn't call supported; missing is the corrective
    query, or the hop's id."""
    return judgements.where("verdict <> 'supported'").select("query_id", "hop", F.coalesce(F.nullif("corrective", F.lit("")), "hop").alias("missing"))


def missing_hops(rows: DataFrame, hops: DataFrame, absolute: float | None) -> DataFrame:
    """(query_id, hop) whose best score is below the absolute floor or that have none; no rows without a floor (W-4)."""
    if absolute is None:
        return hops.select("query_id", "hop").where(F.lit(False))
    best = rows.groupBy("query_id", "hop").agg(F.max("score").alias("best"))
    return hops.select("query_id", "hop").join(best, ["query_id", "hop"], "left").where(F.coalesce(F.col("best") < absolute, F.lit(True))).select("query_id", "hop")


def score_rows(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Diagnostic rows: position from 0, hop or "main", whether the document is gold (W-5)."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("position")) - 1
    return rows.join(gold.select("query_id", "document", F.lit(True).alias("g")).distinct(), ["query_id", "document"], "left").select(
        "query_id", "document", at.cast("long").alias("at"), F.coalesce("hop", F.lit("main")).alias("hop"), F.coalesce("g", F.lit(False)).alias("is_gold"), "score"
    )


def synthesis_window(rows: DataFrame, documents: int = 14, total: int = 18) -> DataFrame:
    """The best chunk of each of the best documents, then further chunks by score up to the total (W-6)."""
    rows = rows.withColumn("__d", F.row_number().over(Window.partitionBy("query_id", "document").orderBy(F.col("score").desc(), "id")))
    rank = F.row_number().over(Window.partitionBy("query_id", F.col("__d") == 1).orderBy(F.col("score").desc(), "id"))
    rows = rows.withColumn("__r", rank).withColumn("__first", (F.col("__d") == 1) & (F.col("__r") <= documents))
    order = Window.partitionBy("query_id").orderBy(F.col("__first").desc(), F.col("score").desc(), "id")
    return rows.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= total).drop("__d", "__r", "__first")


def focus(sentences: DataFrame, top: int = 4, around: int = 1, pairs: int = 400) -> DataFrame:
    """sentences (query_id, passage, idx, n_chars, score) with `kept` (W-7): of passages of 400 characters and more than four
    sentences, the best four and their neighbours, as long as the running number of sentences, passage by passage, is
    within the cap; what comes later, and other passages, stay whole."""
    passage = Window.partitionBy("query_id", "passage")
    rows = sentences.withColumn("__long", (F.sum("n_chars").over(passage) >= 400) & (F.count("*").over(passage) > 4))
    running = F.sum(F.when(F.col("__long"), 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("passage").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__in", F.col("__long") & (running <= pairs))
    rows = rows.withColumn("__top", F.row_number().over(passage.orderBy(F.col("score").desc(), "idx")) <= top)
    near = F.max(F.col("__top")).over(passage.orderBy("idx").rowsBetween(-around, around))
    return rows.withColumn("kept", ~F.col("__in") | near).drop("__long", "__in", "__top")


def claim_pairs(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each claim with each piece of its query's evidence (C-5)."""
    return claims.join(evidence, "query_id")


def attribute(pairs: DataFrame, top: int = 3, within: float = NEAR_BEST) -> DataFrame:
    """For each claim its best passages that are near the best one (W-8, JN-K). pairs: query_id, claim, id, score."""
    w = Window.partitionBy("query_id", "claim").orderBy(F.col("score").desc(), "id")
    rows = pairs.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("__best", F.first_value("score").over(w))
    return rows.where((F.col("rank") <= top) & (F.col("score") >= F.col("__best") - within)).drop("__best")


def rejected_by_all(rejections: DataFrame, hops: DataFrame) -> DataFrame:
    """Ids with whether every hop of their query rejects them, or only some (U-3). Rejections are often a union; see `merge_hops`."""
    n = hops.groupBy("query_id").agg(F.count_distinct("hop").alias("n_hops"))
    per = tables.kept(rejections.select("query_id", "id", "hop"), "rejections").groupBy("query_id", "id").agg(F.count_distinct("hop").alias("n"))
    return per.join(n, "query_id").select("query_id", "id", (F.col("n") == F.col("n_hops")).alias("by_all"))


def surviving(evidence: DataFrame, rejections: DataFrame, hops: DataFrame) -> DataFrame:
    """Evidence that not every hop rejects; what none has judged stays (U-4)."""
    return evidence.join(rejected_by_all(rejections, hops).where("by_all"), ["query_id", "id"], "left_anti")


def documents_of(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "document").distinct()  # U-2


def jaccard(a, b):
    """Overlap of two arrays as sets; 1 if both are empty (U-5, G-25)."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def in_order(a):
    return F.array_distinct(a)  # U-6


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by a hash of seed and id: the same rows however the table is dealt (T-5)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col))), id_col).limit(n)


def per_stratum(df: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """The first n rows of each stratum (T-6)."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("__k") <= n).drop("__k")
