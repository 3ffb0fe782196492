"""Evaluation over tables of runs. Empty denominators give null, never 0; unjudged is null and left out of means."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources import tables

LABELS = ["simple", "lookup", "timeline", "complex", "status"]


def recall(gold: Column, found: Column) -> Column:
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, F.size(F.array_intersect(gold, found)) / n)  # G-10, JN-G


def precision(gold: Column, found: Column) -> Column:
    return recall(found, gold)


def mean(c: Column, digits: int = 4) -> Column:
    return F.bround(F.avg(c), digits)  # G-11


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """The rank p (n - 1) from 0, rounded half to even, of n values (G-12)."""
    return lambda n: F.bround(F.lit(p) * (n - 1), 0)


def floor_rank(q: float) -> Callable[[Column], Column]:
    """The rank floor(q n) from 0, the last at most (G-18): another definition than nearest_rank."""
    return lambda n: F.least(n - 1, F.floor(F.lit(q) * n))


BINS = 256  # ranges of values in the first pass of a selection


def values_at(rows: DataFrame, by: list[str], value: Column, ranks: dict[str, Callable[[Column], Column]], weight: Column | None = None) -> DataFrame:
    """For each group with values: the values at the ranks, by two passes over the counts of different values. The first adds the counts up by range of values (edges are quantiles
    over all groups, `BINS` numbers), which tells the range that each rank is in; the second orders the values of these ranges only. No
    window holds a whole group. weight: how often a row counts."""
    one = F.lit(1).cast("long") if weight is None else weight
    counts = rows.select(*by, value.alias("__v"), one.alias("__w")).where("__v is not null and __w > 0").groupBy(*by, "__v").agg(F.sum("__w").alias("__c"))
    counts = tables.kept(counts.withColumn("__key", F.to_json(F.struct(F.lit(0), *by), {"ignoreNullFields": "false"})), "values")
    as_double = F.col("__v").cast("double")
    edges = counts.agg(F.percentile_approx(F.when(~F.isnan(as_double), as_double), [k / BINS for k in range(1, BINS)], 10 * BINS)).first()[0] or []
    inner = sorted({x for x in edges if abs(x) != float("inf")}) or [0.0]
    ranges = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="__d", outputCol="__bin", handleInvalid="keep")  # NaN comes last, as it sorts
    counts = ranges.transform(counts.withColumn("__d", as_double)).drop("__d")
    sums = counts.groupBy("__key", "__bin").agg(F.sum("__c").alias("__s"), *(F.first(c).alias(c) for c in by))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy("__key").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__before", before).withColumn("__n", F.sum("__s").over(Window.partitionBy("__key")))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("__name"), r(F.col("__n")).cast("long").alias("__rank")) for name, r in ranks.items())))
    found = sums.select("__key", "__bin", "__before", "__s", wanted.alias("__r")).select("__key", "__bin", "__before", "__s", "__r.*").where("__rank >= __before and __rank < __before + __s")
    near = counts.select("__key", "__bin", "__v", "__c").join(found, ["__key", "__bin"])
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy("__key", "__bin", "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = near.withColumn("__to", upto).where("__rank < __to").groupBy("__key").agg(*(F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks))
    groups = sums.groupBy("__key").agg(*(F.first(c).alias(c) for c in by))
    return groups.join(per, "__key").select(*by, *ranks)


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with right's other columns, by keys that may be null."""
    keyed = right.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in right.columns if c not in by))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by), F.lit(True))
    return left.join(keyed, same, "left").drop(*(f"__{c}" for c in by))


def macro_f1(runs: DataFrame, by: str, expected: str = "expected_route", actual: str = "actual_route") -> DataFrame:
    """Mean F1 of the labels that occur on either side (G-13)."""
    n = runs.groupBy(by, expected, actual).agg(F.count("*").alias("n"))
    labelled = n.withColumn("label", F.explode(F.array_distinct(F.array(expected, actual)))).where(F.col("label").isin(LABELS))
    per = labelled.groupBy(by, "label").agg(
        F.sum(F.when((F.col(expected) == F.col("label")) & (F.col(actual) == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.coalesce(F.col(expected) != F.col("label"), F.lit(True)), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.coalesce(F.col(actual) != F.col("label"), F.lit(True)), F.col("n")).otherwise(0)).alias("fn"),
    )
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return per.groupBy(by).agg(F.round(F.avg(f1), 6).alias("macro_f1"))


def _share(condition: Column, among: Column | None = None) -> Column:
    base = F.when(among, 1) if among is not None else F.lit(1)
    hit = F.count_if(condition & among if among is not None else condition)
    return F.bround(hit / F.nullif(F.count(base), F.lit(0)), 4)


def summarise(runs: DataFrame, *by: str) -> DataFrame:
    """The metrics of each group of runs (G-14, G-26, G-33). Errors are left out but counted."""
    ok = runs.withColumn("ok", F.col("outcome") != "error")
    a, u = F.col("ok") & F.col("answerable"), F.col("ok") & ~F.col("answerable")
    abst, ok_ = F.col("outcome") == "abstained", F.col("ok")
    m = lambda c, where=ok_: mean(F.when(where, F.col(c)))
    seconds = values_at(ok, list(by), F.when(ok_, F.col("latency_s")), {"p50_s": nearest_rank(0.5), "p95_s": nearest_rank(0.95)})
    rows = ok.groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.count_if(~ok_).alias("n_errors"), F.count_if(a).alias("n_answerable"), F.count_if(u).alias("n_unanswerable"),
        m("union_recall", a).alias("union_recall"), m("accepted_recall", a).alias("accepted_recall"), m("citation_recall", a).alias("citation_recall"),
        F.bround(100 * (F.avg(F.when(a, F.col("accepted_recall"))) - F.avg(F.when(a, F.col("union_recall")))), 2).alias("grading_delta_pp"),
        m("judge_score").alias("correctness"), F.count(F.when(ok_, F.col("judge_score"))).alias("n_judged"),
        _share(abst, u).alias("abstain_recall"), _share(u, ok_ & abst).alias("abstain_precision"), _share(abst, a).alias("false_abstain"),
        _share(F.col("actual_route") == F.col("expected_route"), ok_).alias("route_accuracy"),
        F.bround(100 * F.count_if(ok_ & (F.col("expected_route") == "simple") & (F.col("actual_route") != "simple")) / F.nullif(F.count_if(ok_ & (F.col("expected_route") == "simple")), F.lit(0)), 2).alias("over_decomposed_pct"),
        m("llm_calls").alias("llm_calls"), m("retrieval_calls").alias("retrieval_calls"),
    )
    return _beside(rows, seconds, list(by))


def paired(runs: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """System b against a on (case_id, language) pairs with both values (G-15, JN-H): differences in points."""
    side = lambda s, name: runs.where((F.col("system") == s) & (F.col("outcome") != "error")).groupBy("case_id", "language").agg(F.avg(metric).alias(name)).where(f"{name} is not null")
    d = side(a, "x").join(side(b, "y"), ["case_id", "language"]).withColumn("d", F.round(F.col("y") - F.col("x"), 9))
    return d.agg(
        F.count("*").alias("n"), F.round(100 * F.avg("d"), 4).alias("mean_pp"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"),
        F.round(100 * F.try_divide(F.sqrt(F.sum(F.col("d") * F.col("d")) - F.count("*") * F.avg("d") * F.avg("d")), F.sqrt(F.nullif(F.count("*") - 1, F.lit(0)))), 4).alias("stdev_pp"),
    )


def gates(runs: DataFrame, base: str, full: str) -> DataFrame:
    """The thresholds set beforehand, a row for each value (G-16): gate, value, passed. Gate 1 passes if multi-hop union
    recall or correctness gains ten points; its rows and the budget's (mean retrievals of the full system over the base's,
    more than 1.2 makes the gain no merit of planning) tell which. Nulls count as 0 where a rate must be high or low, so
    unmeasured leakage passes; latency passes against a base without one. Citation recall has no threshold."""
    runs = runs.where(F.col("system").isin(base, full))
    own = lambda df, s, p, *cs: df.where(F.col("system") == s).select(F.lit(1).alias("k"), *(F.col(c).alias(f"{p}_{c}") for c in cs))
    leaks = runs.groupBy("system").agg(F.count_if(~F.col("answerable") & (F.col("outcome") == "answered")).alias("false_answers"))
    every = summarise(runs, "system").join(macro_f1(runs, "system"), "system", "left").join(leaks, "system", "left")
    hops = summarise(runs.where("kind = 'multihop'"), "system")
    both = F.broadcast  # one row each
    row = own(every, full, "f", "correctness", "macro_f1", "over_decomposed_pct", "false_answers", "citation_recall", "p95_s", "retrieval_calls")
    for side in (own(every, base, "b", "correctness", "p95_s", "retrieval_calls"), own(hops, base, "bh", "union_recall"), own(hops, full, "fh", "union_recall")):
        row = row.join(both(side), "k", "left")
    c, n = F.col, lambda x: F.coalesce(x, F.lit(0.0))
    recall_gain, correct_gain = 100 * (c("fh_union_recall") - c("bh_union_recall")), 100 * (c("f_correctness") - c("b_correctness"))
    gain = F.coalesce(recall_gain >= 10, F.lit(False)) | F.coalesce(correct_gain >= 10, F.lit(False))
    route = (n(c("f_macro_f1")) >= 0.8) & (n(c("f_over_decomposed_pct")) <= 20)
    slow = c("b_p95_s").isNotNull() & (c("b_p95_s") != 0) & (c("f_p95_s") > 2.5 * c("b_p95_s"))
    none = F.lit(None).cast("boolean")
    checks = [
        ("1 multihop recall gain", recall_gain, gain), ("1 correctness gain", correct_gain, gain), ("1 retrieval budget", c("f_retrieval_calls") / F.nullif(c("b_retrieval_calls"), F.lit(0.0)), none),
        ("2 route macro f1", c("f_macro_f1"), route), ("2 over-decomposed", c("f_over_decomposed_pct"), route),
        ("3 answers to the unanswerable", c("f_false_answers"), n(c("f_false_answers")) == 0),
        ("4 citation recall", c("f_citation_recall"), none),
        ("5 latency", c("f_p95_s"), F.coalesce((c("f_p95_s") > 0) & (c("f_p95_s") <= 30) & ~slow, F.lit(False))),
    ]
    return row.select(F.inline(F.array(*(F.struct(F.lit(g).alias("gate"), F.round(v.cast("double"), 4).alias("value"), t.alias("passed")) for g, v, t in checks))))


def route_stability(runs: DataFrame) -> DataFrame:
    """Per intent: repeats, whether all took one route, the commonest route (the first by name among equals), its share,
    accuracy, median latency (G-17, G-24)."""
    n = runs.groupBy("intent", "actual_route").agg(F.count("*").alias("n"))
    top = n.groupBy("intent").agg(F.min_by("actual_route", F.struct(-F.col("n"), F.col("actual_route"))).alias("majority"), F.max("n").alias("n_major"), F.count("*").alias("n_routes"))
    per = runs.groupBy("intent").agg(F.count("*").alias("n"), F.round(F.avg((F.col("actual_route") == F.col("expected_route")).cast("int")), 6).alias("accuracy"), F.round(F.percentile("latency_s", F.lit(0.5)), 6).alias("median_s"))
    return per.join(top, "intent").select("intent", "n", (F.col("n_routes") == 1).alias("consistent"), "majority", F.round(F.col("n_major") / F.col("n"), 6).alias("share"), "accuracy", "median_s")


def separation(rows: DataFrame) -> DataFrame:
    """Quantiles and means of gold and other scores, and the floors that keep 100, 95 and 90 % of gold with the share of all
    rows they keep (G-19), overall, by language, by kind, and by both, in one pass over grouping sets."""
    gold = F.count_if("is_gold")
    base = rows.where("score is not null").groupBy("language", "kind", "score").agg(F.count("*").alias("n"), gold.alias("n_gold"))  # what the slices are added up from
    slices = F.explode(F.array(*(F.struct(language.alias("slice_language"), kind.alias("slice_kind")) for language in (F.lit("*"), F.col("language")) for kind in (F.lit("*"), F.col("kind")))))
    by = ["slice_language", "slice_kind"]
    sliced = base.withColumn("s", slices).groupBy("s.slice_language", "s.slice_kind", "score").agg(F.sum("n").alias("n"), F.sum("n_gold").alias("n_gold"))
    sliced = tables.kept(sliced, "slices")
    mean = lambda w: F.round(F.sum(F.when(w > 0, F.col("score") * w)) / F.nullif(F.sum(w), F.lit(0)), 6) + 0.0
    per = sliced.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_gold").alias("n_gold"), mean(F.col("n_gold")).alias("mean_gold"), mean(F.col("n") - F.col("n_gold")).alias("mean_other"))
    ranks = {f"gold_p{int(q * 100)}": floor_rank(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)} | {f"floor_{keep}": floor_rank(1 - keep / 100) for keep in (100, 95, 90)}
    per = _beside(per, values_at(sliced, by, F.col("score"), ranks, F.col("n_gold")), by)
    floors = per.select(*by, *(f"floor_{k}" for k in (100, 95, 90)))
    over = _beside(sliced.select(*by, "score", F.col("n").alias("w")), floors, by).groupBy(*by).agg(*(F.sum(F.when(F.col("score") >= F.col(f"floor_{k}"), F.col("w")).otherwise(0)).alias(f"over_{k}") for k in (100, 95, 90)))
    per = _beside(per, over, by)
    return per.withColumns({f"kept_{k}": F.when(F.col("n_gold") > 0, F.round(F.col(f"over_{k}") / F.col("n"), 6)) for k in (100, 95, 90)}).drop("over_100", "over_95", "over_90")


def retrieval_metrics(hits: DataFrame, gold: DataFrame, queries: DataFrame, *by: str) -> DataFrame:
    """Rank of the first gold row, recall@20, hit@1 and hit@10 over the queries with gold (G-22)."""
    found = hits.join(gold.select("query_id", "id").distinct(), ["query_id", "id"])
    per = found.groupBy("query_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= 20).alias("in_20"))
    n = gold.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    rows = queries.join(n, "query_id").join(per, "query_id", "left")
    rate = lambda k: F.round(F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")), 6)
    return rows.groupBy(*by).agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce("in_20", F.lit(0)) / F.col("n_gold")), 6).alias("recall_20"), rate(1).alias("hit_1"), rate(10).alias("hit_10"), F.round(F.avg("first"), 6).alias("mean_first"))


def coverage(chunks: DataFrame) -> DataFrame:
    """Gold documents found at all and found by the right chunk (G-20). chunks: query_id, document, is_gold_chunk, retrieved."""
    per = chunks.groupBy("query_id", "document").agg(F.max("retrieved").alias("doc_hit"), F.max(F.col("retrieved") & F.col("is_gold_chunk")).alias("chunk_hit"))
    r = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return per.agg(F.count("*").alias("n"), r("doc_hit").alias("document_recall"), r("chunk_hit").alias("chunk_recall"), F.count_if(F.col("doc_hit") & ~F.col("chunk_hit")).alias("wrong_chunk"))


def best_chunk(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "document").agg(F.max_by("id", F.struct(F.col("score"), F.col("id"))).alias("best"))  # G-21


def timeline_check(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Per query: share of gold found, whether all start in the range, whether dates ascend (G-23, W-10)."""
    w = Window.partitionBy("query_id").orderBy("position")
    rows = rows.withColumn("__up", F.coalesce(F.lag("date_from").over(w) <= F.col("date_from"), F.lit(True)))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_and(F.col("date_from").between(first, last)).alias("in_range"), F.bool_and("__up").alias("chronological"))


def volume_curve(rows: DataFrame) -> DataFrame:
    """Mean score of each level and whether the least is at least 0.7 of the greatest (G-27)."""
    per = rows.groupBy("level").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    ends = per.agg((F.min("mean_score") >= 0.7 * F.max("mean_score")).alias("passed"))
    return per.crossJoin(ends)


def both_found(rows: DataFrame) -> DataFrame:
    """Of cases with two gold documents: mean found, share with one or more, share with both (G-28). rows: case_id, n_found."""
    return rows.agg(F.round(F.avg("n_found"), 6).alias("mean_found"), F.round(F.avg((F.col("n_found") >= 1).cast("int")), 6).alias("any_found"), F.round(F.avg((F.col("n_found") >= 2).cast("int")), 6).alias("both_found"))


def first_reason(reasons: list[tuple[str, Column]], otherwise: str = "other") -> Column:
    """The first reason that holds (G-29, G-30)."""
    return reduce(lambda c, r: c.when(r[1], r[0]), reasons, F).otherwise(otherwise)


def abstain_reason() -> Column:
    """Why a run (outcome, answerable, union_recall, n_citations) gave no answer (G-29); empty if it gave one."""
    reasons = [
        ("", F.col("outcome") == "answered"), ("correctly abstained", ~F.col("answerable")),
        ("no gold retrieved", F.coalesce("union_recall", F.lit(0.0)) == 0), ("citation gate", F.coalesce("n_citations", F.lit(0)) == 0),
    ]
    return first_reason(reasons)


#: What tells a question on a precise title or date.
PRECISE_TITLE = r"(?i)(titled|標題為|Doc\.|document\s+\d+|第\s*\d+\s*號)"
PRECISE_DATE = r"\d{4}-\d{2}-\d{2}|\d{4}\s*年"


def miss_cause() -> Column:
    """Why a question (question, language, kind) found no gold: the first cause is the one to mend first (G-30)."""
    q = F.col("question")
    causes = [
        ("A precise title/date/person", q.rlike(PRECISE_TITLE) | q.rlike(PRECISE_DATE)), ("B cross-language", F.col("language") == "zh-TW"),
        ("D multi-hop bridging", F.col("kind") == "multihop"), ("C modern phrasing vs archival wording", F.col("kind") == "correction"),
    ]
    return first_reason(causes, "E general semantic miss")


def reason_counts(runs: DataFrame, reason: Column, *by: str) -> DataFrame:
    n = runs.withColumn("reason", reason).groupBy(*by, "reason").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return n.withColumn("share", F.round(F.col("n") / total, 6))


def missed(hits: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries with gold documents, none of which was retrieved (G-30)."""
    found = hits.join(gold, ["query_id", "id"], "left_semi").select("query_id").distinct()
    return queries.join(gold.select("query_id").distinct(), "query_id", "left_semi").join(found, "query_id", "left_anti")


def matrix(runs: DataFrame, configs: list[str], metric: str) -> DataFrame:
    """A row for each case, a column for each configuration, and the spread (G-31, G-34)."""
    wide = runs.groupBy("case_id").pivot("config", configs).agg(F.round(F.avg(metric), 6))
    return wide.withColumn("spread", F.round(F.greatest(*configs) - F.least(*configs), 6))


def rank_agreement(full: DataFrame, part: DataFrame, decisive: float) -> DataFrame:
    """Of pairs of configurations that differ by a decisive amount on all cases, the share whose order a subset keeps; and
    the subset's largest error of a mean (G-31). Both: config, mean."""
    m = full.join(part.withColumnRenamed("mean", "sub"), "config")
    pairs = m.alias("a").join(m.alias("b"), F.col("a.config") < F.col("b.config")).where(F.abs(F.col("a.mean") - F.col("b.mean")) >= decisive)
    same = F.signum(F.col("a.mean") - F.col("b.mean")) == F.signum(F.col("a.sub") - F.col("b.sub"))
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(F.avg(same.cast("int")), 6).alias("agreement")).crossJoin(m.agg(F.round(F.max(F.abs(F.col("mean") - F.col("sub"))), 6).alias("max_error")))


def greedy_subset(table, size: int, fixed: list[int] = ()) -> tuple[list[int], list[float]]:
    """Cases (rows of a small matrix cases x configurations) chosen one by one so that the subset's means come nearest to all
    cases' (G-32), and the error after each. Sequential by nature: the matrix is aggregated before."""
    import numpy as np

    x = np.asarray(table, float)
    target, chosen, errors = x.mean(axis=0), list(fixed), []
    while len(chosen) < min(size, len(x)):
        total, n = x[chosen].sum(axis=0), len(chosen) + 1
        error = np.abs((total + x) / n - target).max(axis=1)
        error[chosen] = np.inf
        chosen.append(int(error.argmin()))
        errors.append(float(error[chosen[-1]]))
    return chosen, errors


def pinned(cases: DataFrame) -> DataFrame:
    """The case of greatest spread of each kind and language (W-11)."""
    return cases.groupBy("kind", "language").agg(F.max_by("case_id", F.struct(F.col("spread"), F.col("case_id"))).alias("case_id"))
