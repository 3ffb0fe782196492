"""Probes of a retrieval system: questions whose answers follow from metadata, in English and Chinese (N-16), and what
is read from their runs (N-15). Every probe is a table of cases or a one-row table of figures with `passed`.

Cases: case_id, question_en, question_zh, gold (an array of documents), and what a probe needs beside them. `series`
is what questions call the collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import corpus, evaluate, select
from corpusloom.sources import tables

#: Countries as titles name them, and in Chinese.
COUNTRIES = [
    ("Mexico", "墨西哥"), ("China", "中國"), ("Japan", "日本"), ("France", "法國"), ("Germany", "德國"), ("Russia", "俄國"),
    ("Cuba", "古巴"), ("Spain", "西班牙"), ("Italy", "義大利"), ("Turkey", "土耳其"), ("Korea", "韓國"), ("Brazil", "巴西"),
]
#: Amounts of evidence of P3.
LEVELS = [2, 4, 8, 16]
#: Questions for each route in three wordings (P8).
ROUTED = [
    ("lookup", ["What does src12 document 7 say?", "Show me document 7 of src12.", "Quote src12, document 7."]),
    ("status", ["Has the volume on the harbour talks been published?", "Is there a published volume on the harbour?", "Which volumes are still planned?"]),
    ("timeline", ["Give a timeline of the harbour talks.", "What was the sequence of the harbour decisions?", "When did the harbour decisions come?"]),
    ("complex", ["Compare the two harbour policies.", "What is the difference between the two notes?", "What led to the new harbour policy?"]),
    ("simple", ["Who was the envoy to the harbour?", "Name the envoy at the harbour.", "Which envoy held the post?"]),
]
LONG, LONGER = 800, 1200  # characters a document must have to be asked about


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _cases(rows: DataFrame, probe: str, key: Column, en: Column, zh: Column, gold: Column, *more: Column) -> DataFrame:
    return rows.select(_say(f"{probe}:", key).alias("case_id"), en.alias("question_en"), zh.alias("question_zh"), gold.alias("gold"), *more)


def _titled(docs: DataFrame, least: int = LONG) -> DataFrame:
    """Dated documents with a title of their own and more than `least` characters."""
    rows = corpus.distinctive_titles(docs).select("document").join(docs, "document")
    return rows.where((F.length("text") > least) & (F.col("date_from") != ""))


def precise(docs: DataFrame, series: str = "the series", probe: str = "p4") -> DataFrame:
    """P4: a title and its date name one document. P1 asks the same with that document withheld."""
    head, date = F.col("head"), F.col("date_from")
    return _cases(_titled(docs), probe, F.col("document"), _say(f"Which document of {series} is titled '", head, "' and dated ", date, "?"), _say("標題為「", head, "」、日期為 ", date, " 的是哪一份文件？"), F.array("document"))


def ordered(docs: DataFrame) -> DataFrame:
    """P2: documents that name three actors or more; the same evidence is given in two orders."""
    rows = _titled(docs, LONGER).withColumn("actors", F.array_sort(F.array_distinct(text.named_actors(F.col("text"))))).where(F.size("actors") >= 3)
    return _cases(rows, "p2", F.col("document"), F.lit("Who said what in this exchange? Attribute each statement."), F.lit("這次往來中誰說了什麼？請逐項指出發言者。"), F.array("document"), F.slice("actors", 1, 6).alias("actors"))


def growing(docs: DataFrame, series: str = "the series") -> DataFrame:
    """P3: a case for each amount of evidence around the answer."""
    return precise(docs, series, "p3").withColumn("level", F.explode(F.array(*map(F.lit, LEVELS))))


def cross_language(docs: DataFrame) -> DataFrame:
    """P5: the only document on a country at a date, asked in Chinese without a Latin letter; the first date of each country."""
    names = F.array(*(F.struct(F.lit(en).alias("en"), F.lit(zh).alias("zh")) for en, zh in COUNTRIES))
    rows = docs.where(F.col("date_from").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("document", "date_from", "text", "head", F.explode(names).alias("c")).where(F.expr(r"rlike(head, concat('\\b', c.en, '\\b'))"))
    one = rows.groupBy("c", "date_from").agg(F.count("*").alias("n"), F.min("document").alias("document"), F.min(F.length("text")).alias("size")).where((F.col("n") == 1) & (F.col("size") >= LONG))
    first = one.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("date_from"))).where("k = 1")
    number = lambda a, n: F.substring("date_from", a, n).cast("int").cast("string")
    zh = _say(F.substring("date_from", 1, 4), " 年 ", number(6, 2), " 月 ", number(9, 2), " 日關於", F.col("c.zh"), "的那份外交文件說了什麼？")
    return _cases(first, "p5", F.col("c.en"), _say("What does the ", F.col("date_from"), " diplomatic document on ", F.col("c.en"), " say?"), zh, F.array("document"), F.col("date_from").alias("date"))


def cross_referenced(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """P6: a document and the one that it refers to (edges: volume_id, document_id, target), and whether the indexed text
    still mentions it (SC-21)."""
    rows = edges.join(docs.select("volume_id", "document_id", "document", "head", "text"), ["volume_id", "document_id"]).where(F.length("head") >= 30)
    head = F.substring("head", 1, 120)
    linked = F.expr(r"rlike(text, concat('\\b(Document|Doc\\.?)\\s+', regexp_replace(target, '^d', ''), '\\b'))")
    return _cases(rows, "p6", F.col("document"), _say("In volume ", F.col("volume_id"), ", what does the document titled '", head, "' say, and what does the document it cross-references add?"),
        _say("在 ", F.col("volume_id"), " 卷中，標題為「", head, "」的文件說了什麼？它交叉引用的那份文件又補充了什麼？"), F.array(F.col("document"), F.concat_ws(":", "volume_id", "target")), linked.alias("linked"))


def abstaining(docs: DataFrame, manifest: DataFrame, series: str = "the series", years: int = 7) -> DataFrame:
    """P7: volumes that aren't published, and documents with a false date; true_date is what an answer must put right."""
    planned = manifest.where("status <> 'published' and title <> ''")
    a = _cases(planned, "p7u", F.col("volume_id"), _say(f"What does {series} record about ", F.col("title"), "?"), _say("關於「", F.col("title"), "」記載了什麼？"), F.array().cast("array<string>"), F.lit("unpublished").alias("kind"), F.lit("").alias("true_date"))
    wrong = text.shifted_year(F.col("date_from"), years)
    b = _cases(_titled(docs), "p7f", F.col("document"), _say("The document '", F.col("head"), "' is dated ", wrong, ". What does it say?"), _say("文件「", F.col("head"), "」的日期是 ", wrong, "，它說了什麼？"), F.array("document"), F.lit("false_premise").alias("kind"), F.col("date_from").alias("true_date"))
    return a.unionByName(b)


def routed(spark) -> DataFrame:
    """P8: questions whose route is known."""
    rows = [(f"p8:{route}:{k}", route, q) for route, qs in ROUTED for k, q in enumerate(qs)]
    return spark.createDataFrame(rows, "case_id string, expected_route string, question_en string")


def bounded(docs: DataFrame) -> DataFrame:
    """P9: the documents of a volume between the third and the eighth of its dates."""
    w = corpus.dated_windows(docs)
    inside = docs.where("date_from <> ''").join(w, "volume_id").where(F.col("date_from").between(F.col("first"), F.col("last")))
    rows = inside.groupBy("volume_id", "first", "last").agg(F.array_sort(F.collect_list("document")).alias("gold"))
    v, a, b = (F.col(c) for c in ("volume_id", "first", "last"))
    return _cases(rows, "p9", v, _say("List the documents in volume ", v, " between ", a, " and ", b, ", in order."), _say("依時間順序列出 ", v, " 卷中 ", a, " 到 ", b, " 之間的文件。"), F.col("gold"), v, a, b)


def verification_pairs(passages: DataFrame, n: int = 20, seed: int = 11) -> DataFrame:
    """P10: of 2 n passages (id, text) chosen by a hash, the first sentence of 61 to 319 characters put to its own passage, which supports it, and
    to another one, which doesn't: pair, claim, id, supports."""
    usable = passages.withColumn("s", F.filter(text.sentences(F.col("text")), lambda x: F.length(x).between(61, 319))).where(F.size("s") >= 2)
    some = select.seeded_sample(usable, "id", 2 * n, seed).select("id", F.get("s", F.lit(0)).alias("claim"))
    some = tables.kept(some, "sampled")  # 2 n rows, whose pass over all sentences is not run again for each use
    placed = some.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "id")), "id")) - 1)  # 2 n rows
    other = placed.select((F.col("k") - n).alias("k"), F.col("id").alias("other"))
    own = placed.where(F.col("k") < n)
    pair = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("pair")
    return own.select(pair("own"), "claim", "id", F.lit(True).alias("supports")).unionByName(own.join(other, "k").select(pair("other"), "claim", F.col("other").alias("id"), F.lit(False).alias("supports")))


def d0(runs: DataFrame) -> DataFrame:
    """D0: a row for each run from what runs record: where the gold got lost on its way from retrieval to the citations, and why there was no
    answer. What was in the generator's context isn't recorded and isn't made up."""
    return runs.select(
        "system", "case_id", "kind", "language", "answerable", F.col("union_recall").alias("gold_in_union"), F.col("accepted_recall").alias("gold_accepted"), F.col("citation_recall").alias("gold_cited"),
        (F.col("outcome") != "answered").alias("abstained"), evaluate.abstain_reason().alias("abstain_reason"), (F.coalesce("n_citations", F.lit(0)) > 0).alias("citation_valid"), "judge_score", "retrieval_calls", "llm_calls", "latency_s",
    )


def gold_evidence(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """D2, D3: what a generator gets when retrieval is left out: every chunk of each case's gold documents, in order."""
    rows = cases.select("case_id", F.posexplode("gold").alias("place", "document")).join(chunks.withColumn("document", F.concat_ws(":", "volume_id", "document_id")), "document")
    position = F.row_number().over(Window.partitionBy("case_id").orderBy("place", "ordinal")).cast("long")
    return rows.select("case_id", "chunk_id", position.alias("position"), "text")


def recovered(with_gold: DataFrame, base: DataFrame, *by: str) -> DataFrame:
    """D2, D3: of the cases that failed in the base runs (score below a half), the share that succeeds with the gold in hand, by
    generator or the like. Both: case_id, score; with_gold also `by`."""
    failed = base.where("score < 0.5").select("case_id").distinct()
    return with_gold.where("score is not null").join(failed, "case_id", "left_semi").groupBy(*by).agg(F.count("*").alias("n"), _rate(F.col("score") >= 0.5).alias("recovered"))


# what is read from runs


def _rate(c: Column) -> Column:
    return F.round(F.avg(c.cast("double")), 3)


def first_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case (and language, if cases have one): the rank of the first gold document, null if there is none, and the share of gold found. hits: case_id,
    document, rank, and language if cases have it."""
    by = ["case_id", *(c for c in ("language",) if c in cases.columns)]
    gold = cases.select(*by, F.explode(F.array_distinct("gold")).alias("document"))
    per = gold.join(hits.groupBy(*by, "document").agg(F.min("rank").alias("rank")), [*by, "document"], "left")
    return per.groupBy(*by).agg(F.min("rank").alias("first"), (F.count("rank") / F.count("*")).alias("recall"))


def p1(runs: DataFrame) -> DataFrame:
    """Answering with the answer withheld is fabrication. runs: outcome, leaked (gold was retrieved all the same)."""
    clean = ~F.col("leaked")
    rate = F.coalesce(_rate(F.when(clean, F.col("outcome") != "answered")), F.lit(0.0))
    return runs.agg(rate.alias("abstention_rate"), F.count_if(clean & (F.col("outcome") == "answered")).alias("fabrications"), F.count_if(~clean).alias("excluded_for_leak"), (rate >= 0.9).alias("passed"))


def p2(runs: DataFrame) -> DataFrame:
    """The order of evidence must not change who is named. runs: case_id, forward, reverse (arrays of actors)."""
    same = F.size(F.array_except("forward", "reverse")) + F.size(F.array_except("reverse", "forward")) == 0
    return runs.agg(_rate(same).alias("stability"), F.round(F.avg(select.jaccard(F.col("forward"), F.col("reverse"))), 3).alias("mean_overlap"), (F.coalesce(_rate(same), F.lit(0.0)) >= 0.8).alias("passed"))


def p3(runs: DataFrame) -> DataFrame:
    """Irrelevant evidence around the answer must not lower the score. runs: level, score."""
    return evaluate.volume_curve(runs.where("score is not null"))


def p4(ranks: DataFrame) -> DataFrame:
    at = lambda k: _rate(F.coalesce(F.col("first") <= k, F.lit(False)))
    return ranks.agg(at(1).alias("hit_1"), at(10).alias("hit_10"), (at(1) >= 0.8).alias("passed"))


def p5(ranks: DataFrame) -> DataFrame:
    """ranks with language: hits in ten in either, and the gap in points."""
    at = lambda lang: F.coalesce(_rate(F.when(F.col("language") == lang, F.coalesce(F.col("first") <= 10, F.lit(False)))), F.lit(0.0))
    return ranks.agg(at("en").alias("hit_10_en"), at("zh-TW").alias("hit_10_zh"), F.round(100 * (at("en") - at("zh-TW")), 1).alias("gap_pp"), (at("zh-TW") >= 0.5).alias("passed"))


def p6(runs: DataFrame) -> DataFrame:
    """Both documents of a cross-reference. runs: linked, n_found, n_cited (of two), score."""
    both = F.col("n_found") >= 2
    return runs.agg(_rate(F.col("linked")).alias("linked"), F.round(F.avg("n_found"), 3).alias("mean_found"), _rate(F.col("n_found") > 0).alias("any_found"), _rate(both).alias("both_found"), _rate(F.col("n_cited") >= 2).alias("both_cited"), F.round(F.avg("score"), 3).alias("correctness"), (F.coalesce(_rate(both), F.lit(0.0)) >= 0.7).alias("passed"))


def p7(runs: DataFrame) -> DataFrame:
    """runs: kind, outcome, answer, true_date. Unpublished volumes call for abstention, false dates for the true one or its year."""
    ok = F.when(F.col("kind") == "unpublished", F.col("outcome") != "answered").otherwise(F.contains(F.col("answer"), F.col("true_date")) | F.contains(F.col("answer"), F.substring("true_date", 1, 4)))
    at = lambda kind: _rate(F.when(F.col("kind") == kind, ok))
    return runs.agg(at("unpublished").alias("unpublished"), at("false_premise").alias("false_premise"), ((F.coalesce(at("unpublished"), F.lit(0.0)) >= 0.9) & (F.coalesce(at("false_premise"), F.lit(0.0)) >= 0.5)).alias("passed"))


def p8(runs: DataFrame, held_out: DataFrame) -> DataFrame:
    """runs: expected_route, actual_route. Consistent: all wordings of a route go one way. held_out: the same of questions that nothing was
    tuned on; without any the probe doesn't pass."""
    hit = (F.col("actual_route") == F.col("expected_route")).cast("int")
    per = runs.groupBy("expected_route").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.count_distinct("actual_route").alias("ways"))
    accuracy, one_way = F.sum("hits") / F.sum("n"), F.avg((F.col("ways") == 1).cast("double"))
    out = per.agg(accuracy.alias("a"), one_way.alias("c")).crossJoin(held_out.agg(F.avg(hit).alias("h")))  # one row each
    return out.select(F.round("a", 3).alias("accuracy"), F.round("c", 3).alias("consistency"), F.round("h", 3).alias("held_out"), F.coalesce((F.col("a") >= 0.8) & (F.col("c") == 1) & (F.col("h") >= 0.8), F.lit(False)).alias("passed"))


def p9(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """rows: case_id, document, date_from, position; cases of `bounded`. Documents that overlap the window may start before it, so
    starts are reported and order and recall decide."""
    found = cases.select("case_id", "first", "last", F.size("gold").alias("n_gold"), F.col("gold"))
    up = F.coalesce(F.lag("date_from").over(Window.partitionBy("case_id").orderBy("position")) <= F.col("date_from"), F.lit(True))
    per = rows.where("date_from <> ''").withColumn("up", up).join(found, "case_id", "right").groupBy("case_id", "n_gold").agg(
        F.count_distinct(F.when(F.array_contains("gold", F.col("document")), F.col("document"))).alias("n"), F.coalesce(F.bool_and(F.col("date_from").between(F.col("first"), F.col("last"))), F.lit(True)).alias("inside"), F.coalesce(F.bool_and("up"), F.lit(True)).alias("up")
    )
    recall = F.avg(F.col("n") / F.col("n_gold"))
    return per.agg(F.round(recall, 3).alias("mean_recall"), _rate(F.col("inside")).alias("starts_in_range"), _rate(F.col("up")).alias("chronological"), (F.bool_and("up") & (recall >= 0.8)).alias("passed"))


def p10(verdicts: DataFrame) -> DataFrame:
    """A verifier on claims put to passages (G-33): how often it rejects what doesn't support a claim, and what does. verdicts: supports,
    rejected."""
    at = lambda s: _rate(F.when(F.col("supports") == s, F.col("rejected")))
    return verdicts.agg(at(False).alias("caught"), at(True).alias("false_alarms"), F.count("*").alias("n"))
