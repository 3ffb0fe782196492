"""The question-answering loop over a table of questions: bounded rounds on the driver, each one plan for all questions.

States are tables keyed by query_id; nothing of the corpus comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import cite, filters, retrieval, select
from corpusloom.plans import dispatch
from corpusloom.sources import tables


@dataclass(frozen=True)
class System:
    """What a variant does (N-13)."""

    plans: bool = True
    dispatches: bool = True
    grades: bool = True
    corrects: bool = False
    repairs: bool = False
    rounds: int = 2
    corrections: int = 1
    calls: int = 4


#: The variants.
SYSTEMS = {"B0": System(plans=False, grades=False), "B1": System(grades=False), "B2": System(corrects=True), "B3": System(corrects=True, repairs=True), "B0-2step": System(plans=False, dispatches=False, grades=False, rounds=1)}

MAX_HOPS = 3
ABSTAINED = {"en": "The documents do not answer this question.", "zh-TW": "這些文件沒有回答這個問題。"}


def plan_hops(questions: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """(query_id, hop, query, route): the planner's hops, three at most, renamed in their order; a question without any is a hop of
    its own on its rule's route (N-1)."""
    rule = text.route(F.col("question"))
    own = questions.select("query_id", F.lit("h0").alias("hop"), F.col("question").alias("query"), rule.alias("route"))
    if planned is None:
        return own
    k = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    hops = planned.withColumn("__k", k).where(F.col("__k") <= MAX_HOPS).select("query_id", F.concat(F.lit("h"), (F.col("__k") - 1).cast("string")).alias("hop"), "query", "route")
    return hops.unionByName(own.join(hops.select("query_id").distinct(), "query_id", "left_anti"))


def hop_filters(hops: DataFrame, manifest: DataFrame) -> DataFrame:
    """A planner's filters, held against the manifest (N-2): volumes by id or title, what is neither is rejected; dates only in ISO
    form; only citable documents are searched. hops: query_id, volume, date_from."""
    known = filters.resolve_volumes(hops.select(F.col("volume").alias("candidate")).distinct(), manifest)
    rows = hops.join(known, F.col("volume") == F.col("candidate"))
    return rows.select("query_id", "volume_id", F.when(F.col("how") == "dropped", F.col("candidate")).alias("rejected"), text.iso_date(F.col("date_from")).alias("date_from"), F.lit(cite.CITABLE[0]).alias("subtype"))


def rewrite(missing: DataFrame, hops: DataFrame, number: int) -> DataFrame:
    """A corrective hop for each missing one; its text is what is missing, else the original hop's (N-5)."""
    k = F.row_number().over(Window.partitionBy("query_id").orderBy("hop")) - 1 + F.lit(number)
    rows = missing.join(hops, ["query_id", "hop"])
    return rows.select("query_id", F.concat(F.lit("fix"), k.cast("string")).alias("hop"), F.coalesce(F.nullif("missing", F.lit("")), "query").alias("query"), "route")


def next_step(states: DataFrame, system: System) -> DataFrame:
    """Where each question goes after grading (N-12): retrieve again, answer or abstain. states: query_id, n_missing, n_accepted, rounds,
    corrections, calls."""
    spent = (F.col("rounds") >= system.rounds) | (F.col("corrections") >= system.corrections) | (F.col("calls") >= system.calls - 1)
    again = F.lit(system.corrects) & (F.col("n_missing") > 0) & ~spent
    return states.withColumn("step", F.when(again, "rewrite_missing").when((F.col("n_accepted") > 0) | F.lit(not system.grades), "synthesize").otherwise("abstain"))


def answer(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Callable[[DataFrame], DataFrame], manifest: DataFrame, system: System = SYSTEMS["B3"], floor: float | None = None, planned: DataFrame | None = None, grade: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Answers to all questions (N-3 to N-14). retrieve: hops -> (query_id, hop, id, score, volume_id, subtype, text); generate: accepted
    evidence -> claims (query_id, claim, text, ids). Evidence is graded by scores and a floor, or by a model: grade: evidence, hops -> judgements
    (query_id, hop, verdict, corrective, rejected)."""
    hops = plan_hops(questions, planned if system.plans else None)
    found, asked = None, hops
    for number in range(system.rounds):
        new = tables.kept(retrieve(asked).withColumn("seen", F.lit(number)), "round")
        found = new if found is None else found.unionByName(new)
        if not system.corrects or number + 1 == system.rounds or (floor is None and grade is None):
            break
        if grade is None:
            missing = select.missing_hops(found, hops, floor).withColumn("missing", F.lit(""))
        else:
            missing = select.unsupported(grade(select.merge_hops(found), hops))
        asked = tables.kept(rewrite(missing, hops, number), "asked")
        if asked.isEmpty():
            break
    merged = tables.kept(select.merge_hops(found), "merged")
    if not system.grades:
        kept = merged
    else:
        kept = (select.select_evidence(merged, floor) if grade is None else select.graded(merged, tables.kept(grade(merged, hops), "judgements"))).where("kept")
    about = found.select("query_id", "id", "volume_id", "subtype", "text").dropDuplicates(["query_id", "id"])
    accepted = tables.kept(kept.join(about, ["query_id", "id"]), "accepted")
    claims = tables.kept(generate(accepted).withColumn("text", text.without_urls(F.col("text"))), "claims")
    checked = cite.cited(claims, about, accepted, manifest)
    if system.repairs:
        claims = cite.drop_uncited(cite.repair(claims, checked))
        checked = cite.cited(claims, about, accepted, manifest)
    return cite.answers(questions, claims, about, cite.gate(questions, claims, checked))


def synthesis(questions: DataFrame, evidence: DataFrame, generate: Callable[[DataFrame], DataFrame], scorer: Callable = retrieval.coverage, documents: int = 14, total: int = 18) -> tuple[DataFrame, DataFrame]:
    """(claims, window). The generator sees a window budgeted by document (W-6); the ids that it writes are discarded, and each
    claim gets the passages of the window that it reads like (W-8). evidence: query_id, id, document, score, text; generate: window ->
    query_id, claim, text and, if it has any, limitations."""
    window = tables.kept(select.synthesis_window(evidence, documents, total), "window")
    claims = tables.kept(generate(window).withColumn("text", text.without_urls(F.col("text"))).drop("ids"), "claims")
    pairs = select.claim_pairs(claims.select("query_id", "claim", F.col("text").alias("said")), window.select("query_id", "id", "text"))
    near = select.attribute(pairs.select("query_id", "claim", "id", scorer(F.col("said"), F.col("text")).alias("score")))
    ids = near.groupBy("query_id", "claim").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("a")).select("query_id", "claim", F.col("a.id").alias("ids"))
    return claims.join(ids, ["query_id", "claim"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>"))), window


def ask(questions: DataFrame, dispatcher: dispatch.Dispatcher, generate: Callable[[DataFrame], DataFrame], manifest: DataFrame, system: System = SYSTEMS["B3"], floor: float | None = None, planned: DataFrame | None = None, scorer: Callable = retrieval.coverage, neighbours: bool = False, focus: bool = True) -> DataFrame:
    """The whole loop with tools by route, a synthesis window and citations by attribution (N-3, N-6, N-13): one row a question with
    outcome, language, answer_text, claims, retrieved, accepted and cited documents, limitations and reason. A system that doesn't dispatch searches every
    question as it stands. planned: the hops of plan_hops, with the filters of a Dispatcher if they have any."""
    hops = plan_hops(questions, planned if system.plans else None)
    if planned is not None and system.plans:
        extra = [c for c in dispatch.EMPTY_FILTERS if c in planned.columns]
        if extra:
            k = F.row_number().over(Window.partitionBy("query_id").orderBy("place")) - 1
            hops = hops.join(planned.select("query_id", F.concat(F.lit("h"), k.cast("string")).alias("hop"), *extra), ["query_id", "hop"], "left")
    if not system.dispatches:
        hops = hops.withColumn("route", F.lit("simple"))
    hops = tables.kept(hops, "hops")
    found, asked = None, hops
    for number in range(system.rounds):
        new = tables.kept(dispatcher(asked).withColumn("seen", F.lit(number)), "round")
        found = new if found is None else found.unionByName(new)
        if not system.corrects or number + 1 == system.rounds or floor is None:
            break
        missing = select.missing_hops(found, hops.where("route <> 'status'"), floor).withColumn("missing", F.lit(""))
        asked = tables.kept(rewrite(missing, hops, number), "asked")
        if asked.isEmpty():
            break
    merged = dispatch.reranked(select.merge_hops(found), hops, questions, dispatcher.passages, scorer=scorer)
    if neighbours:
        merged = dispatch.expanded(merged, dispatcher.passages)
    about = dispatcher.passages.select("id", "volume_id", "document_id", "subtype", "text")
    evidence = tables.kept(merged, "merged").join(about, "id")  # few, and known to be: the texts don't move
    evidence = tables.kept((dispatch.focused(evidence, questions, scorer) if focus else evidence).withColumn("document", F.concat_ws(":", "volume_id", "document_id")), "evidence")
    accepted = select.select_evidence(evidence, floor).where("kept").drop("kept") if system.grades else evidence
    claims, window = synthesis(questions, accepted, generate, scorer)
    checked = tables.kept(cite.cited(claims, evidence, accepted, manifest), "checked")
    if system.repairs:
        claims = cite.drop_uncited(cite.repair(claims, checked))
        checked = cite.cited(claims, evidence, accepted, manifest)
    gated = cite.gate(questions, claims, checked)
    out = cite.answers(questions, claims, evidence, gated)
    documents = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_set("document")).alias(name))
    good = checked.where("refusal is null").select("query_id", "id").distinct().join(evidence.select("query_id", "id", "document"), ["query_id", "id"])
    said = claims.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim", "text"))), lambda c: c["text"]), " ").alias("said"), *([F.max("limitations").alias("limitations")] if "limitations" in claims.columns else []))
    for df, name in ((evidence, "retrieved_documents"), (accepted, "accepted_documents"), (good, "cited_documents")):
        out = out.join(documents(df, name), "query_id", "left")
    out = out.join(said, "query_id", "left").join(questions.select("query_id", text.language(F.col("question")).alias("language")), "query_id")
    answered, none = F.col("outcome") == "answered", F.array().cast("array<string>")
    refusal = F.when(F.col("language") == "zh-TW", ABSTAINED["zh-TW"]).otherwise(ABSTAINED["en"])
    return out.select(
        "query_id", "outcome", "language", F.when(answered, F.col("said")).otherwise(refusal).alias("answer_text"), "claims", F.coalesce("retrieved_documents", none).alias("retrieved_documents"),
        F.coalesce("accepted_documents", none).alias("accepted_documents"), F.when(answered, F.coalesce("cited_documents", none)).otherwise(none).alias("cited_documents"),
        (F.coalesce("limitations", F.lit("")) if "limitations" in out.columns else F.lit("")).alias("limitations"), "reason",
    )
