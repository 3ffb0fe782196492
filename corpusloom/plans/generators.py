"""Evaluation cases whose answers are known from metadata (N-16), and the sweep over them (N-15).

Cases are (case_id, kind, question, gold), gold an array of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import corpus, evaluate, select
from corpusloom.sources import tables


def _case(df: DataFrame, kind: str, key, question, gold) -> DataFrame:
    return df.select(F.concat(F.lit(f"{kind}:"), key).alias("case_id"), F.lit(kind).alias("kind"), question.alias("question"), gold.alias("gold"))


def lookups(docs: DataFrame, n: int | None = None, seed: int = 11) -> DataFrame:
    """A question for each title that one document has; n of them by a hash, if asked."""
    t = corpus.distinctive_titles(docs)
    t = select.seeded_sample(t, "document", n, seed) if n else t
    return _case(t, "lookup", F.col("document"), F.concat(F.lit('What does "'), "head", F.lit('" say?')), F.array("document"))


def multihops(docs: DataFrame) -> DataFrame:
    """A question for each name that just two documents have."""
    pairs = docs.select("document", "text", F.explode("persons").alias("entity")).where(F.contains("text", F.col("entity")) & corpus.name_shaped(F.col("entity")))
    pairs = pairs.groupBy("entity").agg(F.count_distinct("document").alias("df"), F.min("document").alias("a"), F.max("document").alias("b")).where("df = 2")
    return _case(pairs, "multihop", F.col("entity"), F.concat(F.lit("What do the two documents that name "), "entity", F.lit(" have in common?")), F.array("a", "b"))


def corrections(docs: DataFrame, years: int = 7) -> DataFrame:
    """A question with a wrong year for each dated document with a title of its own."""
    t = corpus.distinctive_titles(docs).join(docs.where("date_from <> ''").select("document", "date_from"), "document")
    return _case(t, "correction", F.col("document"), F.concat(F.lit("What was said on "), text.shifted_year(F.col("date_from"), years), F.lit(' in "'), "head", F.lit('"?')), F.array("document"))


def unanswerable(manifest: DataFrame) -> DataFrame:
    """A question on each volume that isn't published."""
    t = manifest.where("status <> 'published'")
    return _case(t, "unanswerable", F.col("volume_id"), F.concat(F.lit("What does document 1 of "), "title", F.lit(" say?")), F.array().cast("array<string>"))


def timelines(docs: DataFrame) -> DataFrame:
    """A question on the third to eighth date of each volume with twelve dated documents."""
    w = corpus.dated_windows(docs)
    inside = docs.where("date_from <> ''").join(w, "volume_id").where(F.col("date_from").between(F.col("first"), F.col("last")))
    g = inside.groupBy("volume_id", "first", "last").agg(F.array_sort(F.collect_list("document")).alias("gold"))
    return _case(g, "timeline", F.col("volume_id"), F.concat(F.lit("What happened between "), "first", F.lit(" and "), "last", F.lit("?")), F.col("gold"))


def sweep(cases: DataFrame, systems: list[str], languages: list[str], done: DataFrame, mode: str) -> DataFrame:
    """(system, language, case_id) still to be run: what was done by the same retriever mode isn't run again."""
    rows = cases.select(F.explode(F.array(*map(F.lit, systems))).alias("system"), "case_id").select("system", F.explode(F.array(*map(F.lit, languages))).alias("language"), "case_id")
    return tables.todo(rows, done, ["system", "language", "case_id"], ("mode", mode))


def report(runs: DataFrame, base: str, full: str, metric: str = "citation_recall") -> dict[str, DataFrame]:
    """The tables of an evaluation."""
    summary, f1 = evaluate.summarise(runs, "system"), evaluate.macro_f1(runs, "system")
    return {"summary": summary, "by_kind": evaluate.summarise(runs, "system", "kind"), "macro_f1": f1, "paired": evaluate.paired(runs, base, full, metric), "gates": evaluate.gates(runs, base, full), "routes": evaluate.route_stability(runs)}
