"""Queries on corpus aggregates and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import corpus, evaluate, retrieval, select
from corpusloom.plans import generators

from corpusloom.plans.catalog_rank import SQL_GOLD, SQL_QUESTIONS, body_hits, gold, questions, sql_bm25
from corpusloom.plans.catalog_text import SQL_CHUNKS, SQL_PERSONS, _persons, chunk_table
from corpusloom.plans.inputs import QUERY_WORDS, SQL_DOCS, SQL_MANIFEST, SQL_RUNS, docs, manifest, runs, table

Q: dict = {}
D, M, R = f"WITH {SQL_DOCS}", f"WITH {SQL_DOCS}, {SQL_MANIFEST}", f"WITH {SQL_RUNS}"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


@query("g1_stats", M + """, c AS (SELECT count(*) AS n_chunks, count(embedding) AS n_embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id)
SELECT count(*) FILTER (WHERE status = 'published') AS published, count(*) FILTER (WHERE status <> 'published') AS planned, CAST(sum(n_documents) AS BIGINT) AS n_documents, CAST(sum(n_historical) AS BIGINT) AS n_historical, CAST(sum(n_documents) - sum(n_historical) AS BIGINT) AS n_editorial, any_value(n_chunks) AS n_chunks, any_value(n_embedded) AS n_embedded FROM manifest CROSS JOIN c""")
def _(s, d):
    c = docs(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding")), "doc_id", "left").select(F.col("embedding").isNotNull().alias("embedded"))
    return corpus.stats(manifest(s, d), c)


@query("g2_reassemble", D + f""", {SQL_CHUNKS}, {SQL_PERSONS}, pl AS (SELECT document, string_agg(DISTINCT person, '|' ORDER BY person) AS persons FROM persons GROUP BY document),
b AS (SELECT volume_id, document_id, document, string_agg(text, ' ' ORDER BY ordinal) AS text, count(*) AS n_chunks, arg_min(head, ordinal) AS head FROM chunks GROUP BY ALL)
SELECT volume_id, document_id, text, n_chunks, head, coalesce(persons, '') AS persons FROM b LEFT JOIN pl USING (document) WHERE length(text) > 400""")
def _(s, d):
    c = chunk_table(s, d).join(_persons(s, d).select("volume_id", "document_id", "persons"), ["volume_id", "document_id"])
    return corpus.reassemble(c, 400).withColumn("persons", F.array_join("persons", "|"))


@query("g3_b11_extrapolated", "SELECT CASE WHEN a > 0 THEN CAST(round_even(b / CAST(a AS DOUBLE) * n, 0) AS BIGINT) ELSE 0 END AS expected FROM (SELECT count(*) FILTER (WHERE doc_id % 10 = 0) AS a, CAST(sum(CASE WHEN doc_id % 10 = 0 THEN n_chars END) AS BIGINT) AS b, count(*) AS n FROM documents)")
def _(s, d):
    t = table(s, d, "documents").agg(F.count_if(F.col("doc_id") % 10 == 0).alias("a"), F.sum(F.when(F.col("doc_id") % 10 == 0, F.col("n_chars"))).alias("b"), F.count("*").alias("n"))
    return t.select(corpus.extrapolated(F.col("a"), F.col("b"), F.col("n")).alias("expected"))


@query("g4_rare_entities", D + f", {SQL_PERSONS} SELECT person AS entity, count(DISTINCT p.document) AS df, min(p.document) AS first FROM persons p JOIN docs USING (doc_id) WHERE contains(docs.text, person) GROUP BY person HAVING df BETWEEN 2 AND 4")
def _(s, d):
    return corpus.rare_entities(_persons(s, d), 2, 4)


@query("g5_document_frequency", "WITH t AS (SELECT DISTINCT string_split(text, ' ')[2] AS term FROM benchmark) SELECT term, count(DISTINCT doc_id) AS df FROM t JOIN documents ON contains(text, term) GROUP BY term")
def _(s, d):
    from corpusloom.operators import filters

    terms = table(s, d, "benchmark").select(F.get(F.split("text", " "), F.lit(1)).alias("term")).distinct()
    return filters.containing(table(s, d, "documents"), terms, "doc_id").groupBy("term").agg(F.count_distinct("doc_id").alias("df"))


@query("g6_title_counts", D + " SELECT trim(regexp_replace(regexp_replace(lower(head), '^\\d+\\.\\s*', ''), '\\s+', ' ', 'g')) AS title, count(*) AS n FROM docs GROUP BY 1")
def _(s, d):
    return corpus.title_counts(docs(s, d))


@query("g7_distinctive_titles", D + " SELECT head, min(document) AS document FROM docs GROUP BY head HAVING count(*) = 1 AND length(head) > 40 AND length(head) < 160")
def _(s, d):
    return corpus.distinctive_titles(docs(s, d))


@query("g8_unique_pairs", D + ", w AS (SELECT unnest(['enanthe', 'that', 'avec', 'nicht', 'para', 'schon']) AS word), t AS (SELECT DISTINCT document, date_from, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM docs WHERE date_from <> '') SELECT word, date_from, min(document) AS document FROM t JOIN w USING (word) GROUP BY word, date_from HAVING count(*) = 1")
def _(s, d):
    words = s.createDataFrame([(w,) for w in ("enanthe", "that", "avec", "nicht", "para", "schon")], "word string")
    return corpus.unique_pairs(docs(s, d), words)


@query("g9_dated_windows", D + """, k AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY date_from, document) AS k, count(*) OVER (PARTITION BY volume_id) AS n FROM docs WHERE date_from <> ''),
e AS (SELECT volume_id, max(CASE WHEN k = 3 THEN date_from END) AS first, max(CASE WHEN k = 8 THEN date_from END) AS last FROM k WHERE n >= 12 GROUP BY volume_id) SELECT volume_id, first, last, count(*) AS n_inside FROM k JOIN e USING (volume_id) WHERE date_from BETWEEN first AND last GROUP BY ALL""")
def _(s, d):
    return corpus.dated_windows(docs(s, d))


@query("jno_subset", M + " SELECT count(DISTINCT volume_id) AS n_missing FROM docs WHERE volume_id NOT IN (SELECT volume_id FROM manifest WHERE status = 'published')")
def _(s, d):
    return corpus.subset(docs(s, d), manifest(s, d).where("status = 'published'"), "volume_id")


_ARRAYS = f"{D}, {SQL_QUESTIONS}, {SQL_GOLD}, {sql_bm25('bm25', 'text', 10)}, gs AS (SELECT query_id, list(id) AS gold FROM gold GROUP BY query_id), fs AS (SELECT query_id, list(id) AS found FROM bm25 GROUP BY query_id)"


@query("sc16_sc17_blocks", f"{D}, {SQL_QUESTIONS}, {sql_bm25('bm25', 'text', 5)} SELECT query_id, string_agg(CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 100), '...') ELSE text END, '\n\n---\n\n' ORDER BY rank) AS block FROM bm25 JOIN docs ON doc_id = id GROUP BY query_id")
def _(s, d):
    hits = body_hits(s, d, 5).join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id")
    parts = F.array_sort(F.collect_list(F.struct("rank", text.truncated(F.col("text"), 100, "...").alias("t"))))  # five at most
    return hits.groupBy("query_id").agg(text.blocks(F.transform(parts, lambda p: p["t"])).alias("block"))


@query("g10_recall_precision", _ARRAYS + " SELECT q.query_id, round(len(list_intersect(gold, found)) / CAST(len(gold) AS DOUBLE), 6) AS recall, round(coalesce(len(list_intersect(gold, found)), 0) / CAST(len(found) AS DOUBLE), 6) AS precision FROM questions q LEFT JOIN gs USING (query_id) LEFT JOIN fs USING (query_id)")
def _(s, d):
    ids = lambda h, n: h.groupBy("query_id").agg(F.collect_list("id").alias(n))
    empty = F.array().cast("array<long>")
    rows = questions(s, d).select("query_id").join(ids(gold(s, d), "gold"), "query_id", "left").join(ids(body_hits(s, d, 10), "found"), "query_id", "left")
    rows = rows.withColumns({"gold": F.coalesce("gold", empty), "found": F.coalesce("found", empty)})
    return rows.select("query_id", F.round(evaluate.recall(F.col("gold"), F.col("found")), 6).alias("recall"), F.round(evaluate.precision(F.col("gold"), F.col("found")), 6).alias("precision"))


_RANK = "list_sort(list(CASE WHEN {w} THEN {c} END) FILTER (WHERE {w} AND {c} IS NOT NULL))"
_NEAR = "list_extract(" + _RANK + ", CAST(round_even({p} * (count(CASE WHEN {w} THEN {c} END) - 1), 0) AS BIGINT) + 1)"
_M = "round_even(avg(CASE WHEN {w} THEN {c} END), 4) AS {n}"
_OK, _A, _U, _AB = "outcome <> 'error'", "outcome <> 'error' AND answerable", "outcome <> 'error' AND NOT answerable", "outcome = 'abstained'"
_S = "round_even(count(*) FILTER (WHERE {h}) / nullif(CAST(count(*) FILTER (WHERE {a}) AS DOUBLE), 0), 4) AS {n}"
SQL_SUMMARY = f"""count(*) AS n_runs, count(*) FILTER (WHERE outcome = 'error') AS n_errors, count(*) FILTER (WHERE {_A}) AS n_answerable, count(*) FILTER (WHERE {_U}) AS n_unanswerable,
{_M.format(w=_A, c='union_recall', n='union_recall')}, {_M.format(w=_A, c='accepted_recall', n='accepted_recall')}, {_M.format(w=_A, c='citation_recall', n='citation_recall')},
round_even(100 * (avg(CASE WHEN {_A} THEN accepted_recall END) - avg(CASE WHEN {_A} THEN union_recall END)), 2) AS grading_delta_pp,
{_M.format(w=_OK, c='judge_score', n='correctness')}, count(CASE WHEN {_OK} THEN judge_score END) AS n_judged,
{_S.format(h=f'{_U} AND {_AB}', a=_U, n='abstain_recall')}, {_S.format(h=f'{_U} AND {_AB}', a=f'{_OK} AND {_AB}', n='abstain_precision')}, {_S.format(h=f'{_A} AND {_AB}', a=_A, n='false_abstain')},
{_S.format(h=f'{_OK} AND actual_route = expected_route', a=_OK, n='route_accuracy')},
round_even(100 * count(*) FILTER (WHERE {_OK} AND expected_route = 'simple' AND actual_route <> 'simple') / nullif(CAST(count(*) FILTER (WHERE {_OK} AND expected_route = 'simple') AS DOUBLE), 0), 2) AS over_decomposed_pct,
{_M.format(w=_OK, c='llm_calls', n='llm_calls')}, {_M.format(w=_OK, c='retrieval_calls', n='retrieval_calls')}, {_NEAR.format(p='CAST(0.5 AS DOUBLE)', w=_OK, c='latency_s')} AS p50_s, {_NEAR.format(p='CAST(0.95 AS DOUBLE)', w=_OK, c='latency_s')} AS p95_s"""


@query("g11_g12_g14_summary_by_system", R + f" SELECT system, {SQL_SUMMARY} FROM runs GROUP BY system")
def _(s, d):
    return evaluate.summarise(runs(s, d), "system")


@query("g14_summary_by_kind", R + f" SELECT system, kind, {SQL_SUMMARY} FROM runs WHERE kind IN ('lookup', 'multihop', 'correction') GROUP BY system, kind")
def _(s, d):
    return evaluate.summarise(runs(s, d).where(F.col("kind").isin("lookup", "multihop", "correction")), "system", "kind")


SQL_F1 = """fl AS (SELECT unnest(['simple', 'lookup', 'timeline', 'complex', 'status']) AS label), fp AS (SELECT system, label, count(*) FILTER (WHERE expected_route = label AND actual_route = label) AS tp, count(*) FILTER (WHERE expected_route <> label AND actual_route = label) AS fp, count(*) FILTER (WHERE expected_route = label AND actual_route <> label) AS fn FROM runs CROSS JOIN fl GROUP BY system, label),
f1 AS (SELECT system, round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM fp WHERE tp + fp + fn > 0 GROUP BY system)"""


@query("g13_macro_f1", f"{R}, {SQL_F1} SELECT * FROM f1")
def _(s, d):
    return evaluate.macro_f1(runs(s, d), "system")


@query("g15_jnh_paired", R + """, x AS (SELECT case_id, language, avg(citation_recall) AS x FROM runs WHERE system = 'B0' AND outcome <> 'error' GROUP BY ALL), y AS (SELECT case_id, language, avg(citation_recall) AS y FROM runs WHERE system = 'B3' AND outcome <> 'error' GROUP BY ALL),
d AS (SELECT round(y - x, 9) AS d FROM x JOIN y USING (case_id, language) WHERE x IS NOT NULL AND y IS NOT NULL) SELECT count(*) AS n, round(100 * avg(d), 4) AS mean_pp, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses, count(*) FILTER (WHERE d = 0) AS ties, round(100 * stddev_samp(d), 4) AS stdev_pp FROM d""")
def _(s, d):
    return evaluate.paired(runs(s, d), "B0", "B3", "citation_recall")


@query("g16_gates", f"""{R}, {SQL_F1}, ok AS (SELECT * FROM runs WHERE outcome <> 'error'), v AS (SELECT system, round_even(avg(judge_score), 4) AS correctness, round_even(avg(CASE WHEN answerable THEN citation_recall END), 4) AS citation, round_even(avg(retrieval_calls), 4) AS calls,
round_even(100 * count(*) FILTER (WHERE expected_route = 'simple' AND actual_route <> 'simple') / CAST(count(*) FILTER (WHERE expected_route = 'simple') AS DOUBLE), 2) AS over_pct, round_even(avg(CASE WHEN kind = 'multihop' AND answerable THEN union_recall END), 4) AS multihop,
count(*) FILTER (WHERE NOT answerable AND outcome = 'answered') AS leaks, {_NEAR.format(p='CAST(0.95 AS DOUBLE)', w='true', c='latency_s')} AS p95 FROM ok GROUP BY system),
b AS (SELECT * FROM v WHERE system = 'B0'), f AS (SELECT v.*, macro_f1 FROM v JOIN f1 USING (system) WHERE system = 'B3'),
x AS (SELECT 100 * (f.multihop - b.multihop) AS rg, 100 * (f.correctness - b.correctness) AS cg, f.calls / b.calls AS budget, f.macro_f1 AS f1, f.over_pct AS ov, f.leaks AS leaks, f.citation AS cit, f.p95 AS p, b.p95 AS bp FROM b, f),
g AS (SELECT '1 multihop recall gain' AS gate, rg AS value, rg >= 10 OR cg >= 10 AS passed FROM x UNION ALL SELECT '1 correctness gain', cg, rg >= 10 OR cg >= 10 FROM x UNION ALL SELECT '1 retrieval budget', budget, NULL FROM x UNION ALL SELECT '2 route macro f1', f1, f1 >= 0.8 AND ov <= 20 FROM x
UNION ALL SELECT '2 over-decomposed', ov, f1 >= 0.8 AND ov <= 20 FROM x UNION ALL SELECT '3 answers to the unanswerable', leaks, leaks = 0 FROM x UNION ALL SELECT '4 citation recall', cit, NULL FROM x UNION ALL SELECT '5 latency', p, p <= 30 AND p <= 2.5 * bp FROM x)
SELECT gate, round(CAST(value AS DOUBLE), 4) AS value, passed FROM g""")
def _(s, d):
    return evaluate.gates(runs(s, d), "B0", "B3")


@query("g17_g24_route_stability", R + """, n AS (SELECT intent, actual_route, count(*) AS n FROM runs GROUP BY ALL), t AS (SELECT intent, max(n) AS n_major, count(*) AS n_routes FROM n GROUP BY intent), m AS (SELECT intent, actual_route AS majority FROM n QUALIFY row_number() OVER (PARTITION BY intent ORDER BY n DESC, actual_route) = 1),
p AS (SELECT intent, count(*) AS n, round(avg(CASE WHEN actual_route = expected_route THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(quantile_cont(latency_s, 0.5), 6) AS median_s FROM runs GROUP BY intent)
SELECT intent, p.n, n_routes = 1 AS consistent, majority, round(n_major / CAST(p.n AS DOUBLE), 6) AS share, accuracy, median_s FROM p JOIN t USING (intent) JOIN m USING (intent)""")
def _(s, d):
    return evaluate.route_stability(runs(s, d))


def _score_rows(s, d):
    lab = table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_gold"))
    return docs(s, d).join(lab, "doc_id").select(F.col("lang").alias("language"), (F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string"))).alias("kind"), "is_gold", (((F.col("doc_id") * 37) % 101).cast("double") / 10 - 5).alias("score"))


_GQ = "list_extract(list_sort(list(score) FILTER (WHERE is_gold)), CAST(least(count(*) FILTER (WHERE is_gold) - 1, floor(CAST({q} AS DOUBLE) * count(*) FILTER (WHERE is_gold))) AS BIGINT) + 1)"


@query("g18_g19_separation", D + """, r AS (SELECT lang AS language, concat('k', CAST(d.doc_id % 3 AS STRING)) AS kind, quality = 1 AS is_gold, CAST((d.doc_id * 37) % 101 AS DOUBLE) / 10 - 5 AS score FROM docs d JOIN labels l ON l.doc_id = d.doc_id),
g AS (SELECT coalesce(language, '*') AS slice_language, coalesce(kind, '*') AS slice_kind, count(*) AS n, count(*) FILTER (WHERE is_gold) AS n_gold, round(avg(CASE WHEN is_gold THEN score END), 6) + 0.0 AS mean_gold, round(avg(CASE WHEN NOT is_gold THEN score END), 6) + 0.0 AS mean_other, """ + ", ".join(f"{_GQ.format(q=q)} AS gold_p{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", " + ", ".join(f"{_GQ.format(q=repr(1 - k / 100))} AS floor_{k}" for k in (100, 95, 90)) + ", list(score) AS every FROM r GROUP BY GROUPING SETS ((), (language), (kind), (language, kind))) SELECT * EXCLUDE (every), " + ", ".join(f"CASE WHEN n_gold > 0 THEN round(len(list_filter(every, lambda x: x >= floor_{k})) / CAST(n AS DOUBLE), 6) END AS kept_{k}" for k in (100, 95, 90)) + " FROM g")
def _(s, d):
    return evaluate.separation(_score_rows(s, d))


SQL_METRICS = f"{D}, {SQL_QUESTIONS}, {SQL_GOLD}, {sql_bm25('bm25', 'text', 50)}, gn AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id), ff AS (SELECT b.query_id, min(rank) AS first, count(*) FILTER (WHERE rank <= 20) AS in_20 FROM bm25 b JOIN gold g ON g.query_id = b.query_id AND g.id = b.id GROUP BY b.query_id), gm AS (SELECT q.query_id, CASE WHEN q.query_id % 2 = 0 THEN 'en' ELSE 'zh' END AS language, n_gold, first, in_20 FROM questions q JOIN gn USING (query_id) LEFT JOIN ff USING (query_id))"


@query("g22_retrieval_metrics", SQL_METRICS + " SELECT language, count(*) AS n_queries, round(avg(coalesce(in_20, 0) / CAST(n_gold AS DOUBLE)), 6) AS recall_20, round(avg(CASE WHEN coalesce(first <= 1, false) THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN coalesce(first <= 10, false) THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(first), 6) AS mean_first FROM gm GROUP BY language")
def _(s, d):
    q = questions(s, d).withColumn("language", F.when(F.col("query_id") % 2 == 0, "en").otherwise("zh"))
    return evaluate.retrieval_metrics(body_hits(s, d), gold(s, d), q, "language")


@query("jni_floor_on_runs", f"{SQL_METRICS}, fl AS (SELECT concat('c', CAST(query_id AS STRING)) AS case_id, round(coalesce(in_20, 0) / CAST(n_gold AS DOUBLE), 6) AS candidate_recall FROM gm), {SQL_RUNS} SELECT run_id, candidate_recall FROM runs LEFT JOIN fl USING (case_id)")
def _(s, d):
    q = questions(s, d).withColumn("case_id", F.concat(F.lit("c"), F.col("query_id").cast("string")))
    floor = evaluate.retrieval_metrics(body_hits(s, d), gold(s, d), q, "case_id").select("case_id", F.col("recall_20").alias("candidate_recall"))
    return runs(s, d).join(floor, "case_id", "left").select("run_id", "candidate_recall")


@query("jnp_cases_on_runs", R + ", g AS (SELECT item_id, concat('c', CAST(item_id AS STRING)) AS case_id, length(text) AS n FROM benchmark) SELECT run_id, coalesce(n, 0) AS n FROM runs LEFT JOIN g USING (case_id)")
def _(s, d):
    g = table(s, d, "benchmark").select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("case_id"), F.length("text").alias("n"))
    return runs(s, d).join(g, "case_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("g20_coverage", f"{D}, {SQL_QUESTIONS}, {SQL_GOLD}, {sql_bm25('bm25', 'text', 10)}, c AS (SELECT g.query_id, g.id % 60 AS document, g.id % 2 = 0 AS is_gold_chunk, b.id IS NOT NULL AND g.id % 5 <> 0 AS retrieved FROM gold g LEFT JOIN bm25 b ON b.query_id = g.query_id AND b.id = g.id), p AS (SELECT query_id, document, bool_or(retrieved) AS dh, bool_or(retrieved AND is_gold_chunk) AS ch FROM c GROUP BY ALL) SELECT count(*) AS n, round(avg(CASE WHEN dh THEN 1.0 ELSE 0.0 END), 6) AS document_recall, round(avg(CASE WHEN ch THEN 1.0 ELSE 0.0 END), 6) AS chunk_recall, count(*) FILTER (WHERE dh AND NOT ch) AS wrong_chunk FROM p")
def _(s, d):
    hit = body_hits(s, d, 10).select("query_id", "id", F.lit(True).alias("h"))
    rows = gold(s, d).join(hit, ["query_id", "id"], "left")
    return evaluate.coverage(rows.select("query_id", (F.col("id") % 60).alias("document"), (F.col("id") % 2 == 0).alias("is_gold_chunk"), (F.col("h").isNotNull() & (F.col("id") % 5 != 0)).alias("retrieved")))


@query("g21_best_chunk", f"{D}, {SQL_QUESTIONS}, {sql_bm25('bm25', 'text', 50)} SELECT query_id, id % 30 AS document, id AS best FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id, id % 30 ORDER BY score DESC, id DESC) = 1")
def _(s, d):
    return evaluate.best_chunk(body_hits(s, d).withColumn("document", F.col("id") % 30))


@query("g23_w10_timeline", f"{D}, {SQL_QUESTIONS}, {sql_bm25('bm25', 'text', 5)}, t AS (SELECT query_id, id, date_from, rank, lag(date_from) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM bm25 JOIN docs ON doc_id = id) SELECT query_id, count(*) AS n, bool_and(date_from BETWEEN '1905-01-01' AND '1975-12-31') AS in_range, bool_and(coalesce(before <= date_from, true)) AS chronological FROM t GROUP BY query_id")
def _(s, d):
    rows = body_hits(s, d, 5).join(docs(s, d).select(F.col("doc_id").alias("id"), "date_from"), "id").withColumnRenamed("rank", "position")
    return evaluate.timeline_check(rows, "1905-01-01", "1975-12-31")


@query("g25_actor_overlap", R + ", a AS (SELECT case_id, list(DISTINCT actual_route) FILTER (WHERE language = 'en') AS x, list(DISTINCT actual_route) FILTER (WHERE language = 'zh') AS y FROM runs GROUP BY case_id) SELECT case_id, round(CASE WHEN len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(x, []), coalesce(y, []))) / CAST(len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) AS DOUBLE) END, 6) AS overlap FROM a")
def _(s, d):
    side = lambda lang: F.collect_set(F.when(F.col("language") == lang, F.col("actual_route")))
    a = runs(s, d).groupBy("case_id").agg(side("en").alias("x"), side("zh").alias("y"))
    return a.select("case_id", F.round(select.jaccard(F.col("x"), F.col("y")), 6).alias("overlap"))


@query("g26_abstention_without_leaks", R + " SELECT kind, round_even(count(*) FILTER (WHERE outcome = 'abstained') / CAST(count(*) AS DOUBLE), 4) AS rate, count(*) AS n FROM runs WHERE outcome <> 'error' AND coalesce(citation_recall, 0) = 0 GROUP BY kind")
def _(s, d):
    clean = runs(s, d).where("outcome <> 'error' and coalesce(citation_recall, 0) = 0")
    return clean.groupBy("kind").agg(evaluate._share(F.col("outcome") == "abstained").alias("rate"), F.count("*").alias("n"))


@query("g27_volume_curve", R + ", p AS (SELECT llm_calls AS level, round(avg(judge_score), 6) AS mean_score FROM runs GROUP BY llm_calls) SELECT level, mean_score, (SELECT min(mean_score) >= 0.7 * max(mean_score) FROM p) AS passed FROM p")
def _(s, d):
    return evaluate.volume_curve(runs(s, d).select(F.col("llm_calls").alias("level"), F.col("judge_score").alias("score")))


@query("g28_both_found", R + ", c AS (SELECT case_id, run_id % 3 AS n_found FROM runs WHERE kind = 'multihop') SELECT round(avg(n_found), 6) AS mean_found, round(avg(CASE WHEN n_found >= 1 THEN 1.0 ELSE 0.0 END), 6) AS any_found, round(avg(CASE WHEN n_found >= 2 THEN 1.0 ELSE 0.0 END), 6) AS both_found FROM c")
def _(s, d):
    return evaluate.both_found(runs(s, d).where("kind = 'multihop'").select("case_id", (F.col("run_id") % 3).alias("n_found")))


@query("g29_abstain_reasons", R + ", x AS (SELECT kind, CASE WHEN NOT answerable THEN 'correctly abstained' WHEN coalesce(union_recall, 0) = 0 THEN 'no gold retrieved' WHEN run_id % 3 = 0 THEN 'citation gate' ELSE 'other' END AS reason, count(*) AS n FROM runs WHERE outcome = 'abstained' GROUP BY 1, 2) SELECT kind, reason, n, round(n / CAST(sum(n) OVER (PARTITION BY kind) AS DOUBLE), 6) AS share FROM x")
def _(s, d):
    r = runs(s, d).where("outcome = 'abstained'").withColumn("n_citations", F.col("run_id") % 3)
    return evaluate.reason_counts(r, evaluate.abstain_reason(), "kind")


#: Questions on passages: every fifth names a document or a date, every third of the others is put in Chinese, kinds alternate.
_PUT = "CASE WHEN query_id % 10 = 0 THEN concat('What does Doc. 3 say of ', query) WHEN query_id % 10 = 5 THEN concat(query, ' on 1962-10-22') ELSE query END"
_LANG = "CASE WHEN query_id % 3 = 0 THEN 'zh-TW' ELSE 'en' END"
_KIND = "CASE query_id % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'multihop' WHEN 2 THEN 'correction' ELSE 'timeline' END"


def asked_questions(s, d):
    return questions(s, d).selectExpr("query_id", f"{_PUT} AS question", f"{_LANG} AS language", f"{_KIND} AS kind", "query")


HARD = 11  # a passage's eleventh word alone: too little to find some passages by; they are missed for all five causes


def hard_hits(s, d, limit):
    """What one word of each passage finds."""
    from corpusloom.plans import inputs

    words = F.slice(F.split("text", " "), HARD, 1)
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))
    return retrieval.bm25(asked, inputs.index(s, d, "text"), limit)


@query("g30_missed", f"{D}, {SQL_QUESTIONS.replace(f'1, {QUERY_WORDS}', f'{HARD}, {HARD}')}, {SQL_GOLD}, {sql_bm25('bm25', 'text', 20)}, " + f"""m AS (SELECT query_id, {_PUT} AS question, {_LANG} AS language, {_KIND} AS kind FROM questions WHERE query_id IN (SELECT query_id FROM gold) AND query_id NOT IN (SELECT b.query_id FROM bm25 b JOIN gold g ON g.query_id = b.query_id AND g.id = b.id)),
c AS (SELECT CASE WHEN regexp_matches(question, '(?i)(titled|標題為|Doc\\.|document\\s+\\d+|第\\s*\\d+\\s*號)') OR regexp_matches(question, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{4}}\\s*年') THEN 'A precise title/date/person' WHEN language = 'zh-TW' THEN 'B cross-language' WHEN kind = 'multihop' THEN 'D multi-hop bridging'
WHEN kind = 'correction' THEN 'C modern phrasing vs archival wording' ELSE 'E general semantic miss' END AS reason, count(*) AS n FROM m GROUP BY 1) SELECT reason, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM c""")
def _(s, d):
    m = evaluate.missed(hard_hits(s, d, 20), gold(s, d), asked_questions(s, d))
    return evaluate.reason_counts(m, evaluate.miss_cause())


_CONFIGS = ["B0", "B1", "B2", "B3"]


def _matrix(s, d):
    return evaluate.matrix(runs(s, d).where("judge_score is not null").withColumnRenamed("system", "config"), _CONFIGS, "judge_score")


SQL_MATRIX = "mx AS (SELECT case_id, " + ", ".join(f"round(avg(CASE WHEN system = '{c}' THEN judge_score END), 6) AS {c}" for c in _CONFIGS) + " FROM runs WHERE judge_score IS NOT NULL GROUP BY case_id)"
_SPREAD = "round(greatest(" + ", ".join(_CONFIGS) + ") - least(" + ", ".join(_CONFIGS) + "), 6)"


@query("g31_g34_matrix", f"{R}, {SQL_MATRIX} SELECT *, {_SPREAD} AS spread FROM mx")
def _(s, d):
    return _matrix(s, d)


@query("g31_rank_agreement", R + """, f AS (SELECT system AS config, avg(judge_score) AS mean FROM runs GROUP BY system), p AS (SELECT system AS config, avg(judge_score) AS sub FROM runs WHERE case_id IN ('c1', 'c2', 'c3') GROUP BY system), m AS (SELECT * FROM f JOIN p USING (config)),
x AS (SELECT CASE WHEN sign(a.mean - b.mean) = sign(a.sub - b.sub) THEN 1.0 ELSE 0.0 END AS same FROM m a JOIN m b ON a.config < b.config WHERE abs(a.mean - b.mean) >= 0.0005) SELECT count(*) AS n_pairs, round(avg(same), 6) AS agreement, (SELECT round(max(abs(mean - sub)), 6) FROM m) AS max_error FROM x""")
def _(s, d):
    mean = lambda r: r.groupBy(F.col("system").alias("config")).agg(F.avg("judge_score").alias("mean"))
    return evaluate.rank_agreement(mean(runs(s, d)), mean(runs(s, d).where(F.col("case_id").isin("c1", "c2", "c3"))), 0.0005)


@query("g32_greedy_subset")
def _(s, d):
    m = _matrix(s, d).orderBy("case_id").select("case_id", *_CONFIGS).toPandas().dropna()  # a row for each case of the evaluation set
    chosen, errors = evaluate.greedy_subset(m[_CONFIGS].to_numpy(), 8)
    return s.createDataFrame([(k, m.case_id.iloc[c], round(e, 6)) for k, (c, e) in enumerate(zip(chosen, errors, strict=True))], "step int, case_id string, error double")


@query("g33_verifier_rates", R + " SELECT round_even(avg(CASE WHEN answerable AND judge_score IS NOT NULL THEN CAST(judge_score >= 0.5 AS INTEGER) END), 4) AS tpr, round_even(avg(CASE WHEN NOT answerable AND judge_score IS NOT NULL THEN CAST(judge_score >= 0.5 AS INTEGER) END), 4) AS fpr FROM runs")
def _(s, d):
    yes, judged = F.col("judge_score") >= 0.5, F.col("judge_score").isNotNull()
    return runs(s, d).agg(evaluate.mean(F.when(F.col("answerable") & judged, yes.cast("int"))).alias("tpr"), evaluate.mean(F.when(~F.col("answerable") & judged, yes.cast("int"))).alias("fpr"))


@query("w11_pinned", f"{R}, {SQL_MATRIX}, k AS (SELECT DISTINCT case_id, kind, language FROM runs), sp AS (SELECT k.kind, k.language, k.case_id, {_SPREAD} AS spread FROM mx JOIN k USING (case_id)) SELECT kind, language, case_id FROM sp QUALIFY row_number() OVER (PARTITION BY kind, language ORDER BY spread DESC, case_id DESC) = 1")
def _(s, d):
    k = runs(s, d).select("case_id", "kind", "language").distinct()
    return evaluate.pinned(_matrix(s, d).join(k, "case_id"))


@query("x6_judged", R + " SELECT run_id, CASE WHEN NOT answerable THEN CAST(outcome = 'abstained' AS DOUBLE) WHEN outcome = 'abstained' THEN 0.0 ELSE judge_score END AS score FROM runs")
def _(s, d):
    from corpusloom.plans import plugs

    return plugs.judged(runs(s, d), F.col("judge_score")).select("run_id", "score")


@query("r4_x2_encode")
def _(s, d):
    from corpusloom.plans import plugs

    encode = plugs.encoder(plugs.hashed_encoder())
    return table(s, d, "benchmark").select("item_id", encode("text").alias("v")).select("item_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("norm2"))


@query("n16_questions", D + " SELECT document, concat('What does \"', head, '\" say?') AS question FROM docs WHERE doc_id IN (SELECT min(doc_id) FROM docs GROUP BY head HAVING count(*) = 1) AND length(head) > 40 AND length(head) < 160 ORDER BY md5(concat('11:', document)), document LIMIT 40")
def _(s, d):
    t = corpus.distinctive_titles(docs(s, d))
    return select.seeded_sample(t, "document", 40, 11).select("document", F.concat(F.lit('What does "'), "head", F.lit('" say?')).alias("question"))




def _cases(df):
    return df.select("case_id", "kind", "question", F.array_join("gold", "|").alias("gold"))


_TITLES = "tt AS (SELECT head, min(document) AS document FROM docs GROUP BY head HAVING count(*) = 1 AND length(head) > 40 AND length(head) < 160)"


@query("n16_lookups", f"{D}, {_TITLES} SELECT concat('lookup:', document) AS case_id, 'lookup' AS kind, concat('What does \"', head, '\" say?') AS question, document AS gold FROM tt")
def _(s, d):
    return _cases(generators.lookups(docs(s, d)))


@query("n16_multihops", f"{D}, {SQL_PERSONS} SELECT concat('multihop:', person) AS case_id, 'multihop' AS kind, concat('What do the two documents that name ', person, ' have in common?') AS question, concat(min(p.document), '|', max(p.document)) AS gold FROM persons p JOIN docs USING (doc_id) WHERE contains(docs.text, person) GROUP BY person HAVING count(DISTINCT p.document) = 2")
def _(s, d):
    return _cases(generators.multihops(_persons(s, d)))


@query("n16_corrections", f"{D}, {_TITLES} SELECT concat('correction:', document) AS case_id, 'correction' AS kind, concat('What was said on ', CAST(CAST(substring(date_from, 1, 4) AS BIGINT) + 7 AS STRING), substring(date_from, 5, 6), ' in \"', tt.head, '\"?') AS question, document AS gold FROM tt JOIN docs USING (document) WHERE date_from <> ''")
def _(s, d):
    return _cases(generators.corrections(docs(s, d)))


@query("n16_unanswerable", M + " SELECT concat('unanswerable:', volume_id) AS case_id, 'unanswerable' AS kind, concat('What does document 1 of ', title, ' say?') AS question, '' AS gold FROM manifest WHERE status <> 'published'")
def _(s, d):
    return _cases(generators.unanswerable(manifest(s, d)))


@query("n16_timelines", D + """, k AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY date_from, document) AS k, count(*) OVER (PARTITION BY volume_id) AS n FROM docs WHERE date_from <> ''),
e AS (SELECT volume_id, max(CASE WHEN k = 3 THEN date_from END) AS first, max(CASE WHEN k = 8 THEN date_from END) AS last FROM k WHERE n >= 12 GROUP BY volume_id)
SELECT concat('timeline:', volume_id) AS case_id, 'timeline' AS kind, concat('What happened between ', first, ' and ', last, '?') AS question, string_agg(document, '|' ORDER BY document) AS gold FROM k JOIN e USING (volume_id) WHERE date_from BETWEEN first AND last GROUP BY volume_id, first, last""")
def _(s, d):
    return _cases(generators.timelines(docs(s, d)))


@query("n15_sweep", f"{R}, c AS (SELECT concat('c', CAST(item_id AS STRING)) AS case_id FROM benchmark), g AS (SELECT case_id, unnest(['B0', 'B3']) AS system FROM c), a AS (SELECT case_id, system, unnest(['en', 'zh']) AS language FROM g) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.case_id = a.case_id AND r.system = a.system AND r.language = a.language AND r.mode = 'partial')")
def _(s, d):
    cases = table(s, d, "benchmark").select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("case_id"))
    return generators.sweep(cases, ["B0", "B3"], ["en", "zh"], runs(s, d), "partial")


_HOPS = "CASE WHEN item_id % 3 = 0 THEN concat('src', CAST(item_id % 20 AS STRING)) WHEN item_id % 3 = 1 THEN 'Volume src2' ELSE 'nowhere' END"


@query("n2_hop_filters", f"{M}, h AS (SELECT item_id AS query_id, {_HOPS} AS v, CASE WHEN item_id % 2 = 0 THEN '1920-01-01' ELSE 'about 1920' END AS f FROM benchmark) SELECT query_id, CASE WHEN v = 'Volume src2' THEN 'src2' WHEN v <> 'nowhere' THEN v END AS volume_id, CASE WHEN v = 'nowhere' THEN v END AS rejected, CASE WHEN f LIKE '1920%' THEN f END AS date_from, 'historical-document' AS subtype FROM h")
def _(s, d):
    from corpusloom.plans import agent

    hops = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_HOPS).alias("volume"), F.when(F.col("item_id") % 2 == 0, "1920-01-01").otherwise("about 1920").alias("date_from"))
    return agent.hop_filters(hops, manifest(s, d))
