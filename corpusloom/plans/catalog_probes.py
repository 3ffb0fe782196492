"""Queries on probes: their cases from the documents' metadata, their figures from runs and hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import chunks
from corpusloom.plans import plugs, probes
from corpusloom.plans.catalog_eval import _TITLES, R
from corpusloom.plans.catalog_rank import SQL_GOLD, SQL_HOPS, SQL_QUESTIONS, body_hits, gold, route_questions, sql_bm25
from corpusloom.plans.catalog_text import Q as TEXT_Q
from corpusloom.plans.inputs import SQL_DOCS, SQL_MANIFEST, docs, manifest, runs, table

Q: dict = {}
D, M = f"WITH {SQL_DOCS}", f"WITH {SQL_DOCS}, {SQL_MANIFEST}"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def _flat(df):
    return df.withColumn("gold", F.array_join("gold", "|"))


_PICKED = "x AS (SELECT docs.* FROM tt JOIN docs USING (document) WHERE length(text) > 800 AND date_from <> '')"


@query("n16_probe_p4", f"{D}, {_TITLES}, {_PICKED} SELECT concat('p4:', document) AS case_id, concat('Which document of the series is titled ''', head, ''' and dated ', date_from, '?') AS question_en, concat('標題為「', head, '」、日期為 ', date_from, ' 的是哪一份文件？') AS question_zh, document AS gold FROM x")
def _(s, d):
    return _flat(probes.precise(docs(s, d)))


@query("n16_probe_p3", f"{D}, {_TITLES}, {_PICKED} SELECT concat('p3:', document) AS case_id, level FROM x, (SELECT unnest([2, 4, 8, 16]) AS level)")
def _(s, d):
    return probes.growing(docs(s, d)).select("case_id", "level")


#: Titles with the name of a country in most of them.
_ON = "concat('The note on ', CASE doc_id % 9 WHEN 0 THEN 'Mexico' WHEN 1 THEN 'Chinatown' WHEN 2 THEN 'China' WHEN 3 THEN 'Japan,' WHEN 4 THEN 'no country' WHEN 5 THEN 'Cuba' WHEN 6 THEN 'Brazil and Italy' ELSE 'Korea' END)"


@query("n16_probe_p5", f"{D}, h AS (SELECT document, date_from, text, {_ON} AS head FROM docs WHERE regexp_full_match(date_from, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')), c AS (SELECT * FROM (VALUES ('Mexico', '墨西哥'), ('China', '中國'), ('Japan', '日本'), ('France', '法國'), ('Germany', '德國'), ('Russia', '俄國'), ('Cuba', '古巴'), ('Spain', '西班牙'), ('Italy', '義大利'), ('Turkey', '土耳其'), ('Korea', '韓國'), ('Brazil', '巴西')) t(en, zh))," + """
o AS (SELECT en, zh, date_from, min(document) AS document FROM h JOIN c ON regexp_matches(head, concat('\\b', en, '\\b')) GROUP BY en, zh, date_from HAVING count(*) = 1 AND min(length(text)) >= 800)
SELECT concat('p5:', en) AS case_id, concat('What does the ', date_from, ' diplomatic document on ', en, ' say?') AS question_en, concat(substring(date_from, 1, 4), ' 年 ', CAST(CAST(substring(date_from, 6, 2) AS INT) AS STRING), ' 月 ', CAST(CAST(substring(date_from, 9, 2) AS INT) AS STRING), ' 日關於', zh, '的那份外交文件說了什麼？') AS question_zh, document AS gold, date_from AS date FROM o QUALIFY row_number() OVER (PARTITION BY en ORDER BY date_from) = 1""")
def _(s, d):
    return _flat(probes.cross_language(docs(s, d).withColumn("head", F.expr(_ON))))


@query("n16_probe_p6", D + ", x AS (SELECT volume_id, document, concat('A head of thirty letters and more ', document) AS head, doc_id, concat('d', CAST(doc_id % 50 + 1 AS STRING)) AS target FROM docs) SELECT concat('p6:', document) AS case_id, concat('In volume ', volume_id, ', what does the document titled ''', head, ''' say, and what does the document it cross-references add?') AS question_en, concat(document, '|', volume_id, ':', target) AS gold, doc_id % 3 = 0 AS linked FROM x")
def _(s, d):
    rows = docs(s, d).withColumn("head", F.concat(F.lit("A head of thirty letters and more "), "document")).withColumn("target", F.concat(F.lit("d"), (F.col("doc_id") % 50 + 1).cast("string")))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see Doc. "), F.substring("target", 2, 9), F.lit(" there"))).otherwise(F.concat(F.lit("see Doc. "), F.substring("target", 2, 9), F.lit("0 there")))
    edges = rows.select("volume_id", "document_id", "target")
    return _flat(probes.cross_referenced(edges, rows.withColumn("text", said))).drop("question_zh")


@query("n16_probe_p7", f"{M}, {_TITLES}, {_PICKED} SELECT concat('p7u:', volume_id) AS case_id, concat('What does the series record about ', title, '?') AS question_en, concat('關於「', title, '」記載了什麼？') AS question_zh, '' AS gold, 'unpublished' AS kind, '' AS true_date FROM manifest WHERE status <> 'published' UNION ALL SELECT concat('p7f:', document), concat('The document ''', head, ''' is dated ', y, '. What does it say?'), concat('文件「', head, '」的日期是 ', y, '，它說了什麼？'), document, 'false_premise', date_from FROM (SELECT *, concat(CAST(CAST(substring(date_from, 1, 4) AS BIGINT) + 7 AS STRING), substring(date_from, 5)) AS y FROM x)")
def _(s, d):
    return _flat(probes.abstaining(docs(s, d), manifest(s, d)))


@query("n16_probe_p9", D + """, k AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY date_from, document) AS k, count(*) OVER (PARTITION BY volume_id) AS n FROM docs WHERE date_from <> ''),
e AS (SELECT volume_id, max(CASE WHEN k = 3 THEN date_from END) AS first, max(CASE WHEN k = 8 THEN date_from END) AS last FROM k WHERE n >= 12 GROUP BY volume_id)
SELECT concat('p9:', volume_id) AS case_id, concat('List the documents in volume ', volume_id, ' between ', first, ' and ', last, ', in order.') AS question_en, concat('依時間順序列出 ', volume_id, ' 卷中 ', first, ' 到 ', last, ' 之間的文件。') AS question_zh, string_agg(document, '|' ORDER BY document) AS gold, volume_id, first, last FROM k JOIN e USING (volume_id) WHERE date_from BETWEEN first AND last GROUP BY volume_id, first, last""")
def _(s, d):
    return _flat(probes.bounded(docs(s, d)))


@query("n16_probe_p2")
def _(s, d):
    said = F.concat(F.lit("Mr. Adams met President Brown and Secretary Clark; Dr. Davis left. "), "text")
    return _flat(probes.ordered(docs(s, d).withColumn("text", said))).withColumn("actors", F.array_join("actors", "|"))


@query("n15_probe_p1", R + ", x AS (SELECT outcome, run_id % 7 = 0 AS leaked FROM runs), r AS (SELECT count(*) FILTER (WHERE NOT leaked) AS n, count(*) FILTER (WHERE NOT leaked AND outcome <> 'answered') AS a, count(*) FILTER (WHERE NOT leaked AND outcome = 'answered') AS fabrications, count(*) FILTER (WHERE leaked) AS excluded_for_leak FROM x) SELECT round(a / CAST(n AS DOUBLE), 3) AS abstention_rate, fabrications, excluded_for_leak, round(a / CAST(n AS DOUBLE), 3) >= 0.9 AS passed FROM r")
def _(s, d):
    return probes.p1(runs(s, d).select("outcome", (F.col("run_id") % 7 == 0).alias("leaked")))


@query("n15_probe_p2", R + ", x AS (SELECT run_id % 4 AS k FROM runs) SELECT round(avg(CASE WHEN k <> 3 THEN 1.0 ELSE 0.0 END), 3) AS stability, round(avg(CASE WHEN k = 3 THEN CAST(1 AS DOUBLE) / 3 ELSE 1.0 END), 3) AS mean_overlap, round(avg(CASE WHEN k <> 3 THEN 1.0 ELSE 0.0 END), 3) >= 0.8 AS passed FROM x")
def _(s, d):
    k = F.col("run_id") % 4
    forward = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Mr. Adams"), F.lit("Dr. Davis")))
    reverse = F.when(k == 0, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("Mr. Adams"), F.lit("Sir Evans"))).otherwise(F.array(F.lit("Dr. Davis"), F.lit("Mr. Adams")))
    return probes.p2(runs(s, d).select(forward.alias("forward"), reverse.alias("reverse")))


_CASES = f"{D}, {SQL_QUESTIONS}, {SQL_GOLD}, {sql_bm25('bm25', 'text', 20)}, fr AS (SELECT g.query_id, min(rank) AS first FROM gold g LEFT JOIN bm25 b ON b.query_id = g.query_id AND b.id = g.id GROUP BY g.query_id)"


def _ranks(s, d):
    cases = gold(s, d).groupBy(F.col("query_id").alias("case_id")).agg(F.collect_list("id").alias("gold"))
    return probes.first_ranks(cases, body_hits(s, d, 20).select(F.col("query_id").alias("case_id"), F.col("id").alias("document"), "rank"))


@query("n15_probe_p4", _CASES + " SELECT round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 3) AS hit_1, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 3) AS hit_10, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 3) >= 0.8 AS passed FROM fr")
def _(s, d):
    return probes.p4(_ranks(s, d))


@query("n15_probe_p5", _CASES + ", h AS (SELECT CASE WHEN query_id % 2 = 0 THEN 'en' ELSE 'zh-TW' END AS l, CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END AS hit FROM fr), a AS (SELECT coalesce(round(avg(CASE WHEN l = 'en' THEN hit END), 3), 0) AS en, coalesce(round(avg(CASE WHEN l = 'zh-TW' THEN hit END), 3), 0) AS zh FROM h) SELECT en AS hit_10_en, zh AS hit_10_zh, round(100 * (en - zh), 1) AS gap_pp, zh >= 0.5 AS passed FROM a")
def _(s, d):
    return probes.p5(_ranks(s, d).withColumn("language", F.when(F.col("case_id") % 2 == 0, "en").otherwise("zh-TW")))


@query("n15_probe_p6", R + " SELECT round(avg(CASE WHEN run_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 3) AS linked, round(avg(run_id % 3), 3) AS mean_found, round(avg(CASE WHEN run_id % 3 > 0 THEN 1.0 ELSE 0.0 END), 3) AS any_found, round(avg(CASE WHEN run_id % 3 >= 2 THEN 1.0 ELSE 0.0 END), 3) AS both_found, round(avg(CASE WHEN run_id % 5 >= 2 THEN 1.0 ELSE 0.0 END), 3) AS both_cited, round(avg(judge_score), 3) AS correctness, round(avg(CASE WHEN run_id % 3 >= 2 THEN 1.0 ELSE 0.0 END), 3) >= 0.7 AS passed FROM runs")
def _(s, d):
    k = F.col("run_id")
    return probes.p6(runs(s, d).select((k % 3 == 0).alias("linked"), (k % 3).alias("n_found"), (k % 5).alias("n_cited"), F.col("judge_score").alias("score")))


@query("n15_probe_p7", R + ", x AS (SELECT CASE WHEN run_id % 2 = 0 THEN 'unpublished' ELSE 'false_premise' END AS kind, outcome, run_id % 3 < 2 AS put_right FROM runs), y AS (SELECT kind, CASE WHEN CASE WHEN kind = 'unpublished' THEN outcome <> 'answered' ELSE put_right END THEN 1.0 ELSE 0.0 END AS ok FROM x), a AS (SELECT round(avg(CASE WHEN kind = 'unpublished' THEN ok END), 3) AS unpublished, round(avg(CASE WHEN kind = 'false_premise' THEN ok END), 3) AS false_premise FROM y) SELECT *, unpublished >= 0.9 AND false_premise >= 0.5 AS passed FROM a")
def _(s, d):
    k = F.col("run_id")
    answer = F.when(k % 3 == 0, "it was 1962-10-22 in truth").when(k % 3 == 1, "in 1962").otherwise("in 1969")
    return probes.p7(runs(s, d).select(F.when(k % 2 == 0, "unpublished").otherwise("false_premise").alias("kind"), "outcome", answer.alias("answer"), F.lit("1962-10-22").alias("true_date")))


_ROUTED = TEXT_Q["sc9_route"][1]
_ROUTED = _ROUTED[_ROUTED.index("CASE") : _ROUTED.index(" AS route FROM")]


@query("n15_probe_p8", f"""{D}, {SQL_HOPS}, r AS (SELECT query_id, route AS expected, {_ROUTED} AS actual FROM (SELECT *, lower(question) AS q FROM asked)),
p AS (SELECT expected, count(*) AS n, sum(CASE WHEN actual = expected THEN 1 ELSE 0 END) AS hits, count(DISTINCT actual) AS ways FROM r WHERE query_id % 4 > 0 GROUP BY expected),
x AS (SELECT sum(hits) / sum(n) AS a, avg(CASE WHEN ways = 1 THEN 1.0 ELSE 0.0 END) AS c FROM p), h AS (SELECT avg(CASE WHEN actual = expected THEN 1.0 ELSE 0.0 END) AS h FROM r WHERE query_id % 4 = 0)
SELECT CAST(round(a, 3) AS DOUBLE) AS accuracy, CAST(round(c, 3) AS DOUBLE) AS consistency, CAST(round(h, 3) AS DOUBLE) AS held_out, coalesce(a >= 0.8 AND c = 1 AND h >= 0.8, false) AS passed FROM x CROSS JOIN h""")
def _(s, d):
    """Questions of every route from the tables; every fourth is held out."""
    rows = route_questions(s, d).select("query_id", F.col("route").alias("expected_route"), text.route(F.col("question")).alias("actual_route"))
    return probes.p8(rows.where("query_id % 4 > 0"), rows.where("query_id % 4 = 0"))


@query("n15_probe_p9", D + """, k AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY date_from, document) AS k, count(*) OVER (PARTITION BY volume_id) AS n FROM docs WHERE date_from <> ''),
e AS (SELECT volume_id, max(CASE WHEN k = 3 THEN date_from END) AS first, max(CASE WHEN k = 8 THEN date_from END) AS last FROM k WHERE n >= 12 GROUP BY volume_id),
g AS (SELECT volume_id, first, last, count(*) AS n_gold, count(*) FILTER (WHERE doc_id % 4 > 0) AS n FROM k JOIN e USING (volume_id) WHERE date_from BETWEEN first AND last GROUP BY ALL),
w AS (SELECT volume_id, bool_and(docs.date_from BETWEEN first AND last) AS inside FROM docs JOIN e USING (volume_id) WHERE docs.date_from <> '' AND docs.date_to >= first AND docs.date_from <= last AND doc_id % 4 > 0 GROUP BY volume_id)
SELECT round(avg(n / CAST(n_gold AS DOUBLE)), 3) AS mean_recall, round(avg(CASE WHEN coalesce(inside, true) THEN 1.0 ELSE 0.0 END), 3) AS starts_in_range, avg(CAST(1 AS DOUBLE)) AS chronological, avg(n / CAST(n_gold AS DOUBLE)) >= 0.8 AS passed FROM g LEFT JOIN w USING (volume_id)""")
def _(s, d):
    cases = probes.bounded(docs(s, d))
    rows = docs(s, d).where("date_from <> '' and doc_id % 4 > 0").join(cases.select("case_id", "volume_id", "first", "last"), "volume_id").where("date_to >= first and date_from <= last")
    from pyspark.sql import Window

    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy("date_from", "document")))
    return probes.p9(placed.select("case_id", "document", "date_from", "position"), cases)


@query("n15_probe_p10")
def _(s, d):
    pairs = probes.verification_pairs(docs(s, d).select(F.col("document").alias("id"), "text"))
    judged = pairs.join(docs(s, d).select(F.col("document").alias("id"), "text"), "id").withColumn("rejected", ~F.contains("text", F.col("claim")))
    return probes.p10(judged)


@query("n15_d0_diagnostics", R + " SELECT abstain_reason, citation_valid, count(*) AS n, round(sum(gold_cited), 4) AS cited FROM (SELECT CASE WHEN outcome = 'answered' THEN '' WHEN NOT answerable THEN 'correctly abstained' WHEN coalesce(union_recall, 0) = 0 THEN 'no gold retrieved' WHEN run_id % 3 = 0 THEN 'citation gate' ELSE 'other' END AS abstain_reason, run_id % 3 > 0 AS citation_valid, citation_recall AS gold_cited FROM runs) GROUP BY ALL")
def _(s, d):
    rows = probes.d0(runs(s, d).withColumn("n_citations", F.col("run_id") % 3))
    return rows.groupBy("abstain_reason", "citation_valid").agg(F.count("*").alias("n"), F.round(F.sum("gold_cited"), 4).alias("cited"))


@query("n15_d2_recovered", R + ", f AS (SELECT DISTINCT case_id FROM runs WHERE system = 'B0' AND judge_score < 0.5) SELECT language, count(*) AS n, round(avg(CASE WHEN judge_score >= 0.5 THEN 1.0 ELSE 0.0 END), 3) AS recovered FROM runs WHERE system = 'B3' AND judge_score IS NOT NULL AND case_id IN (SELECT case_id FROM f) GROUP BY language")
def _(s, d):
    r = runs(s, d).withColumnRenamed("judge_score", "score")
    return probes.recovered(r.where("system = 'B3'"), r.where("system = 'B0'"), "language")


@query("n15_d2_gold_evidence", f"{D}, {_TITLES}, {_PICKED} SELECT concat('p4:', document) AS case_id, concat(document, ':0') AS chunk_id, CAST(1 AS BIGINT) AS position FROM x")
def _(s, d):
    whole = docs(s, d).select(F.concat("document", F.lit(":0")).alias("chunk_id"), "volume_id", "document_id", F.lit(0).alias("ordinal"), "text")
    return probes.gold_evidence(probes.precise(docs(s, d)), whole).select("case_id", "chunk_id", "position")


@query("x4_token_chunks")
def _(s, d):
    import public_tokenizers

    return chunks.chunk(docs(s, d), 512, 64, cut=plugs.tokenizer_windows(public_tokenizers.path("byte_bpe_50k.json"))).select("chunk_id", "ordinal", "n_chunks_in_doc", "n_tokens", "text")


@query("x5_structured", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"score\": 1}' WHEN 1 THEN '{\"score\": 2}' END AS answer, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS calls FROM events WHERE event_id % 4 < 3")
def _(s, d):
    def make():
        def model(prompt: str) -> str:
            kind, again = prompt.split()[0], "fit the schema" in prompt
            return {"good": '{"score": 1}', "late": '{"score": 2}' if again else "score 2", "bad": '{"mark": 3}'}[kind]

        return model

    prompt = F.expr("CASE event_id % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'late' ELSE 'bad' END")
    ask = plugs.structured(make, lambda x: None if isinstance(x, dict) and "score" in x else "no score")
    rows = table(s, d, "events").where("event_id % 4 < 3").select("event_id", ask(prompt).alias("a"))
    return rows.select("event_id", "a.answer", "a.calls")


@query("x1_tables")
def _(s, d):
    from corpusloom.plans import inputs

    whole = docs(s, d).select(F.col("doc_id").alias("chunk_id"), "volume_id", "document_id", F.lit(0).alias("ordinal"), "date_from", "date_to", "text")
    tools = plugs.Tables(inputs.index(s, d, "text"), whole, manifest(s, d))
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("1920-01-01").alias("q_from"), F.lit("1960-12-31").alias("q_to"))
    return tools.timeline(asked).select("query_id", "id", "date_from", "position")
