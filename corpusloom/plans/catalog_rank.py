"""Queries on ranking, joins, windows, selection and the citation gate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import cells, cite, filters, postings, retrieval, select
from corpusloom.sources import tables
from corpusloom.plans import agent, dispatch, inputs, probes, runs
from corpusloom.plans.inputs import QUERY_WORDS, SQL_DOCS, SQL_MANIFEST, SQL_TOKENS, docs, manifest, table

Q: dict = {}
D, M = f"WITH {SQL_DOCS}", f"WITH {SQL_DOCS}, {SQL_MANIFEST}"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def questions(s, d):
    words = F.slice(F.split("text", " "), 1, QUERY_WORDS)
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"), "text")


def gold(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    b = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("term"))
    return filters.containing(t, b, "id", "body").select("query_id", "id")


SQL_QUESTIONS = f"questions AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(text, ' '), 1, {QUERY_WORDS}), ' ') AS query, text FROM benchmark)"
SQL_GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def sql_bm25(name: str, field: str, limit: int, where: str = "true") -> str:
    tokens, asked = SQL_TOKENS.format(field), SQL_TOKENS.format("translate(query, '+-!(){}[]^\"~*?:\\/', repeat(' ', 18))").replace("{{", "{")
    return f"""{name}_t AS (SELECT doc_id AS id, unnest({tokens}) AS term FROM docs), {name}_p AS (SELECT id, term, count(*) AS tf FROM {name}_t GROUP BY id, term),
{name}_l AS (SELECT doc_id AS id, len({tokens}) AS dl FROM docs), {name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_l), {name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_q AS (SELECT DISTINCT query_id, unnest({asked}) AS term FROM questions),
{name}_x AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM {name}_q JOIN {name}_f USING (term) JOIN {name}_p USING (term) JOIN {name}_l USING (id) CROSS JOIN {name}_s WHERE {where} GROUP BY query_id, id),
{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_x QUALIFY rank <= {limit})"""


def body_hits(s, d, limit=50, allowed=None):
    return retrieval.bm25(questions(s, d), inputs.index(s, d, "text"), limit, allowed)


def head_hits(s, d, limit=50):
    return retrieval.bm25(questions(s, d), inputs.index(s, d, "head"), limit)


def vector_questions(s, d):
    return table(s, d, "embeddings").where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("query_id"), F.col("embedding").alias("q_vector"))


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def dense_hits(s, d, limit=50):
    return retrieval.dense(vector_questions(s, d), vectors(s, d), limit)


_COS = "round(list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_inner_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[])))), 6)"
SQL_DENSE = f"dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT CAST(q.vec_id / 100 AS BIGINT) AS query_id, v.vec_id AS id, {_COS.format('q.embedding', 'v.embedding')} AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 100 = 0) QUALIFY rank <= 50)"
B50, H50 = sql_bm25("bm25", "text", 50), sql_bm25("headhits", "head", 50)
SQL_FUSED = """arms AS (SELECT query_id, id, rank, 'bm25' AS arm, 0 AS place, 1.0 AS w FROM bm25 UNION ALL SELECT query_id, id, rank, 'head', 1, 1.0 FROM headhits UNION ALL SELECT query_id, id, rank, 'dense', 2, 0.5 FROM dense),
fx AS (SELECT query_id, id, sum(w / (60 + rank)) AS exact, min(place * 1000 + rank) AS first, max(CASE WHEN arm = 'bm25' THEN rank END) AS rank_bm25, max(CASE WHEN arm = 'head' THEN rank END) AS rank_head, max(CASE WHEN arm = 'dense' THEN rank END) AS rank_dense FROM arms GROUP BY query_id, id),
fused AS (SELECT query_id, id, round(exact, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(exact, 9) DESC, first, id) AS rank, rank_bm25, rank_head, rank_dense FROM fx QUALIFY rank <= {k})"""
ALL_ARMS = f"{D}, {SQL_QUESTIONS}, {B50}, {H50}, {SQL_DENSE}, "


def fused_hits(s, d, k=50):
    return retrieval.fuse({"bm25": body_hits(s, d), "head": head_hits(s, d), "dense": dense_hits(s, d)}, k)


@query("r2_bm25", f"{D}, {SQL_QUESTIONS}, {SQL_GOLD}, {sql_bm25('bm25', 'text', 10)} SELECT bm25.query_id, bm25.id, score, rank, gold.id IS NOT NULL AS is_gold FROM bm25 LEFT JOIN gold ON gold.query_id = bm25.query_id AND gold.id = bm25.id")
def _(s, d):
    g = gold(s, d).withColumn("g", F.lit(True))
    return body_hits(s, d, 10).join(g, ["query_id", "id"], "left").select("query_id", "id", "score", "rank", F.coalesce("g", F.lit(False)).alias("is_gold"))


_TOK = SQL_TOKENS.format("text")


@query("r1_index", f"{D}, t AS (SELECT doc_id AS id, unnest({_TOK}) AS term FROM docs), p AS (SELECT term, id, count(*) AS tf FROM t GROUP BY term, id) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY term")
def _(s, d):
    return postings.read_vocabulary(inputs.index(s, d, "text"))


@query("r3_head_search", f"{D}, {SQL_QUESTIONS}, {H50} SELECT * FROM headhits")
def _(s, d):
    return head_hits(s, d)


@query("f8_q10_prefilter", f"{D}, {SQL_QUESTIONS}, {sql_bm25('bm25', 'text', 10, 'id IN (SELECT doc_id FROM docs WHERE subtype = $$editorial-note$$)')} SELECT * FROM bm25")
def _(s, d):
    some = filters.apply(docs(s, d), filters.Filters(subtypes=("editorial-note",))).select(F.col("doc_id").alias("id"))
    return body_hits(s, d, 10, some)


@query("r6_dense_exact", f"WITH {SQL_DENSE} SELECT * FROM dense")
def _(s, d):
    return dense_hits(s, d)


PROBED = 0.75  # of the cells; tests measure the recall at it


@query("r5_r6_dense_ann")
def _(s, d):
    index = inputs.vector_cells(s, d)
    return cells.search(vector_questions(s, d), index, max(1, int(len(index.centroids) * PROBED)), 10)


@query("r7_jna_fuse", ALL_ARMS + SQL_FUSED.format(k=50) + " SELECT query_id, id, score, rank, CAST(rank_bm25 AS DOUBLE) AS rank_bm25, CAST(rank_head AS DOUBLE) AS rank_head, CAST(rank_dense AS DOUBLE) AS rank_dense FROM fused")
def _(s, d):
    return fused_hits(s, d).withColumns({f"rank_{a}": F.col(f"rank_{a}").cast("double") for a in retrieval.ARMS})


_QT, _PT = "list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+'))", "list_distinct(regexp_extract_all(lower(substring(docs.text, 1, 1800)), '[\\p{L}\\p{N}]+'))"
SQL_RERANKED = f"""rr AS (SELECT f.*, round(8.0 * len(list_intersect({_QT}, {_PT})) / greatest(len({_QT}), 1) - 4.0, 6) AS s, count(*) OVER (PARTITION BY f.query_id) AS n FROM fused f JOIN questions USING (query_id) JOIN docs ON docs.doc_id = f.id),
reranked AS (SELECT query_id, id, score, rank, rank_bm25, rank_head, rank_dense, CASE WHEN n > 20 THEN s END AS rerank_score, CASE WHEN n > 20 THEN k END AS rank_rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 20 THEN s END DESC NULLS LAST, rank) AS k FROM rr) WHERE k <= 20)"""


def reranked_hits(s, d):
    return retrieval.rerank(fused_hits(s, d), docs(s, d).select(F.col("doc_id").alias("id"), "text"), questions(s, d), 20)


@query("r8_r10_jnb_hybrid", ALL_ARMS + SQL_FUSED.format(k=50) + ", " + SQL_RERANKED + " SELECT query_id, id, score, rank, rerank_score, CAST(rank_rerank AS DOUBLE) AS rank_rerank FROM reranked")
def _(s, d):
    return reranked_hits(s, d).select("query_id", "id", "score", "rank", "rerank_score", F.col("rank_rerank").cast("double").alias("rank_rerank"))


@query("r8_rerank_without_model", ALL_ARMS + SQL_FUSED.format(k=50) + " SELECT query_id, id, rank, CAST(NULL AS DOUBLE) AS rerank_score FROM fused WHERE rank <= 20")
def _(s, d):
    return retrieval.rerank(fused_hits(s, d), docs(s, d).select(F.col("doc_id").alias("id"), "text"), questions(s, d), 20, scorer=None).select("query_id", "id", "rank", "rerank_score")


@query("r9_score_pairs", f"{D}, {SQL_QUESTIONS}, {sql_bm25('bm25', 'text', 5)} SELECT query_id, id, round(8.0 * len(list_intersect({_QT}, {_PT.replace('substring(docs.text, 1, 1800)', 'docs.text')})) / greatest(len({_QT}), 1) - 4.0, 6) AS pair_score FROM bm25 JOIN questions USING (query_id) JOIN docs ON docs.doc_id = bm25.id")
def _(s, d):
    rows = body_hits(s, d, 5).join(questions(s, d).select("query_id", "query"), "query_id").join(docs(s, d).select(F.col("doc_id").alias("id"), "text"), "id")
    return rows.select("query_id", "id", retrieval.coverage(F.col("query"), F.col("text")).alias("pair_score"))


def merged_hits(s, d):
    one = body_hits(s, d, 12).withColumns({"hop": F.lit("h0"), "seen": F.lit(0)})
    two = head_hits(s, d, 12).withColumns({"hop": F.lit("h1"), "seen": F.lit(1)})
    return select.merge_hops(one.unionByName(two).drop("rank"))


SQL_MERGED = """mu AS (SELECT query_id, id, score, 'h0' AS hop, 0 AS seen FROM bm25 WHERE rank <= 12 UNION ALL SELECT query_id, id, score, 'h1', 1 FROM headhits WHERE rank <= 12),
mo AS (SELECT query_id, id, max(score) AS score, arg_min(hop, seen) AS hop FROM mu GROUP BY query_id, id),
mt AS (SELECT *, row_number() OVER (PARTITION BY query_id, hop ORDER BY score DESC, id) AS turn, max(score) OVER (PARTITION BY query_id, hop) AS best FROM mo),
merged AS (SELECT query_id, id, hop, score, row_number() OVER (PARTITION BY query_id ORDER BY turn, best DESC, hop) AS position FROM mt)"""
TWO_ARMS = f"{D}, {SQL_QUESTIONS}, {B50}, {H50}, {SQL_MERGED}"


@query("w2_u1_merge_hops", TWO_ARMS + " SELECT * FROM merged")
def _(s, d):
    return merged_hits(s, d)


@query("r11_rerank_union", TWO_ARMS + f""", rr AS (SELECT m.query_id, m.id, m.position, round(8.0 * len(list_intersect({_QT}, {_PT})) / greatest(len({_QT}), 1) - 4.0, 6) AS s, count(*) OVER (PARTITION BY m.query_id) AS n FROM merged m JOIN questions USING (query_id) JOIN docs ON docs.doc_id = m.id)
SELECT query_id, id, CASE WHEN n > 10 THEN s END AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 10 THEN s END DESC NULLS LAST, position) AS k FROM rr) WHERE k <= 10""")
def _(s, d):
    hits = merged_hits(s, d).withColumnRenamed("position", "rank")
    return retrieval.rerank(hits, docs(s, d).select(F.col("doc_id").alias("id"), "text"), questions(s, d), 10).select("query_id", "id", "rerank_score")


@query("r12_t2_timeline", f"{D}, {SQL_QUESTIONS}, {sql_bm25('bm25', 'text', 20)} SELECT query_id, id, date_from, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(nullif(date_from, ''), '9999'), id) AS position FROM bm25 JOIN docs ON doc_id = id")
def _(s, d):
    return retrieval.timeline(body_hits(s, d, 20).join(docs(s, d).select(F.col("doc_id").alias("id"), "date_from"), "id")).select("query_id", "id", "date_from", "position")


@query("r15_mode", f"{D}, v AS (SELECT doc_id, embedding FROM docs LEFT JOIN embeddings ON vec_id = doc_id) SELECT count(*) AS rows, count(embedding) AS embedded, CASE WHEN count(*) = 0 THEN 'unavailable' WHEN count(embedding) = 0 THEN 'bm25-only' WHEN count(embedding) = count(*) THEN 'hybrid' ELSE 'partial' END || '+rerank' AS mode FROM v")
def _(s, d):
    return retrieval.mode(docs(s, d).select("doc_id").join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left"), reranks=True)


def _chunks(s, d):
    from corpusloom.plans.catalog_text import chunk_table

    return chunk_table(s, d)


from corpusloom.plans.catalog_text import SQL_CHUNKS  # noqa: E402


@query("r13_lookup", f"{D}, {SQL_CHUNKS} SELECT chunk_id, text FROM chunks WHERE volume_id = 'src19' AND document_id = 'd499'")
def _(s, d):
    return retrieval.lookup(_chunks(s, d), "src19", "d499").select("chunk_id", "text")


@query("r14_excerpt", f"{D}, {SQL_CHUNKS}, e AS (SELECT volume_id, document_id, arg_min(head, ordinal) AS head, string_agg(text, ' ' ORDER BY ordinal) AS body FROM chunks GROUP BY volume_id, document_id) SELECT volume_id, document_id, concat(volume_id, ':', document_id, '\n', head, '\n', CASE WHEN length(body) > 60000 THEN concat(substring(body, 1, 60000), ' [TRUNCATED]') ELSE body END) AS excerpt FROM e")
def _(s, d):
    return retrieval.excerpt(_chunks(s, d))


# selection

_SEL = TWO_ARMS + ", sc AS (SELECT query_id, hop, id, position, CASE WHEN id % 9 = 0 THEN NULL ELSE score END AS score FROM merged)"


def _scored(s, d):
    return merged_hits(s, d).withColumn("score", F.when(F.col("id") % 9 != 0, F.col("score")))


@query("w3_select_evidence", _SEL + """, judged AS (SELECT *, greatest(3.0, max(score) OVER (PARTITION BY query_id) - 4.3) AS floor, row_number() OVER (PARTITION BY query_id, hop ORDER BY score DESC, position) AS k FROM sc WHERE score IS NOT NULL)
SELECT query_id, hop, id, position, score, (score >= floor OR k <= 3) AND k <= 8 AS kept FROM judged UNION ALL SELECT query_id, hop, id, position, score, true FROM sc WHERE score IS NULL""")
def _(s, d):
    return select.select_evidence(_scored(s, d), 3.0, max_per_hop=8).select("query_id", "hop", "id", "position", "score", "kept")


@query("w3_unscored_all_kept", _SEL + " SELECT query_id, hop, id, true AS kept FROM sc")
def _(s, d):
    return select.select_evidence(_scored(s, d), None, None).select("query_id", "hop", "id", "kept")


@query("w4_missing_hops", _SEL + ", h AS (SELECT query_id, 'h0' AS hop FROM questions UNION ALL SELECT query_id, 'h1' FROM questions UNION ALL SELECT query_id, 'h2' FROM questions), b AS (SELECT query_id, hop, max(score) AS best FROM sc GROUP BY query_id, hop) SELECT h.query_id, h.hop FROM h LEFT JOIN b ON b.query_id = h.query_id AND b.hop = h.hop WHERE best IS NULL OR best < 9")
def _(s, d):
    hops = questions(s, d).select("query_id", F.explode(F.array(F.lit("h0"), F.lit("h1"), F.lit("h2"))).alias("hop"))
    return select.missing_hops(_scored(s, d), hops, 9.0)


@query("w5_score_rows", f"{TWO_ARMS}, {SQL_GOLD} SELECT m.query_id, m.id AS document, row_number() OVER (PARTITION BY m.query_id ORDER BY position) - 1 AS at, CASE WHEN hop = 'h0' THEN 'h0' ELSE 'main' END AS hop, g.id IS NOT NULL AS is_gold, score FROM merged m LEFT JOIN gold g ON g.query_id = m.query_id AND g.id = m.id")
def _(s, d):
    rows = merged_hits(s, d).withColumn("document", F.col("id")).withColumn("hop", F.when(F.col("hop") == "h0", "h0"))
    return select.score_rows(rows, gold(s, d).withColumnRenamed("id", "document"))


@query("w6_synthesis_window", TWO_ARMS + """, d0 AS (SELECT query_id, id, score, concat('g', CAST(id % 7 AS STRING)) AS document FROM merged),
d1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY score DESC, id) AS k FROM d0), d2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, k = 1 ORDER BY score DESC, id) AS r FROM d1)
SELECT query_id, id, document, row_number() OVER (PARTITION BY query_id ORDER BY (k = 1 AND r <= 5) DESC, score DESC, id) AS position FROM d2 QUALIFY position <= 9""")
def _(s, d):
    rows = merged_hits(s, d).withColumn("document", F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    return select.synthesis_window(rows, 5, 9).select("query_id", "id", "document", "position")


@query("w7_focus", """WITH st AS (SELECT source AS query_id, doc_id AS passage, string_split(text, '. ') AS a FROM documents), su AS (SELECT query_id, passage, unnest(a) AS t, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS idx FROM st),
ss AS (SELECT *, length(t) AS n_chars, (length(t) * 7 + idx * 3) % 23 AS score, sum(length(t)) OVER (PARTITION BY query_id, passage) >= 400 AND count(*) OVER (PARTITION BY query_id, passage) > 4 AS lng FROM su),
sr AS (SELECT *, sum(CASE WHEN lng THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY passage RANGE UNBOUNDED PRECEDING) AS running, row_number() OVER (PARTITION BY query_id, passage ORDER BY score DESC, idx) <= 4 AS top FROM ss)
SELECT query_id, passage, idx, NOT (lng AND running <= 400) OR max(CAST(top AS INTEGER)) OVER (PARTITION BY query_id, passage ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS kept FROM sr""")
def _(s, d):
    t = table(s, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("passage"), F.posexplode(F.split("text", "\\. ")).alias("idx", "t"))
    t = t.withColumn("n_chars", F.length("t")).withColumn("score", (F.col("n_chars") * 7 + F.col("idx") * 3) % 23)
    return select.focus(t).select("query_id", "passage", "idx", "kept")


SQL_CLAIMS = "claims AS (SELECT conv_id % 40 AS query_id, conv_id * 100 + turn AS claim, text FROM conversations WHERE role = 'assistant')"


def claims(s, d):
    return table(s, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") % 40).alias("query_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("claim"), "text")


_PAIR_SCORE = "CAST((claim * 31 + id * 17) % 60 AS DOUBLE) / 10.0E0"


@query("c5_w8_jnk_attribute", f"{D}, {SQL_QUESTIONS}, {SQL_CLAIMS}, {sql_bm25('bm25', 'text', 10)}, p AS (SELECT c.query_id, claim, id, {_PAIR_SCORE} AS score FROM claims c JOIN bm25 USING (query_id)), r AS (SELECT *, row_number() OVER w AS rank, max(score) OVER (PARTITION BY query_id, claim) AS best FROM p WINDOW w AS (PARTITION BY query_id, claim ORDER BY score DESC, id)) SELECT query_id, claim, id, score, rank FROM r WHERE rank <= 3 AND score >= best - 2.0")
def _(s, d):
    pairs = select.claim_pairs(claims(s, d).drop("text"), body_hits(s, d, 10).select("query_id", "id")).withColumn("score", F.expr(_PAIR_SCORE))
    return select.attribute(pairs)


# the gate

_CITED = "concat(volume_id, ':', document_id, ':', CAST(id % 3 AS STRING))"
SQL_GATE = f"""{M}, {SQL_QUESTIONS}, {SQL_CLAIMS}, {sql_bm25('bm25', 'text', 10)}, ev AS (SELECT query_id, {_CITED} AS cid, volume_id, subtype, rank, id AS doc FROM bm25 JOIN docs ON doc_id = id),
ci AS (SELECT c.query_id, c.claim, CASE WHEN (c.claim + e.rank) % 7 = 0 THEN 'bad id' WHEN (c.claim + e.rank) % 5 = 0 THEN concat('x:', e.cid) WHEN (c.claim + e.rank) % 4 = 0 THEN 'src99:d1:0' ELSE e.cid END AS id FROM claims c JOIN ev e ON e.query_id = c.query_id AND e.rank <= 4 AND c.claim % 9 <> 0),
ck AS (SELECT ci.query_id, claim, ci.id, CASE WHEN NOT regexp_matches(ci.id, '^[A-Za-z0-9\\-.]+:[A-Za-z0-9_\\-.]+:\\d+$') THEN 'malformed' WHEN ev.cid IS NULL THEN 'not retrieved' WHEN ev.rank > 3 THEN 'not accepted' WHEN m.status IS NULL OR m.status <> 'published' THEN 'not published' WHEN subtype <> 'historical-document' THEN 'not citable' END AS refusal
FROM ci LEFT JOIN ev ON ev.query_id = ci.query_id AND ev.cid = ci.id LEFT JOIN manifest m ON m.volume_id = ev.volume_id)"""


def gate_inputs(s, d, *more):
    """Claims, evidence (with more columns of its documents, if any) and what the gate says of each id. The evidence is written: few rows, and known to
    be, so the claims don't move to meet them."""
    ev = body_hits(s, d, 10).join(docs(s, d).select(F.col("doc_id").alias("id"), "volume_id", "document_id", "subtype", *more), "id")
    ev = tables.kept(ev.select("query_id", F.expr(_CITED).alias("cid"), "volume_id", "document_id", "subtype", *more, "rank"), "evidence")
    k = F.col("claim") + F.col("rank")
    ids = F.when(k % 7 == 0, "bad id").when(k % 5 == 0, F.concat(F.lit("x:"), "cid")).when(k % 4 == 0, "src99:d1:0").otherwise(F.col("cid"))
    some = claims(s, d).join(ev.where("rank <= 4"), "query_id").where("claim % 9 <> 0").groupBy("query_id", "claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", ids.alias("i")))), lambda x: x["i"]).alias("ids"))
    c = claims(s, d).join(some, ["query_id", "claim"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    ev = ev.withColumnRenamed("cid", "id")
    return c, ev, cite.cited(c, ev, ev.where("rank <= 3").select("query_id", "id"), manifest(s, d))


@query("jnj_n8_cited", SQL_GATE + " SELECT * FROM ck")
def _(s, d):
    return gate_inputs(s, d)[2]


@query("n7_n8_gate", SQL_GATE + """, g AS (SELECT query_id, claim, count(*) FILTER (WHERE refusal IS NULL) AS good FROM ck GROUP BY query_id, claim), p AS (SELECT c.query_id, count(*) AS n_claims, count(*) FILTER (WHERE coalesce(good, 0) = 0) AS n_uncited, count(*) FILTER (WHERE regexp_matches(text, 'https?://')) AS n_urls FROM claims c LEFT JOIN g ON g.query_id = c.query_id AND g.claim = c.claim GROUP BY c.query_id)
SELECT q.query_id, coalesce(n_claims, 0) AS n_claims, coalesce(n_uncited, 0) AS n_uncited, coalesce(n_urls, 0) AS n_urls, CASE WHEN coalesce(n_claims, 0) = 0 THEN 'no claims' WHEN n_uncited = n_claims THEN 'nothing cited' WHEN n_urls > 0 THEN 'written url' END AS blocked FROM questions q LEFT JOIN p USING (query_id)""")
def _(s, d):
    c, _, checked = gate_inputs(s, d)
    return cite.gate(questions(s, d), c, checked)


@query("n9_repair", SQL_GATE + " SELECT query_id, claim, string_agg(DISTINCT id, '|' ORDER BY id) AS ids FROM ck c WHERE NOT EXISTS (SELECT 1 FROM ck x WHERE x.query_id = c.query_id AND x.claim = c.claim AND x.id = c.id AND x.refusal IS NOT NULL) GROUP BY query_id, claim")
def _(s, d):
    c, _, checked = gate_inputs(s, d)
    return cite.drop_uncited(cite.repair(c, checked)).select("query_id", "claim", F.array_join(F.array_sort(F.array_distinct("ids")), "|").alias("ids"))


@query("n10_verified", f"WITH {SQL_CLAIMS} SELECT query_id, claim FROM claims WHERE claim % 4 <> 1")
def _(s, d):
    v = claims(s, d).where("claim % 2 = 1").select("query_id", "claim", (F.col("claim") % 4 == 3).alias("supported"))
    return cite.verified(claims(s, d), v).select("query_id", "claim")


@query("w9_citation_lines", SQL_GATE + """, o AS (SELECT ev.query_id, ev.cid, ev.volume_id, docs.document_id, docs.head FROM ev JOIN docs ON docs.doc_id = ev.doc QUALIFY row_number() OVER (PARTITION BY ev.query_id, ev.volume_id, docs.document_id ORDER BY ev.cid) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY volume_id, document_id) AS number FROM o) SELECT query_id, number, concat('[', CAST(number AS STRING), '] ', head, ' (', volume_id, ', ', document_id, ') ', 'https://example.org/', volume_id, '/', document_id) AS line FROM n""")
def _(s, d):
    return cite.citation_lines(gate_inputs(s, d, "head")[1], "https://example.org").select("query_id", "number", "line")


@query("n11_n14_answers", SQL_GATE + """, g AS (SELECT query_id, claim, count(*) FILTER (WHERE refusal IS NULL) AS good FROM ck GROUP BY query_id, claim), p AS (SELECT c.query_id, count(*) AS n_claims, count(*) FILTER (WHERE coalesce(good, 0) = 0) AS n_uncited, count(*) FILTER (WHERE regexp_matches(text, 'https?://')) AS n_urls FROM claims c LEFT JOIN g ON g.query_id = c.query_id AND g.claim = c.claim GROUP BY c.query_id),
b AS (SELECT q.query_id, CASE WHEN coalesce(n_claims, 0) = 0 THEN 'no claims' WHEN n_uncited = n_claims THEN 'nothing cited' WHEN n_urls > 0 THEN 'written url' END AS blocked FROM questions q LEFT JOIN p USING (query_id)), e AS (SELECT query_id, count(DISTINCT cid) AS n FROM ev GROUP BY query_id)
SELECT b.query_id, CASE WHEN blocked IS NULL THEN 'answered' ELSE 'abstained' END AS outcome, coalesce(n, 0) AS n_retrieved, blocked AS reason FROM b LEFT JOIN e USING (query_id)""")
def _(s, d):
    c, ev, checked = gate_inputs(s, d)
    return cite.answers(questions(s, d), c, ev, cite.gate(questions(s, d), c, checked)).select("query_id", "outcome", "n_retrieved", "reason")


# sets

SQL_REJECTED = TWO_ARMS + ", hh AS (SELECT DISTINCT query_id, hop FROM merged), rj AS (SELECT query_id, id, hop FROM merged WHERE id % 4 = 0 UNION ALL SELECT m.query_id, m.id, h.hop FROM merged m JOIN hh h ON h.query_id = m.query_id AND h.hop <> m.hop WHERE m.id % 8 = 0), nh AS (SELECT query_id, count(*) AS n_hops FROM hh GROUP BY query_id), ra AS (SELECT query_id, id, count(DISTINCT hop) = max(n_hops) AS by_all FROM rj JOIN nh USING (query_id) GROUP BY query_id, id)"


def _rejected(s, d):
    m = tables.kept(merged_hits(s, d), "merged")  # four steps use it
    hops = m.select("query_id", "hop").distinct()
    own = m.where("id % 4 = 0").select("query_id", "id", "hop")
    other = m.where("id % 8 = 0").select("query_id", "id", F.col("hop").alias("o")).join(hops, "query_id").where("hop <> o").select("query_id", "id", "hop")
    return m, hops, own.unionByName(other)


@query("u3_rejected_by_all", SQL_REJECTED + " SELECT * FROM ra")
def _(s, d):
    _, hops, r = _rejected(s, d)
    return select.rejected_by_all(r, hops)


@query("u4_surviving", SQL_REJECTED + " SELECT query_id, id FROM merged m WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.query_id = m.query_id AND ra.id = m.id AND by_all)")
def _(s, d):
    m, hops, r = _rejected(s, d)
    return select.surviving(m, r, hops).select("query_id", "id")


@query("u2_documents", TWO_ARMS + " SELECT DISTINCT query_id, id % 50 AS document FROM merged")
def _(s, d):
    return select.documents_of(merged_hits(s, d).withColumn("document", F.col("id") % 50))


@query("u5_jaccard", f"{D}, {SQL_QUESTIONS}, {B50}, {H50}, a AS (SELECT query_id, list(id) AS x FROM bm25 GROUP BY query_id), b AS (SELECT query_id, list(id) AS y FROM headhits GROUP BY query_id) SELECT query_id, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS jaccard FROM a JOIN b USING (query_id)")
def _(s, d):
    ids = lambda h, n: h.groupBy("query_id").agg(F.collect_list("id").alias(n))
    return ids(body_hits(s, d), "x").join(ids(head_hits(s, d), "y"), "query_id").select("query_id", F.round(select.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


# the loop

_ASKED = "CASE item_id % 4 WHEN 0 THEN concat('Compare ', substring(text, 1, 30)) WHEN 1 THEN concat('Give a timeline of ', substring(text, 1, 30)) WHEN 2 THEN concat('Show document ', CAST(item_id AS STRING)) ELSE substring(text, 1, 30) END"


@query("n1_n2_plan_hops", f"SELECT item_id AS query_id, 'h0' AS hop, CASE item_id % 4 WHEN 0 THEN 'complex' WHEN 1 THEN 'timeline' WHEN 2 THEN 'lookup' ELSE 'simple' END AS route FROM benchmark WHERE item_id % 3 <> 0 UNION ALL SELECT item_id, concat('h', CAST(k AS STRING)), 'simple' FROM benchmark, (SELECT unnest([0, 1, 2]) AS k) WHERE item_id % 3 = 0")
def _(s, d):
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_ASKED).alias("question"))
    planned = asked.where("query_id % 3 = 0").select("query_id", F.explode(F.sequence(F.lit(10), F.lit(14))).alias("place"), F.col("question").alias("query"), F.lit("simple").alias("route"))
    return agent.plan_hops(asked, planned).select("query_id", "hop", "route")


@query("n5_rewrite", f"WITH q AS (SELECT item_id AS query_id, {_ASKED} AS question FROM benchmark WHERE item_id % 2 = 0) SELECT query_id, 'fix0' AS hop, CASE WHEN query_id % 4 = 0 THEN question ELSE 'more' END AS query FROM q")
def _(s, d):
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr(_ASKED).alias("question"))
    hops = agent.plan_hops(asked)
    missing = hops.where("query_id % 2 = 0").select("query_id", "hop", F.when(F.col("query_id") % 4 == 0, "").otherwise("more").alias("missing"))
    return agent.rewrite(missing, hops, 0).select("query_id", "hop", "query")


@query("n4_n12_next_step", "SELECT event_id, CASE WHEN event_id % 3 > 0 AND NOT (event_id % 4 >= 2 OR event_id % 2 >= 1 OR event_id % 5 >= 3) THEN 'rewrite_missing' WHEN event_id % 7 > 0 THEN 'synthesize' ELSE 'abstain' END AS step FROM events")
def _(s, d):
    k = F.col("event_id")
    st = table(s, d, "events").select("event_id", (k % 3).alias("n_missing"), (k % 7).alias("n_accepted"), (k % 4).alias("rounds"), (k % 2).alias("corrections"), (k % 5).alias("calls"))
    return agent.next_step(st, agent.SYSTEMS["B2"]).select("event_id", "step")


def _loop(s, d, system, floor=None, grade=None):
    """Questions of which every third has a plan of two hops; answers quote the best passage."""
    asked = questions(s, d).select("query_id", F.col("query").alias("question"))
    words = F.split("question", " ")
    planned = asked.where("query_id % 3 = 0").select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"), words.alias("w"))
    planned = planned.select("query_id", "place", F.array_join(F.slice("w", 1 + 4 * F.col("place"), F.lit(4)), " ").alias("query"), F.lit("complex").alias("route"))
    index, body = inputs.index(s, d, "text"), docs(s, d)

    def retrieve(hops):
        hits = retrieval.bm25(hops.select(F.concat_ws("|", "query_id", "hop").alias("query_id"), "query"), index, 10)
        hits = hits.withColumn("hop", F.substring_index("query_id", "|", -1)).withColumn("query_id", F.substring_index("query_id", "|", 1).cast("long"))
        return hits.join(body.select(F.col("doc_id").alias("id"), "volume_id", "subtype", "text", "document"), "id").select("query_id", "hop", F.concat("document", F.lit(":0")).alias("id"), "score", "volume_id", "subtype", "text")

    def generate(accepted):
        best = accepted.groupBy("query_id").agg(F.max_by(F.struct("id", "text"), F.struct("score", "id")).alias("b"))
        return best.select("query_id", F.lit(0).alias("claim"), F.substring("b.text", 1, 80).alias("text"), F.array("b.id").alias("ids"))

    return agent.answer(asked, retrieve, generate, manifest(s, d), agent.SYSTEMS[system], floor, planned, grade).select("query_id", "outcome", "n_retrieved", "reason")


def _add_loop(name, system, floor=None, grade=None):
    Q[name] = (lambda s, d: _loop(s, d, system, floor, grade), None)


def _by_rank(evidence, hops):
    """A stand-in for a grading model: every hop rejects what stands after the third place, and the first hop of even questions lacks something."""
    late = evidence.where("position > 3").groupBy("query_id").agg(F.collect_list("id").alias("late"))
    verdict = F.when((F.col("hop") == "h0") & (F.col("query_id") % 2 == 0), "missing").otherwise("supported")
    return hops.join(late, "query_id", "left").select("query_id", "hop", verdict.alias("verdict"), F.lit("").alias("corrective"), F.coalesce("late", F.array().cast("array<string>")).alias("rejected"))


for _name, _system, _floor, _grade in (("n3_n6_n13_answer_loop", "B3", 12.0, None), ("n13_b0", "B0", None, None), ("n13_b1", "B1", None, None), ("n13_b2_corrections", "B2", 12.0, None), ("n13_b0_2step", "B0-2step", None, None), ("n4_graded_by_model", "B3", None, _by_rank)):
    _add_loop(_name, _system, _floor, _grade)


# the loop with tools by route

_FIRST = "array_to_string(list_slice(string_split(b.text, ' '), {}, {}), ' ')"
_BY_ROUTE = f"""CASE item_id % 5 WHEN 0 THEN concat('Show ', volume_id, ' document ', CAST(doc_id AS STRING)) WHEN 1 THEN concat('Timeline of ', {_FIRST.format(1, 6)})
WHEN 2 THEN concat('Is ', volume_id, ' published') ELSE {_FIRST.format(1, 8)} END"""
_ROUTES = "CASE item_id % 5 WHEN 0 THEN 'lookup' WHEN 1 THEN 'timeline' WHEN 2 THEN 'status' WHEN 3 THEN 'simple' ELSE 'complex' END"
SQL_HOPS = f"""asked AS (SELECT item_id AS query_id, {_BY_ROUTE} AS question, {_ROUTES} AS route, b.text AS t FROM benchmark b JOIN docs ON doc_id = item_id),
hops AS (SELECT query_id, 'h0' AS hop, question AS query, route FROM asked WHERE route <> 'complex' UNION ALL
SELECT query_id, concat('h', CAST(k AS STRING)), array_to_string(list_slice(string_split(question, ' '), 1 + 4 * k, 4 + 4 * k), ' '), route FROM asked, (SELECT unnest([0, 1]) AS k) WHERE route = 'complex')"""
_CITABLE = "id IN (SELECT doc_id FROM docs WHERE subtype = 'historical-document')"
SQL_DISPATCHED = f"""questions AS (SELECT concat(CAST(query_id AS STRING), '|', hop) AS query_id, query FROM hops WHERE route IN ('simple', 'complex')), {sql_bm25('wide', 'text', 50, _CITABLE)}"""
SQL_TIMELINE = SQL_DISPATCHED.replace("'simple', 'complex'", "'timeline'").replace("wide", "narrow").replace("questions", "dated").replace(_CITABLE, _CITABLE + " AND id IN (SELECT doc_id FROM docs WHERE date_to >= '1920-01-01' AND date_from <= '1960-12-31')")
SQL_TOOLS = f"""{SQL_HOPS}, {SQL_DISPATCHED}, {SQL_TIMELINE},
tools AS (SELECT h.query_id, h.hop, 'lookup_document' AS tool, false AS relaxed, docs.doc_id AS id, CAST(1 AS BIGINT) AS rank, CAST(NULL AS DOUBLE) AS score FROM hops h JOIN docs ON h.query = concat('Show ', volume_id, ' document ', CAST(doc_id AS STRING)) WHERE h.route = 'lookup'
UNION ALL SELECT h.query_id, h.hop, 'hybrid_search', h.route = 'simple', w.id, w.rank, w.score FROM hops h JOIN wide w ON w.query_id = concat(CAST(h.query_id AS STRING), '|', h.hop) WHERE w.rank <= CASE WHEN h.route = 'simple' THEN 10 ELSE 50 END
UNION ALL SELECT h.query_id, h.hop, 'timeline_search', false, n.id, row_number() OVER (PARTITION BY h.query_id ORDER BY coalesce(nullif(date_from, ''), '9999'), document), n.score FROM hops h JOIN narrow n ON n.query_id = concat(CAST(h.query_id AS STRING), '|', h.hop) JOIN docs ON doc_id = n.id WHERE n.rank <= 10)"""


def passages(s, d):
    return docs(s, d).select("doc_id", F.concat("document", F.lit(":0")).alias("id"), "volume_id", "document_id", F.lit(0).alias("ordinal"), "subtype", "date_from", "date_to", "text")


def route_questions(s, d):
    """Questions for each of the routes, their words and the documents that they name from the tables."""
    rows = table(s, d, "benchmark").alias("b").join(docs(s, d).select("doc_id", "volume_id"), F.col("doc_id") == F.col("item_id"))
    words = lambda n: f"array_join(slice(split(b.text, ' '), 1, {n}), ' ')"
    said = _BY_ROUTE.replace(_FIRST.format(1, 6), words(6)).replace(_FIRST.format(1, 8), words(8))
    return rows.select(F.col("item_id").alias("query_id"), F.expr(said).alias("question"), F.expr(_ROUTES).alias("route"))


def route_hops(s, d):
    """Their hops: two for the complex ones; dates for timelines; filters that nothing passes for the simple ones."""
    q = route_questions(s, d)
    place = F.when(F.col("route") == "complex", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = q.join(docs(s, d).select(F.col("doc_id").alias("query_id"), "volume_id"), "query_id").withColumn("place", F.explode(place))
    said = F.when(F.col("route") == "complex", F.array_join(F.slice(F.split("question", " "), 1 + 4 * F.col("place"), F.lit(4)), " ")).otherwise(F.col("question"))
    timeline, simple = F.col("route") == "timeline", F.col("route") == "simple"
    return rows.select(
        "query_id", "place", F.concat(F.lit("h"), F.col("place").cast("string")).alias("hop"), said.alias("query"), "route", F.when(simple, F.array("volume_id")).alias("volumes"),
        F.when(timeline, "1920-01-01").when(simple, "1800-01-01").alias("q_from"), F.when(timeline, "1960-12-31").when(simple, "1800-12-31").alias("q_to"),
    )


def dispatcher(s, d):
    rows = passages(s, d)
    numbers = rows.select("id", "doc_id")

    def search(queries, allowed, limit):
        some = allowed.join(numbers, "id").drop("id").withColumnRenamed("doc_id", "id")
        index = inputs.index(s, d, "text")  # made when something is first searched; a status asks the manifest alone
        return retrieval.bm25(queries, index, limit, some).withColumnRenamed("id", "doc_id").join(numbers, "doc_id").select("query_id", "id", "score", "rank")

    return dispatch.Dispatcher(search, rows.drop("doc_id"), manifest(s, d))


@query("n3_dispatch", f"{D}, {SQL_TOOLS} SELECT query_id, hop, tool, relaxed, concat(document, ':0') AS id, rank FROM tools JOIN docs ON doc_id = id")
def _(s, d):
    return dispatcher(s, d)(route_hops(s, d)).select("query_id", "hop", "tool", "relaxed", "id", "rank")


@query("n3_status", f"{M}, {SQL_HOPS} SELECT h.query_id, m.volume_id, m.status FROM hops h JOIN manifest m ON h.query = concat('Is ', m.volume_id, ' published') WHERE h.route = 'status'")
def _(s, d):
    return dispatcher(s, d).status(route_hops(s, d))


def _quoting(window):
    """A stand-in generator: one claim, the beginning of the best passage, with ids of its own that are discarded."""
    best = window.groupBy("query_id").agg(F.max_by("text", F.struct("score", "id")).alias("b"))
    return best.select("query_id", F.lit(0).alias("claim"), F.substring("b", 1, 80).alias("text"), F.array(F.lit("made:up:0")).alias("ids"), F.lit("one claim").alias("limitations"))


_CLAIMED, _HELD = r"regexp_replace(substring(best.text, 1, 80), 'https?://\S+', '', 'g')", r"list_distinct(regexp_extract_all(lower(p.text), '[\p{L}\p{N}]+'))"
_CLAIMED_T = rf"list_distinct(regexp_extract_all(lower({_CLAIMED}), '[\p{{L}}\p{{N}}]+'))"
SQL_SYSTEMS = f"""{M}, {SQL_TOOLS}, {SQL_DISPATCHED.replace('query_id, query FROM hops', 'query_id, question AS query FROM (SELECT *, $$h0$$ AS hop FROM asked)').replace(" WHERE route IN ('simple', 'complex')", "").replace("wide", "plainly").replace("questions", "whole")},
{SQL_DISPATCHED.replace('query_id, query FROM hops', 'query_id, question AS query FROM (SELECT *, $$h0$$ AS hop FROM asked)').replace("'simple', 'complex'", "'simple', 'complex', 'timeline'").replace("wide", "simply").replace("questions", "plainest")},
found AS (SELECT 'B0' AS system, query_id, id, score FROM tools WHERE tool = 'lookup_document'
UNION ALL SELECT 'B0', CAST(split_part(query_id, '|', 1) AS BIGINT), id, score FROM simply WHERE rank <= 10
UNION ALL SELECT 'B0-2step', CAST(split_part(query_id, '|', 1) AS BIGINT), id, score FROM plainly WHERE rank <= 10),
ev AS (SELECT f.*, docs.text, docs.document, docs.volume_id, docs.subtype, concat(docs.document, ':0') AS pid FROM found f JOIN docs ON doc_id = f.id),
best AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC NULLS LAST, pid DESC) = 1),
near AS (SELECT p.*, round(8.0 * len(list_intersect({_CLAIMED_T}, {_HELD})) / greatest(len({_CLAIMED_T}), 1) - 4.0, 6) AS s FROM best JOIN ev p ON p.system = best.system AND p.query_id = best.query_id),
picked AS (SELECT *, max(s) OVER (PARTITION BY system, query_id) AS top, row_number() OVER (PARTITION BY system, query_id ORDER BY s DESC, pid) AS k FROM near QUALIFY k <= 3 AND s >= top - 2.0),
good AS (SELECT system, query_id, string_agg(DISTINCT document, ' ' ORDER BY document) AS cited FROM picked JOIN manifest USING (volume_id) WHERE status = 'published' AND subtype = 'historical-document' GROUP BY system, query_id),
got AS (SELECT system, query_id, string_agg(DISTINCT document, ' ' ORDER BY document) AS retrieved FROM ev GROUP BY system, query_id)
SELECT system, query_id, CASE WHEN cited IS NULL THEN 'abstained' ELSE 'answered' END AS outcome, coalesce(retrieved, '') AS retrieved, coalesce(cited, '') AS cited
FROM asked CROSS JOIN (SELECT unnest(['B0', 'B0-2step']) AS system) LEFT JOIN got USING (system, query_id) LEFT JOIN good USING (system, query_id)"""


def by_system(s, d, systems, floor=None, focus=True):
    asked, out = route_questions(s, d), None
    for name in systems:
        one = agent.ask(asked.drop("route"), dispatcher(s, d), _quoting, manifest(s, d), agent.SYSTEMS[name], floor, route_hops(s, d), focus=focus).withColumn("system", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("n13_by_system", SQL_SYSTEMS)
def _(s, d):
    return by_system(s, d, ("B0", "B0-2step"), focus=False).select("system", "query_id", "outcome", F.array_join("retrieved_documents", " ").alias("retrieved"), F.array_join("cited_documents", " ").alias("cited"))


@query("n6_synthesis")
def _(s, d):
    return by_system(s, d, ("B1", "B3"), floor=-10.0).select("system", "query_id", "outcome", "language", "answer_text", "cited_documents", "limitations", "reason")


def run_cases(s, d, systems, withheld=False):
    """The questions of all routes as cases whose gold is the document that they are made of, through the loop into a table of runs."""
    asked = route_questions(s, d)
    gold = docs(s, d).select(F.col("doc_id").alias("query_id"), F.array("document").alias("gold"), "volume_id", "document_id")
    cases = asked.join(gold, "query_id").select(F.col("query_id").alias("case_id"), "question", F.lit("route").alias("kind"), F.col("route").alias("expected_route"), "gold", "volume_id", "document_id")
    tools = dispatcher(s, d)
    tools.withheld = cases.select("volume_id", "document_id") if withheld else None

    def ask(questions, system):
        return agent.ask(questions, tools, _quoting, tools.manifest, agent.SYSTEMS[system], focus=False)

    mark = runs.fingerprint(inputs.index(s, d, "text"), withheld=withheld, top_k=tools.top_k, per_hop=tools.per_hop)
    return runs.sweep(cases, systems, ask, tables.scratch(s, "runs"), mark, units=1)


_GOLD_IN = "CASE WHEN list_contains(string_split(coalesce({}, ''), ' '), docs.document) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


@query("n15_runs", SQL_SYSTEMS.replace("SELECT system, query_id, CASE", "SELECT system, query_id AS case_id, asked.route AS expected_route, CASE").replace("coalesce(retrieved, '') AS retrieved, coalesce(cited, '') AS cited", f"{_GOLD_IN.format('retrieved')} AS union_recall, {_GOLD_IN.format('cited')} AS citation_recall").replace("FROM asked CROSS JOIN", "FROM asked JOIN docs ON docs.doc_id = asked.query_id CROSS JOIN"))
def _(s, d):
    return run_cases(s, d, ["B0", "B0-2step"]).select("system", "case_id", "expected_route", "outcome", "union_recall", "citation_recall")


@query("n15_p1_runs")
def _(s, d):
    return probes.p1(run_cases(s, d, ["B0-2step"], withheld=True).withColumn("leaked", F.col("union_recall") > 0))


# the remaining joins


@query("jnc_left_lookup", M + " SELECT document, CASE WHEN volume_id IN ('src1', 'src2') THEN coalesce(n_documents, 0) ELSE 0 END AS n FROM docs LEFT JOIN manifest USING (volume_id)")
def _(s, d):
    m = manifest(s, d).where(F.col("volume_id").isin("src1", "src2")).select("volume_id", "n_documents")
    return docs(s, d).join(m, "volume_id", "left").select("document", F.coalesce("n_documents", F.lit(0)).alias("n"))


@query("jng_gold_in_hits", f"{D}, {SQL_QUESTIONS}, {SQL_GOLD}, {sql_bm25('bm25', 'text', 10)} SELECT g.query_id, count(*) AS n_gold_hit FROM gold g JOIN bm25 b ON b.query_id = g.query_id AND b.id = g.id GROUP BY g.query_id")
def _(s, d):
    return gold(s, d).join(body_hits(s, d, 10), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_gold_hit"))


@query("jnm_gold_chunks", f"{D}, {SQL_GOLD}, {SQL_CHUNKS} SELECT g.query_id, c.chunk_id FROM gold g JOIN docs ON doc_id = g.id JOIN chunks c ON c.volume_id = docs.volume_id AND c.document_id = docs.document_id")
def _(s, d):
    g = gold(s, d).join(docs(s, d).select(F.col("doc_id").alias("id"), "volume_id", "document_id"), "id")
    return g.join(_chunks(s, d).select("volume_id", "document_id", "chunk_id"), ["volume_id", "document_id"]).select("query_id", "chunk_id")


@query("t1_w1_topk", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 5")
def _(s, d):
    e = table(s, d, "events")
    return filters.latest_first(e, "user_id", [F.col("value").desc(), F.col("event_id")], 5).select("user_id", "event_id", "rank")
