"""Queries on scalar functions, filters, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import chunks, corpus, filters, select
from corpusloom.plans import inputs
from corpusloom.plans.inputs import SQL_DOCS, SQL_MANIFEST, docs, manifest, table
from corpusloom.sources import keyed, pages, tables, volumes
from corpusloom.streaming import ingest

Q: dict = {}
D, M = f"WITH {SQL_DOCS}", f"WITH {SQL_DOCS}, {SQL_MANIFEST}"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# scalar functions


@query("sc1_collapse", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.collapse(F.col("text")).alias("t"))


@query("sc2_key", D + " SELECT doc_id, regexp_replace(lower(head), '[^a-z0-9]', '', 'g') AS k FROM docs")
def _(s, d):
    return docs(s, d).select("doc_id", text.key(F.col("head")).alias("k"))


@query("sc3_unnumbered", "SELECT doc_id, regexp_replace(concat(CAST(doc_id AS STRING), '. ', text), '^\\d+\\.\\s*', '') AS t FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.unnumbered(F.concat(F.col("doc_id").cast("string"), F.lit(". "), "text")).alias("t"))


_WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


#: A sentence is what stands between . ! ? ; : with white space after it, or line ends; its first word is left out.
@query("sc4_keywords", f"""WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?;:])[{_WS}]+', '\\1\n', 'g'), '\n+')) AS t, generate_subscripts(string_split_regex(regexp_replace(text, '([.!?;:])[{_WS}]+', '\\1\n', 'g'), '\n+'), 1) AS i FROM documents),
w AS (SELECT doc_id, i, unnest(regexp_extract_all(regexp_replace(t, '^[{_WS}]*[^{_WS}]+', ''), '[\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(regexp_replace(t, '^[{_WS}]*[^{_WS}]+', ''), '[\\p{{L}}\\p{{N}}_]+'), 1) AS j FROM s),
k AS (SELECT doc_id, w, min(i * 1000000 + j) AS place FROM w WHERE regexp_full_match(w, '[A-Z][a-z]{{3,}}') AND lower(w) NOT IN ('the', 'a', 'an', 'of', 'to', 'and', 'in', 'on', 'for', 'by', 'from', 'memorandum', 'telegram', 'letter')
AND w NOT IN ('Secretary', 'State', 'Department', 'Government', 'Excellency', 'Ambassador', 'Minister', 'Legation', 'Embassy', 'Consul', 'Consulate', 'President', 'Washington', 'American', 'United', 'States', 'Charge', 'Affaires', 'Sir', 'Note', 'Telegram', 'Memorandum', 'Despatch', 'Enclosure', 'Reference', 'Source', 'Confidential', 'Secret', 'January', 'February', 'March', 'April', 'June', 'July', 'August', 'September', 'October', 'November', 'December') GROUP BY doc_id, w),
f AS (SELECT doc_id, w, place FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) <= 6)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY place), CASE WHEN d.text IS NOT NULL THEN '' END) AS keywords FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id, d.text""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


#: Pieces between boundaries; a piece goes with the one before if that one ends in an abbreviation or an initial.
@query("sc5_c4_sentences", D + f""", p AS (SELECT doc_id, document, unnest(string_split_regex(text, '\n\n+')) AS p, generate_subscripts(string_split_regex(text, '\n\n+'), 1) AS i FROM docs),
b AS (SELECT *, string_split(regexp_replace(regexp_replace(p, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '([.!?])["'')\\]]?[{_WS}]+([A-Z"''(\\[])', '\\1\x01\\2', 'g'), '\x01') AS a FROM p),
c AS (SELECT doc_id, document, i, unnest(a) AS t, generate_subscripts(a, 1) AS j FROM b), e AS (SELECT doc_id, document, i, j, regexp_replace(t, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS t FROM c),
w AS (SELECT *, regexp_extract(regexp_replace(t, '["'')\\]]+$', ''), '([A-Za-z]+)\\.$', 1) AS last FROM e WHERE t <> ''),
o AS (SELECT *, coalesce(lag(lower(last) IN ('mr', 'mrs', 'ms', 'dr', 'prof', 'rev', 'hon', 'col', 'gen', 'lt', 'capt', 'adm', 'amb', 'st', 'jr', 'sr', 'no', 'vol', 'pp', 'ch', 'art', 'sec', 'asst', 'dept', 'govt') OR regexp_full_match(last, '[A-Z]')) OVER (PARTITION BY doc_id ORDER BY i, j), false) AS onto FROM w),
g AS (SELECT *, sum(CASE WHEN onto THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM o)
SELECT document AS chunk_id, CAST(k - 1 AS BIGINT) AS idx, string_agg(t, ' ' ORDER BY i, j) AS sentence FROM g GROUP BY document, doc_id, k""".replace("\x01", "\u0001"))
def _(s, d):
    return chunks.sentence_rows(docs(s, d).select(F.col("document").alias("chunk_id"), "text"), text.sentences(F.col("text")))


_TITLED = ["He met Adm. Stark in Rome. It went well.", "Amb. Winant left! \"So it was.\" Then", "The Dept. Of war (no. 5) met J. Smith.) Next [it] ended? Yes.\n\nMr.\n\nByrnes spoke.", "At 5 p.m. He left. No. 7 U.S. Forces"]


#: Worked by hand: titles, initials and closing quotes.
@query("sc5_titles", "WITH v AS (SELECT * FROM (VALUES (0, 0, 'He met Adm. Stark in Rome.'), (0, 1, 'It went well.'), (1, 0, 'Amb. Winant left!'), (1, 1, '\"So it was.'), (1, 2, 'Then'), (2, 0, 'The Dept. Of war (no. 5) met J. Smith.'), (2, 1, 'Next [it] ended?'), (2, 2, 'Yes.'), (2, 3, 'Mr. Byrnes spoke.'), (3, 0, 'At 5 p.m.'), (3, 1, 'He left.'), (3, 2, 'No. 7 U.S. Forces')) t(k, idx, sentence)) SELECT doc_id AS chunk_id, idx, sentence FROM documents JOIN v ON doc_id % 4 = k".replace("VALUES (0, 0", "VALUES (CAST(0 AS BIGINT), CAST(0 AS BIGINT)"))
def _(s, d):
    """Each document is given one of the texts with titles, initials and brackets."""
    said = F.element_at(F.array(*map(F.lit, _TITLED)), (F.col("doc_id") % 4 + 1).cast("int"))
    return chunks.sentence_rows(table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), said.alias("t")), text.sentences(F.col("t")))


@query("sc6_query_text", "SELECT item_id, trim(translate(text, '+-!(){}[]^\"~*?:\\/', repeat(' ', 18))) AS t FROM benchmark")
def _(s, d):
    return table(s, d, "benchmark").select("item_id", text.query_text(F.col("text")).alias("t"))


@query("sc7_assemble", """
WITH p AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(list_sort(list_distinct([CAST(0 AS BIGINT), CAST(doc_id % 3 AS BIGINT), CAST(2 + doc_id % 2 AS BIGINT)]))) AS i FROM p WHERE len(w) > 4),
g AS (SELECT doc_id, i, w[i + 1] AS part, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k)
SELECT doc_id, string_agg(CASE WHEN before IS NOT NULL AND i <> before + 1 THEN concat('[…] ', part) ELSE part END, ' ' ORDER BY i) AS t FROM g GROUP BY doc_id""")
def _(s, d):
    p = table(s, d, "documents").select("doc_id", F.split("text", " ").alias("w")).where(F.size("w") > 4)
    kept = F.array(F.lit(0), (F.col("doc_id") % 3).cast("int"), (2 + F.col("doc_id") % 2).cast("int"))
    return p.select("doc_id", text.assemble(F.col("w"), kept).alias("t"))


_QUESTIONS = [
    "When was volume 3 Published?", "Show Document  12 of src4", "Compare the two notes", "Give a TIMELINE of the talks", "Who wrote it?", "為何 談判 破裂", "document no. 5", "Why did both sides differ?",
    "Was the series released?", "Is it forthcoming?", "What led to the crisis?", "When did they meet?", "What does src12-a say?", "第 5 號文件", "出版 了嗎", "比較 兩者", "經過 如何", "the cause of src1", "not yet planned?", "an even sequence", "a chronology",
]
_ASKED = "CASE user_id % 21 " + " ".join(f"WHEN {k} THEN '{q}'" for k, q in enumerate(_QUESTIONS)) + " END"


@query("sc8_language", f"SELECT event_id, CASE WHEN regexp_matches({_ASKED}, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh-TW' ELSE 'en' END AS language FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", text.language(F.expr(_ASKED)).alias("language"))


@query("sc9_route", f"""SELECT event_id, CASE WHEN regexp_matches(q, '(published|not yet published|planned|forthcoming|出版|已出版|尚未出版|規劃中|哪一卷)') THEN 'status'
WHEN regexp_matches(q, '(src\\d[\\w\\-]*|document\\s+\\d+|第\\s*\\d+\\s*號文件)') THEN 'lookup' WHEN regexp_matches(q, '(compare|difference|differ|versus|why did|cause|led to|比較|差異|為什麼|原因|導致|影響)') THEN 'complex'
WHEN regexp_matches(q, '(timeline|chronolog|sequence|順序|時間軸|經過|演變|什麼時候|何時|when did)') THEN 'timeline' ELSE 'simple' END AS route FROM (SELECT event_id, lower({_ASKED}) AS q FROM events)""")
def _(s, d):
    return table(s, d, "events").select("event_id", text.route(F.expr(_ASKED)).alias("route"))


@query("sc10_document_reference", f"SELECT event_id, nullif(regexp_extract({_ASKED}, '(src\\d+)\\D+(\\d+)', 1), '') AS volume_id FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", text.document_reference(F.expr(_ASKED))["volume_id"].alias("volume_id"))


@query("sc11_sc12_chunk_ids", D + """, c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(document, ':x') ELSE concat(document, ':', CAST(doc_id % 9 AS STRING)) END AS id FROM docs)
SELECT doc_id, regexp_matches(id, '^[A-Za-z0-9\\-.]+:[A-Za-z0-9_\\-.]+:\\d+$') AS ok, split_part(id, ':', 1) AS volume_id, split_part(id, ':', 2) AS document_id, split_part(id, ':', 3) AS ordinal FROM c""")
def _(s, d):
    c = docs(s, d).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("document", F.lit(":x"))).otherwise(F.concat("document", F.lit(":"), (F.col("doc_id") % 9).cast("string"))).alias("id"))
    return c.select("doc_id", text.is_chunk_id(F.col("id")).alias("ok"), text.chunk_parts(F.col("id")).alias("p")).select("doc_id", "ok", "p.*")


@query("sc13_urls", "SELECT page_id, array_to_string(regexp_extract_all(concat('see ', url, ' and ', url, ' too'), 'https?://\\S+'), '|') AS urls, trim(regexp_replace(regexp_replace(concat('see ', url, ' and ', url, ' too'), 'https?://\\S+', '', 'g'), '\\s+', ' ', 'g')) AS rest FROM pages")
def _(s, d):
    t = F.concat(F.lit("see "), "url", F.lit(" and "), "url", F.lit(" too"))
    return table(s, d, "pages").select("page_id", F.array_join(text.urls(t), "|").alias("urls"), text.without_urls(t).alias("rest"))


@query("sc14_citation_line", D + " SELECT doc_id, concat('[', CAST(doc_id AS STRING), '] ', head, ' (', volume_id, ', ', document_id, ') ', 'https://example.org/', volume_id, '/', document_id) AS line FROM docs")
def _(s, d):
    url = text.canonical_url("https://example.org", F.col("volume_id"), F.col("document_id"))
    return docs(s, d).select("doc_id", text.citation_line(F.col("doc_id"), F.col("head"), F.col("volume_id"), F.col("document_id"), url).alias("line"))


@query("sc15_dates", D + " SELECT doc_id, substring(date_from, 1, 4) AS year, CASE WHEN regexp_matches(date_from, '^\\d{4}-\\d{2}-\\d{2}$') THEN concat(lpad(CAST(TRY_CAST(substring(date_from, 1, 4) AS BIGINT) + 7 AS STRING), 4, '0'), substring(date_from, 5, 6)) END AS later FROM docs")
def _(s, d):
    return docs(s, d).select("doc_id", F.substring("date_from", 1, 4).alias("year"), text.shifted_year(F.col("date_from"), 7).alias("later"))


@query("sc18_named_actors")
def _(s, d):
    t = F.concat(F.lit("Mr. "), F.initcap(F.substring_index("text", " ", 1)), F.lit(" met Secretary Byrnes and Dr Smith; Mr. Jones left."))
    return table(s, d, "documents").select("doc_id", F.array_join(text.named_actors(t), "|").alias("actors"))


_JUDGED = "CASE event_id % 4 WHEN 0 THEN concat('{\"score\": ', CAST(event_id % 9 AS STRING), '.5}') WHEN 1 THEN concat('the score: 0.', CAST(event_id % 10 AS STRING), ' fair') WHEN 2 THEN 'no idea' ELSE '{\"score\": 0.25}' END"


@query("sc19_judged_score", f"WITH j AS (SELECT event_id, {_JUDGED} AS t FROM events) SELECT event_id, CASE WHEN x IS NOT NULL THEN greatest(0.0, least(1.0, x)) END AS score FROM (SELECT event_id, TRY_CAST(nullif(regexp_extract(t, '\"?score\"?\\s*[:=]\\s*(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS x FROM j)")
def _(s, d):
    return table(s, d, "events").select("event_id", text.judged_score(F.expr(_JUDGED)).alias("score"))


@query("sc20_cosine", "SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(s, d):
    e = table(s, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("sc21_mentions", "SELECT event_id, regexp_matches(concat('see Doc. ', CAST(user_id % 5 AS STRING), ' now'), concat('\\b(Document|Doc\\.?)\\s+', CAST(event_id % 5 AS STRING), '\\b')) AS hit FROM events")
def _(s, d):
    t = F.concat(F.lit("see Doc. "), (F.col("user_id") % 5).cast("string"), F.lit(" now"))
    return table(s, d, "events").select("event_id", text.mentions_document(t, F.col("event_id") % 5).alias("hit"))


@query("sc22_json", "SELECT event_id, concat('{\"user\":', CAST(user_id AS STRING), ',\"type\":\"', event_type, '\"}') AS j FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("j"))


# filters

_F = filters.Filters


def _filtered(s, d, f):
    return filters.apply(docs(s, d), f).select("document", "subtype", "date_from", "date_to")


_SHOW = " SELECT document, subtype, date_from, date_to FROM docs WHERE "


@query("f1_volumes", D + _SHOW + "volume_id IN ('src1', 'src4')")
def _(s, d):
    return _filtered(s, d, _F(("src1", "src4")))


@query("f2_subtypes", D + _SHOW + "subtype IN ('editorial-note')")
def _(s, d):
    return _filtered(s, d, _F(subtypes=("editorial-note",)))


@query("f3_date_overlap", D + _SHOW + "date_to >= '1920-01-01' AND date_from <= '1930-06-30'")
def _(s, d):
    return _filtered(s, d, _F(date_from="1920-01-01", date_to="1930-06-30"))


@query("f3_q2_upper_bound_keeps_undated", D + _SHOW + "date_from <= '1930-06-30'")
def _(s, d):
    return _filtered(s, d, _F(date_to="1930-06-30"))


@query("f4_exclude", D + _SHOW + "document NOT IN ('src1:d1', 'src2:d2')")
def _(s, d):
    return _filtered(s, d, _F(exclude=("src1:d1", "src2:d2", "nothing")))


@query("f5_all_conditions", D + _SHOW + "volume_id IN ('src1', 'src2') AND subtype = 'historical-document' AND date_to >= '1910-01-01' AND date_from <= '1960-01-01' AND document <> 'src1:d21'")
def _(s, d):
    return _filtered(s, d, _F(("src1", "src2"), ("historical-document",), "1910-01-01", "1960-01-01", ("src1:d21",)))


@query("f5_no_conditions", D + _SHOW + "true")
def _(s, d):
    return _filtered(s, d, _F())


@query("f6_f7_guarded", D + " SELECT document FROM docs WHERE volume_id = 'src5'")
def _(s, d):
    return filters.guarded(docs(s, d), "volume_id", "src5").unionByName(filters.guarded(docs(s, d), "volume_id", "x' OR '1'='1")).select("document")


@query("f9_projection", D + " SELECT document, volume_id, document_id, head, date_from, date_to, subtype, lang, text FROM docs")
def _(s, d):
    return docs(s, d).select("document", "volume_id", "document_id", "head", "date_from", "date_to", "subtype", "lang", "text")


def _vectors(s, d):
    return docs(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")


@query("f10_embedded", D + " SELECT docs.doc_id FROM docs JOIN embeddings ON vec_id = doc_id WHERE embedding IS NOT NULL")
def _(s, d):
    return filters.embedded(_vectors(s, d)).select("doc_id")


@query("f11_published", M + " SELECT volume_id, n_documents FROM manifest WHERE status = 'published'")
def _(s, d):
    return filters.published(manifest(s, d)).select("volume_id", "n_documents")


@query("f12_containing", "WITH t AS (SELECT item_id, text AS term FROM benchmark) SELECT term, count(*) AS df FROM documents JOIN t ON contains(text, term) GROUP BY term")
def _(s, d):
    terms = table(s, d, "benchmark").select("item_id", F.col("text").alias("term"))
    return filters.containing(table(s, d, "documents"), terms, "doc_id").groupBy("term").agg(F.count("*").alias("df"))


@query("f13_first_chunks", D + " SELECT document FROM docs WHERE subtype = 'historical-document' AND head <> '' AND date_from <> ''")
def _(s, d):
    return filters.first_chunks(docs(s, d).withColumn("ordinal", F.lit(0))).select("document")


@query("f14_series_status", M + ", f AS (SELECT * FROM manifest WHERE contains(lower(volume_id), 'c1') OR contains(lower(title), 'c1') OR contains(lower(sub_series), 'c1')) SELECT volume_id, status, (SELECT count(*) FROM f WHERE status = 'published') AS n_published, (SELECT count(*) FROM f WHERE status <> 'published') AS n_planned FROM f ORDER BY volume_id LIMIT 20")
def _(s, d):
    return filters.series_status(manifest(s, d), "C1")


@query("f15_relaxed", D + """, q AS (SELECT item_id AS query_id, concat('src', CAST(item_id AS STRING)) AS v, item_id % 2 = 0 AS filtered FROM benchmark),
n AS (SELECT query_id, document, filtered FROM q JOIN docs ON volume_id = v AND lang = 'es'),
w AS (SELECT query_id, document FROM q JOIN docs ON lang = 'fr' AND doc_id % 40 = query_id)
SELECT query_id, document, false AS relaxed FROM n UNION ALL SELECT w.query_id, w.document, true FROM w JOIN q USING (query_id) WHERE filtered AND query_id NOT IN (SELECT query_id FROM n)""")
def _(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("volume_id"), (F.col("item_id") % 2 == 0).alias("filtered"))
    hits = q.join(docs(s, d).where("lang = 'es'"), "volume_id").select("query_id", "document")
    wider = q.select("query_id").join(docs(s, d).where("lang = 'fr'").withColumn("query_id", F.col("doc_id") % 40), "query_id").select("query_id", "document")
    return filters.relaxed(hits, wider, q)


_CANDIDATES = "CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN concat('VOLUME-', source) ELSE concat('no', CAST(doc_id AS STRING)) END"


@query("f16_jnd_resolve_volumes", M + f""", c AS (SELECT DISTINCT {_CANDIDATES} AS candidate FROM documents),
a AS (SELECT alias, min(volume_id) AS v FROM (SELECT regexp_replace(lower(volume_id), '[^a-z0-9]', '', 'g') AS alias, volume_id FROM manifest UNION ALL SELECT regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), volume_id FROM manifest) GROUP BY alias)
SELECT candidate, coalesce(m.volume_id, a.v) AS volume_id, CASE WHEN m.volume_id IS NOT NULL THEN 'exact' WHEN a.v IS NOT NULL THEN 'alias' ELSE 'dropped' END AS how FROM c LEFT JOIN manifest m ON m.volume_id = candidate LEFT JOIN a ON a.alias = regexp_replace(lower(candidate), '[^a-z0-9]', '', 'g')""")
def _(s, d):
    return filters.resolve_volumes(table(s, d, "documents").select(F.expr(_CANDIDATES).alias("candidate")).distinct(), manifest(s, d))


@query("f17_iso_date", D + " SELECT doc_id, CASE WHEN regexp_matches(date_from, '^\\d{4}-\\d{2}-\\d{2}$') THEN date_from END AS date FROM docs")
def _(s, d):
    return docs(s, d).select("doc_id", text.iso_date(F.col("date_from")).alias("date"))


@query("f18_excluding", D + " SELECT document FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(s, d):
    bad = docs(s, d).join(table(s, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    return filters.excluding(docs(s, d), bad).select("document")


_PERSONS = "[A-Z][a-z]{4,}"


def _persons(s, d):
    return docs(s, d).withColumn("persons", F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(_PERSONS), F.lit(0))), 1, 40))


SQL_PERSONS = f"""pp AS (SELECT doc_id, document, volume_id, text, unnest(regexp_extract_all(text, '{_PERSONS}')) AS person, generate_subscripts(regexp_extract_all(text, '{_PERSONS}'), 1) AS i FROM docs),
pf AS (SELECT doc_id, document, volume_id, person, min(i) AS i FROM pp GROUP BY ALL), persons AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM pf QUALIFY k <= 40)"""


@query("a9_t4_u6_persons", D + f", {SQL_PERSONS} SELECT doc_id, string_agg(person, '|' ORDER BY k) AS persons FROM persons GROUP BY doc_id")
def _(s, d):
    return _persons(s, d).where(F.size("persons") > 0).select("doc_id", F.array_join("persons", "|").alias("persons"))


@query("f19_names", D + f", {SQL_PERSONS} SELECT doc_id, person FROM persons JOIN docs USING (doc_id) WHERE length(text) > 400 AND length(person) >= 5 AND regexp_matches(regexp_replace(person, '[ .]', '', 'g'), '^\\p{{L}}+$') AND contains(text, person)")
def _(s, d):
    p = _persons(s, d).where(F.length("text") > 400).select("doc_id", "text", F.explode("persons").alias("person"))
    return p.where(corpus.name_shaped(F.col("person")) & F.contains("text", F.col("person"))).select("doc_id", "person")


@query("f20_persons", D + f", {SQL_PERSONS} SELECT DISTINCT doc_id FROM persons WHERE person IN ('Enmentai', 'Thble', 'Erreth')")
def _(s, d):
    return filters.apply(_persons(s, d), _F(persons=("Enmentai", "Thble", "Erreth"), match_persons=True)).select("doc_id")


@query("jnq_overlapping_dates", D + """, q AS (SELECT item_id AS query_id, concat(CAST(1900 + item_id AS STRING), '-03-01') AS q_from, concat(CAST(1902 + item_id AS STRING), '-02-01') AS q_to FROM benchmark)
SELECT query_id, document FROM q JOIN docs ON date_from <> '' AND date_to >= q_from AND date_from <= q_to""")
def _(s, d):
    year = lambda n: F.concat((n + F.col("item_id")).cast("string"))
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(year(1900), F.lit("-03-01")).alias("q_from"), F.concat(year(1902), F.lit("-02-01")).alias("q_to"))
    return filters.overlapping(q, docs(s, d)).select("query_id", "document")


# sources and sinks


@query("a3_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("a4_b1_manifest_round_trip", M + " SELECT * FROM manifest")
def _(s, d):
    path = tables.scratch(s, "manifest")
    tables.write(manifest(s, d), path)
    return s.read.parquet(path)


_XML_TEXT = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_XML_HEAD = "replace(replace(replace(head, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_VOLUME = "concat(volume_id, '-', CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING))"


def _volumes(s, d):
    """Documents as TEI volumes of up to 1000 ids of a source each, written and read as whole files."""
    div = F.concat(
        F.lit('<div type="document" subtype="'), "subtype", F.lit('" xml:id="'), "document_id", F.lit('"><head>'), F.expr(_XML_HEAD), F.lit('<note type="source">Source.</note></head><p><persName>A. Person</persName> <!-- no --><note>foot</note>'), F.expr(_XML_TEXT),
        F.lit(' <ref target="#'), "document_id", F.lit('">1</ref></p></div>'),
    )
    rows = docs(s, d).select(F.expr(_VOLUME).alias("volume"), "doc_id", div.alias("div")).groupBy("volume").agg(F.array_sort(F.collect_list(F.struct("doc_id", "div"))).alias("divs"))
    text_ = F.concat(F.lit('<TEI><teiHeader><title type="complete">Volume '), "volume", F.lit('</title><idno type="series">'), "volume", F.lit("</idno></teiHeader><text><body>"), F.array_join(F.transform("divs", lambda x: x["div"]), ""), F.lit("</body></text></TEI>"))
    path = tables.scratch(s, "tei")
    rows.select(text_.alias("value"), "volume").write.partitionBy("volume").text(path)
    return s.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)


@query("a1_a2_xml_manifest", D + f" SELECT {_VOLUME} AS volume_id, concat('Volume ', {_VOLUME}) AS title, 'published' AS status, count(*) AS n_documents, count(*) FILTER (WHERE subtype = 'historical-document') AS n_historical FROM docs GROUP BY 1")
def _(s, d):
    return volumes.scan_manifest(_volumes(s, d)).select("volume_id", "title", "status", "n_documents", "n_historical")


@query("a5_a6_a7_a8_xml_documents", D + f" SELECT {_VOLUME} AS volume_id, document_id, subtype, trim(regexp_replace(head, '\\s+', ' ', 'g')) AS head, 'Source.' AS source_note, 'A. Person' AS persons, concat('A. Person ', trim(regexp_replace(text, '\\s+', ' ', 'g')), ' 1') AS text FROM docs")
def _(s, d):
    rows = volumes.scan_documents(_volumes(s, d), editorial_notes=True)
    return rows.select("volume_id", "document_id", "subtype", "head", "source_note", F.array_join("persons", "|").alias("persons"), "text")


@query("a16_a17_xml_references", D + f" SELECT {_VOLUME} AS volume_id, document_id, document_id AS target FROM docs WHERE subtype = 'historical-document'")
def _(s, d):
    return volumes.references(volumes.with_references(_volumes(s, d))).select("volume_id", "document_id", "target")


@query("a5_a10_page_documents")
def _(s, d):
    return pages.documents(table(s, d, "pages"))


@query("a11_projected_scan", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 1000")
def _(s, d):
    return table(s, d, "documents").where("n_chars > 1000").select("doc_id", "n_chars")


@query("a12_row_count", "SELECT count(*) AS n FROM documents")
def _(s, d):
    return tables.row_count(s, f"{d}/documents.parquet")


@query("a13_t3_point_scan", D + " SELECT document, head FROM docs WHERE volume_id = 'src2' ORDER BY doc_id LIMIT 64")
def _(s, d):
    return docs(s, d).where("volume_id = 'src2'").orderBy("doc_id").limit(64).select("document", "head")


@query("a14_count", "SELECT count(*) AS n FROM documents WHERE lang = 'de'")
def _(s, d):
    return table(s, d, "documents").where("lang = 'de'").agg(F.count("*").alias("n"))


@query("a15_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def _(s, d):
    path = tables.scratch(s, "cases")
    table(s, d, "conversations").write.json(path)
    return tables.read_json_lines(s, path, "conv_id long, turn long, role string, text string")


@query("a17_jnn_reference_edges", D + """, e AS (SELECT volume_id, document_id, concat('d', CAST((doc_id * 7 + 20) % 1500 AS STRING)) AS target, doc_id AS position FROM docs),
ok AS (SELECT e.* FROM e JOIN docs t ON t.volume_id = e.volume_id AND t.document_id = e.target WHERE e.target <> e.document_id)
SELECT volume_id, document_id, target FROM ok QUALIFY row_number() OVER (PARTITION BY volume_id ORDER BY position, target) = 1""")
def _(s, d):
    e = docs(s, d).select("volume_id", "document_id", F.concat(F.lit("d"), ((F.col("doc_id") * 7 + 20) % 1500).cast("string")).alias("target"), F.col("doc_id").alias("position"))
    return corpus.edges_within(e, docs(s, d))


@query("a18_variants", "SELECT event_type AS variant, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def _(s, d):
    path = tables.scratch(s, "runs")
    table(s, d, "events").select("event_id", "value", "event_type").write.partitionBy("event_type").json(path)
    rows = tables.read_variants(s, f"{path}/*/*.json", "event_id long, value double", r"event_type=([^/]+)/")
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("b2_jne_resume", D + " SELECT document, length(text) AS n FROM docs")
def _(s, d):
    path, rows = tables.scratch(s, "parsed"), docs(s, d).select("document", "volume_id", F.length("text").cast("long").alias("n"))
    tables.write_partitions(rows.where("volume_id < 'src5'"), path, "volume_id")
    done = s.read.parquet(path).select("document", F.col("volume_id").cast("string").alias("volume_id"))
    tables.write_partitions(tables.todo(rows, done, ["document"]), path, "volume_id")
    return s.read.parquet(path).select("document", "n")


@query("b3_partitioned", D + " SELECT volume_id, count(*) AS n FROM docs WHERE volume_id IN ('src1', 'src2') GROUP BY volume_id")
def _(s, d):
    path = tables.scratch(s, "chunks")
    tables.write(docs(s, d), path, "volume_id")
    return s.read.parquet(path).where(F.col("volume_id").isin("src1", "src2")).groupBy("volume_id").agg(F.count("*").alias("n"))


@query("b4_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents UNION ALL SELECT 1000000 + doc_id, 'new' FROM documents WHERE doc_id < 5")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", "lang")
    new = t.where("doc_id % 3 = 0").unionByName(t.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 1000000)).withColumn("lang", F.lit("new"))
    kept = keyed.KeyedTable(s, tables.scratch(s, "keyed"), "doc_id")
    kept.upsert(t)
    kept.upsert(new)
    return kept.read(t.schema)


@query("b5_replace_columns", "SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN d.n_chars ELSE CAST(e.label AS BIGINT) END AS n_chars FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def _(s, d):
    new = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("n_chars"))
    return tables.replace_columns(table(s, d, "documents").select("doc_id", "n_chars"), new, "doc_id", ["n_chars"])


@query("b6_state", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(s, d):
    return tables.todo(table(s, d, "documents").select("doc_id"), table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), ["doc_id"])


@query("b7_jnf_resume_by_mode", f"WITH {inputs.SQL_RUNS}, c AS (SELECT DISTINCT system, language, case_id FROM runs) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.system = c.system AND r.language = c.language AND r.case_id = c.case_id AND r.mode = 'partial')")
def _(s, d):
    r, keys = inputs.runs(s, d), ["system", "language", "case_id"]
    return tables.todo(r.select(*keys).distinct(), r, keys, ("mode", "partial")).select(*keys)


@query("b8_report", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(s, d):
    path = tables.scratch(s, "report")
    tables.write_report(table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), path)
    return s.read.schema("lang string, n long").json(path)


@query("b9_trace", "SELECT conv_id, turn, substring(text, 1, 50) AS text FROM conversations")
def _(s, d):
    return tables.trace(table(s, d, "conversations").select("conv_id", "turn", "text"), {"text": 50})


@query("b2_b6_stream", "SELECT conv_id, turn, length(text) AS n FROM conversations")
def _(s, d):
    src, sink, mark = (tables.scratch(s, x) for x in ("src", "sink", "mark"))
    c = table(s, d, "conversations").select("conv_id", "turn", "text")
    shape = lambda x: x.select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    for k in (0, 1):  # the second run sees only what is new
        c.where(f"conv_id % 2 = {k}").write.mode("append").parquet(src)
        ingest.ingest(s, src, "conv_id long, turn long, text string", sink, mark, shape)
    return s.read.parquet(sink)


# chunks, sets, samples

SIZE, OVERLAP = 64, 8
SQL_CHUNKS = f"""ct AS (SELECT *, regexp_extract_all(text, '\\s*\\S+') AS t FROM docs), cn AS (SELECT *, CASE WHEN len(t) > 0 THEN 1 + greatest(0, CAST(ceil((len(t) - {SIZE}) / {float(SIZE - OVERLAP)}) AS BIGINT)) ELSE 0 END AS n FROM ct),
co AS (SELECT *, unnest(range(n)) AS ordinal FROM cn), cb AS (SELECT *, list_slice(t, ordinal * {SIZE - OVERLAP} + 1, ordinal * {SIZE - OVERLAP} + {SIZE}) AS part FROM co),
chunks AS (SELECT concat(volume_id, ':', document_id, ':', CAST(ordinal AS STRING)) AS chunk_id, volume_id, document_id, document, ordinal, n AS n_chunks_in_doc, subtype, head, date_from, date_to, concat(CASE WHEN head IS NULL OR head = '' THEN '' ELSE concat(head, '\n\n') END, trim(regexp_replace(array_to_string(part, ''), '^\\s+|\\s+$', '', 'g'))) AS text, len(part) AS n_tokens FROM cb)"""


def chunk_table(s, d):
    return chunks.chunk(docs(s, d), SIZE, OVERLAP)


@query("c1_chunks", D + f", {SQL_CHUNKS} SELECT chunk_id, ordinal, n_chunks_in_doc, n_tokens, text FROM chunks")
def _(s, d):
    return chunk_table(s, d).select("chunk_id", "ordinal", "n_chunks_in_doc", "n_tokens", "text")


_HEADS = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE head END"


@query("c1_heads", D + f", docs2 AS (SELECT * REPLACE ({_HEADS} AS head), CAST(doc_id AS STRING) AS doc_number FROM docs), {SQL_CHUNKS.replace('FROM docs)', 'FROM docs2)')} SELECT chunk_id, text, substring(document_id, 2) AS doc_number FROM chunks")
def _(s, d):
    rows = docs(s, d).withColumn("head", F.expr(_HEADS)).withColumn("doc_number", F.col("doc_id").cast("string"))
    return chunks.chunk(rows, SIZE, OVERLAP).select("chunk_id", "text", "doc_number")


@query("c2_jnl_adjacent", D + f", {SQL_CHUNKS} SELECT a.chunk_id AS anchor_id, b.chunk_id, b.ordinal FROM chunks a JOIN chunks b ON a.document = b.document AND abs(a.ordinal - b.ordinal) = 1")
def _(s, d):
    c = chunk_table(s, d)
    return chunks.adjacent(c.select("chunk_id"), c)


@query("c3_neighbours", D + f""", {SQL_CHUNKS}, ev AS (SELECT substring(volume_id, 4, 1) AS query_id, chunk_id, volume_id, document_id, ordinal, row_number() OVER (PARTITION BY substring(volume_id, 4, 1) ORDER BY chunk_id) AS position FROM chunks WHERE ordinal = 0),
nb AS (SELECT e.query_id, c.chunk_id, e.position, c.ordinal FROM ev e JOIN chunks c ON c.volume_id = e.volume_id AND c.document_id = e.document_id AND abs(c.ordinal - e.ordinal) = 1 WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.query_id = e.query_id AND x.chunk_id = c.chunk_id)),
one AS (SELECT * FROM nb QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY position) = 1), al AS (SELECT query_id, chunk_id, position, -1 AS o FROM ev UNION ALL SELECT query_id, chunk_id, position, ordinal FROM one)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY position, o) AS place FROM al""")
def _(s, d):
    from pyspark.sql import Window

    c = chunk_table(s, d)
    q = F.substring("volume_id", 4, 1)
    e = c.where("ordinal = 0").select(q.alias("query_id"), "chunk_id", F.lit(1.0).alias("score"), F.lit("h0").alias("hop"))
    e = e.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return chunks.with_neighbours(e, c).select("query_id", "chunk_id", "place")


@query("t5_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(concat('7:', CAST(doc_id AS STRING))), doc_id LIMIT 50")
def _(s, d):
    return select.seeded_sample(table(s, d, "documents").select("doc_id"), "doc_id", 50, 7)


@query("t6_per_stratum", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 7")
def _(s, d):
    return select.per_stratum(table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 7)
