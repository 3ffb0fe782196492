"""Scalar functions on text as Column expressions; none of them needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Characters that full-text queries drop.
QUERY_MARKS = "+-!(){}[]^\"~*?:\\/"
#: Words that end in a dot but not a sentence, in any case.
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "rev", "hon", "col", "gen", "lt", "capt", "adm", "amb", "st", "jr", "sr",
    "no", "vol", "pp", "ch", "art", "sec", "asst", "dept", "govt",
]
#: Words that are no keywords, in any case, and words that are none as they are.
STOP_WORDS = ["the", "a", "an", "of", "to", "and", "in", "on", "for", "by", "from", "memorandum", "telegram", "letter"]
BOILERPLATE = [
    "Secretary", "State", "Department", "Government", "Excellency", "Ambassador", "Minister", "Legation", "Embassy",
    "Consul", "Consulate", "President", "Washington", "American", "United", "States", "Charge", "Affaires", "Sir", "Note",
    "Telegram", "Memorandum", "Despatch", "Enclosure", "Reference", "Source", "Confidential", "Secret",
    "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December",
]
#: White space of Unicode, and the separators U+001C to U+001F, inside a character class.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def collapse(c: Column) -> Column:
    """All white space, Unicode's too, as single spaces; none at the ends (SC-1)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def key(c: Column) -> Column:
    """Lower-case letters a-z and digits only (SC-2)."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def unnumbered(c: Column) -> Column:
    """Without a leading number and dot (SC-3)."""
    return F.regexp_replace(c, r"^\d+\.\s*", "")


def stripped(c: Column) -> Column:
    """Without white space at the ends; each character is looked at once or twice, however long the white space inside."""
    return F.regexp_extract(c, f"(?s)^[{SPACE}]*+(.*[^{SPACE}])", 1)


def keywords(c: Column, n: int = 6) -> Column:
    """The first n different capitalised words of four letters or more that don't start a sentence (SC-4). Sentences
    end at . ! ? ; or : before white space and at line ends."""
    rest = F.transform(F.split(c, f"(?<=[.!?;:])[{SPACE}]+|\n+"), lambda s: F.regexp_replace(s, f"^[{SPACE}]*[^{SPACE}]+", ""))
    words = F.flatten(F.transform(rest, lambda s: F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    return F.slice(F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]{3,}$") & ~F.lower(w).isin(STOP_WORDS) & ~w.isin(BOILERPLATE))), 1, n)


def sentences(c: Column) -> Column:
    """Array of sentences (SC-5). Paragraphs end sentences; so does . ! or ?, and a closing quote or bracket, with white
    space and an upper-case letter, quote or bracket after it. A piece that ends in an abbreviation or an initial takes the next one."""
    #: Fixed value: the boundary.
    boundary = f"(?<=[.!?])[\"')\\]]?[{SPACE}]+(?=[A-Z\"'(\\[])"
    pieces = F.flatten(F.transform(F.transform(F.split(c, r"\n{2,}"), stripped), lambda p: F.split(p, boundary)))
    pieces = F.filter(F.transform(pieces, stripped), lambda p: p != "")
    last_word = lambda s: F.regexp_extract(F.regexp_replace(s, "[\"')\\]]+$", ""), r"([A-Za-z]+)\.$", 1)
    open_end = lambda s: F.lower(last_word(s)).isin(ABBREVIATIONS) | last_word(s).rlike("^[A-Z]$")
    empty = F.array().cast("array<string>")
    joined = F.aggregate(
        pieces,
        F.struct(empty.alias("done"), F.lit("").alias("held")),
        lambda a, p: F.when(a["held"] == "", F.struct(a["done"].alias("done"), p.alias("held")))
        .when(open_end(a["held"]), F.struct(a["done"].alias("done"), F.concat_ws(" ", a["held"], p).alias("held")))
        .otherwise(F.struct(F.concat(a["done"], F.array(a["held"])).alias("done"), p.alias("held"))),
        lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"]))),
    )
    return F.when(c.isNull(), None).otherwise(joined)


def query_text(c: Column) -> Column:
    """A full-text query without operators (SC-6)."""
    return F.trim(F.translate(c, QUERY_MARKS, " " * len(QUERY_MARKS)))


def assemble(parts: Column, kept: Column) -> Column:
    """The kept parts, by ascending 0-based index, with [...] where some are left out between (SC-7)."""
    order = F.array_sort(F.array_distinct(kept))
    pieces = F.transform(order, lambda k, i: F.concat(F.when((i > 0) & (k != F.get(order, i - 1) + 1), F.lit("[…] ")).otherwise(F.lit("")), F.get(parts, k)))
    return F.array_join(pieces, " ")


def language(c: Column) -> Column:
    """zh-TW with any CJK ideograph, else en (SC-8)."""
    return F.when(c.rlike(r"[\x{4e00}-\x{9fff}]"), "zh-TW").otherwise("en")


#: Routes in order of precedence, each with the words that call for it. {series}: a volume's id.
ROUTES = [
    ("status", r"published|not yet published|planned|forthcoming|出版|已出版|尚未出版|規劃中|哪一卷"),
    ("lookup", r"{series}[\w\-]*|document\s+\d+|第\s*\d+\s*號文件"),
    ("complex", r"compare|difference|differ|versus|why did|cause|led to|比較|差異|為什麼|原因|導致|影響"),
    ("timeline", r"timeline|chronolog|sequence|順序|時間軸|經過|演變|什麼時候|何時|when did"),
]


def route(c: Column, series: str = r"src\d") -> Column:
    """The first route whose words a question has, else simple (SC-9)."""
    out = F
    for name, words in ROUTES:
        out = out.when(c.rlike(f"(?i){words.replace('{series}', series)}"), name)
    return out.otherwise("simple")


def document_reference(c: Column, series: str = r"src\d+") -> Column:
    """volume and document ids named in a question (SC-10); null if there are none."""
    pattern = rf"({series})\D+(\d+)"
    volume, number = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(volume != "", F.struct(volume.alias("volume_id"), F.concat(F.lit("d"), number).alias("document_id")))


def is_chunk_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9\-.]+:[A-Za-z0-9_\-.]+:\d+$")  # SC-11


def chunk_parts(c: Column) -> Column:
    """volume, document and ordinal of a chunk id, split from the right (SC-12)."""
    return F.struct(F.substring_index(c, ":", 1).alias("volume_id"), F.substring_index(F.substring_index(c, ":", -2), ":", 1).alias("document_id"), F.substring_index(c, ":", -1).alias("ordinal"))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"https?://\S+"), F.lit(0))  # SC-13


def without_urls(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"https?://\S+", ""))  # SC-13


def canonical_url(base: str, volume: Column, document: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), volume, F.lit("/"), document)  # SC-14


def citation_line(number: Column, head: Column, volume: Column, document: Column, url: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), head, F.lit(" ("), volume, F.lit(", "), document, F.lit(") "), url)  # SC-14


def shifted_year(date: Column, years: int) -> Column:
    """The ISO date with its year moved; null if it isn't one (SC-15)."""
    year = F.try_to_number(F.substring(date, 1, 4), F.lit("9999"))
    return F.when(iso_date(date).isNotNull(), F.concat(F.lpad((year + years).cast("int").cast("string"), 4, "0"), F.substring(date, 5, 6)))


def truncated(c: Column, n: int, mark: str = "") -> Column:
    """At most n characters, with a mark if some are left out (SC-16)."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def blocks(parts: Column, rule: str = "\n\n---\n\n") -> Column:
    return F.array_join(parts, rule)  # SC-17


def named_actors(c: Column) -> Column:
    """Different persons named with a title (SC-18)."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b((?:Mr|Dr|Sir|President|Secretary|Ambassador)\.? [A-Z][a-z]{3,})"), F.lit(1)))


def judged_score(c: Column) -> Column:
    """The score in a judge's JSON, or in what looks like it, within [0, 1]; null if there is none (SC-19)."""
    parsed = F.from_json(c, "score double")["score"]
    loose = F.regexp_extract(c, r"\"?score\"?\s*[:=]\s*(-?\d+(?:\.\d+)?)", 1)
    score = F.coalesce(parsed, F.when(loose != "", loose).try_cast("double"))
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def mentions_document(c: Column, number: Column) -> Column:
    return F.regexp_like(c, F.concat(F.lit(r"\b(Document|Doc\.?)\s+"), number.cast("string"), F.lit(r"\b")))  # SC-21


def iso_date(c: Column) -> Column:
    """The text if it has the shape of an ISO date, else null (F-17)."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)


def safe_identifier(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9\-._]+$")  # F-7


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)  # SC-20


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))  # SC-20
