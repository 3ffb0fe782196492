"""Operator 2, URL filters: host and path rules, and a character language-model ratio for the rest.

The urls that a rule judges train two character models, one of accepted and one of
rejected urls: variable-order Markov models up to order 4 with Witten-Bell smoothing,
P_k(c | context) = (n(context c) + types(context) P_k-1(c | shorter context)) /
(n(context) + types(context)), down to an even distribution over 256 characters. They read
whole urls, A-Z lower-cased. Counts are of all the training urls' grams and grow with them. A url's
score is the difference of its log-likelihoods divided by its number of characters. The threshold
is calibrated on a fifth of the rule-judged urls (by an MD5 of the url) that train nothing: the
score, in steps of 0.01, of best balanced accuracy; 0 if they are all of one kind.

All of it is DataFrame expressions. Different urls get a number each; a url becomes grams of five
characters, padded at its start, by way of segments of 64 characters that overlap by four, so the work grows
with its length; grams are counted per class with partial sums before the shuffle; lower orders'
counts are sums of these. Each different gram is scored once, and urls' numbers are joined with
their grams' scores by an equi-join that adaptive execution may split; equal urls are
scored once. What the driver's plan broadcasts is one row: the threshold.

Edge cases: a null url is empty; an empty one has empty host and path, fits no rule and scores 0; one without
"://" has empty host and path, fits no rule and is scored like others; all are judged by the threshold; a url may be as long as a
row; rows repeat as they are, with a null page_id too; an empty table gives an empty
result; other columns are ignored; with no rejected or no accepted training urls all
scores are 0 and the threshold is 0, so the verdict is allow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, UPPER, keep, table

#: verdict, host, path. Fixed values.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

ORDER = 4
PAD = "\x02"
FOLDS = 5
STEP = 0.01
SEGMENT = 64


def split(url: str = "url") -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    plain = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substr(plain, F.length(host) + 1)


def judged(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule (null if none fits) and its verdict; the longest rule wins."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
    chain = lambda pick: reduce(lambda c, r: c.when(fits(r[1], r[2]), F.lit(pick(r))), ordered, F.when(F.lit(False), F.lit(None).cast("string")))
    return urls.withColumn("rule", chain(lambda r: r[1] + r[2])).withColumn("by_rule", chain(lambda r: r[0]))


def _grams(df: DataFrame, text: str, order: int) -> DataFrame:
    """A row for each character of `text`, with the `order` characters before it: gram, beside the other columns."""
    padded = F.concat(F.lit(PAD * order), F.col(text))
    cut = F.regexp_extract_all(padded, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))
    joined = F.transform("cut", lambda x, k: F.when(k > 0, F.concat(F.right(F.get("cut", k - 1), F.lit(order)), x)).otherwise(x))
    others = [c for c in df.columns if c != text]
    pieces = df.where(F.length(text) > 0).select(*others, cut.alias("cut")).select(*others, F.explode(joined).alias("piece"))
    places = F.explode(F.sequence(F.lit(1), F.length("piece") - order))
    return pieces.where(F.length("piece") > order).select(*others, "piece", places.alias("place")).select(*others, F.substr("piece", F.col("place"), F.lit(order + 1)).alias("gram"))


def gram_scores(train: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """(gram, delta): log P(accepted) - log P(rejected) of each different gram in `wanted`.
    train: (gram, yes, no) counts."""
    known = wanted.join(train, "gram", "left").select("gram", F.coalesce("yes", F.lit(0)).cast("double").alias("yes"), F.coalesce("no", F.lit(0)).cast("double").alias("no"))
    lower = None
    for k in range(1, order + 2):  # the last k characters of a gram: its context of k - 1, and the character
        counts = train.groupBy(F.right("gram", F.lit(k)).alias("g")).agg(F.sum("yes").cast("double").alias("yes"), F.sum("no").cast("double").alias("no"))
        need = known.select(F.right("gram", F.lit(k)).alias("g")).distinct().join(counts, "g", "left")
        context = counts.groupBy(F.left("g", F.lit(k - 1)).alias("c")).agg(
            F.sum("yes").alias("yes_n"), F.sum("no").alias("no_n"), F.count_if(F.col("yes") > 0).cast("double").alias("yes_t"), F.count_if(F.col("no") > 0).cast("double").alias("no_t")
        )
        level = need.withColumn("c", F.left("g", F.lit(k - 1))).join(context, "c", "left")
        if lower is None:
            level = level.withColumn("p_yes", F.lit(1 / 256)).withColumn("p_no", F.lit(1 / 256))
        else:
            level = level.withColumn("s", F.right("g", F.lit(k - 1))).join(lower, "s")
        n = lambda c: F.coalesce(c, F.lit(0.0))
        p = lambda kind: F.when(n(F.col(f"{kind}_n")) == 0, F.col(f"p_{kind}")).otherwise((n(F.col(kind)) + F.col(f"{kind}_t") * F.col(f"p_{kind}")) / (F.col(f"{kind}_n") + F.col(f"{kind}_t")))
        lower = level.select(F.col("g").alias("s"), p("yes").alias("p_yes"), p("no").alias("p_no"))
        lower, _ = keep(lower, "order")
    return lower.select(F.col("s").alias("gram"), (F.ln("p_yes") - F.ln("p_no")).alias("delta"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """For each row of pages: page_id, host, path, rule, verdict, score, threshold."""
    host, path = split()
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = judged(pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path")), rules)
    sites = rows.groupBy("url").agg(F.count("*").alias("n"), F.first("by_rule").alias("by_rule"))  # the url tells the rule
    fold = F.conv(F.substring(F.md5(F.col("url").cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS
    sites, _ = keep(sites.select(F.monotonically_increasing_id().alias("id"), "url", F.translate("url", UPPER, LOWER).alias("text"), "n", "by_rule", fold.alias("fold")), "sites")
    train = _grams(sites.where("by_rule is not null and fold > 0").select("text", "n", "by_rule"), "text", order)
    train = train.groupBy("gram").agg(F.sum(F.when(F.col("by_rule") == "allow", F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("by_rule") == "block", F.col("n")).otherwise(0)).alias("no"))
    train, _ = keep(train, "train")
    both = train.agg(F.coalesce(F.sum("yes"), F.lit(0)), F.coalesce(F.sum("no"), F.lit(0))).first()
    known = sites.select("id", "n", "by_rule", "fold", F.length("text").alias("size"))
    if both[0] and both[1]:
        own, _ = keep(_grams(sites.select("id", "text"), "text", order).groupBy("id", "gram").agg(F.count("*").alias("times")), "grams")
        deltas = gram_scores(train, own.select("gram").distinct(), order)
        sums = own.join(deltas, "gram").groupBy("id").agg(F.sum(F.col("times") * F.col("delta")).alias("total"))
        scored = known.join(sums, "id", "left").withColumn("score", F.round(F.coalesce(F.col("total") / F.col("size"), F.lit(0.0)), 6))
    else:
        scored = known.withColumn("score", F.lit(0.0))
    scored, _ = keep(scored.select("id", "n", "by_rule", "fold", "score"), "scores")
    limit = threshold(scored.where("by_rule is not null and fold = 0"))
    by_url = sites.select("url", "id").join(scored.select("id", "score"), "id").drop("id")
    out = rows.join(by_url, "url").crossJoin(F.broadcast(limit))  # one row
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= F.col("threshold"), F.lit("allow")).otherwise(F.lit("block")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "threshold")


def threshold(held: DataFrame) -> DataFrame:
    """One row: the least step of best balanced accuracy on (score, by_rule, n), else 0."""
    steps = held.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(
        F.sum(F.when(F.col("by_rule") == "allow", F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("by_rule") == "block", F.col("n")).otherwise(0)).alias("no")
    )
    # scores lie within a few log units: some thousand steps at most, gathered in one array
    table_ = steps.agg(F.sort_array(F.collect_list(F.struct("step", "yes", "no"))).alias("steps"), F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
    whole = lambda c: c.cast("decimal(18,0)")  # noqa: E731  the rates are compared exactly, as whole numbers
    rate = lambda s: F.aggregate(
        "steps", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + F.when(x["step"] >= s["step"], whole(x["yes"]) * whole(F.col("all_no"))).otherwise(whole(x["no"]) * whole(F.col("all_yes")))).cast("decimal(38,0)")
    )
    rated = F.transform("steps", lambda s: F.struct(rate(s).alias("rate"), (-s["step"]).alias("down")))
    best = F.array_max(rated)
    return table_.select(F.when((F.col("all_yes") > 0) & (F.col("all_no") > 0), (-best["down"]).cast("double") * F.lit(STEP)).otherwise(F.lit(0.0)).alias("threshold"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql_level(k: int) -> str:
    """P_k of the wanted grams' last k characters, from P_k-1."""
    lower = f"JOIN p{k - 1} l ON l.g = right(w.g, {k - 1})" if k > 1 else "CROSS JOIN (SELECT CAST(1 AS DOUBLE) / 256 AS yes, CAST(1 AS DOUBLE) / 256 AS no) l"
    p = lambda kind: f"CASE WHEN coalesce(x.{kind}_n, 0) = 0 THEN l.{kind} ELSE (coalesce(c.{kind}, 0) + x.{kind}_t * l.{kind}) / (x.{kind}_n + x.{kind}_t) END AS {kind}"
    return f"""c{k} AS (SELECT right(g, {k}) AS g, CAST(sum(yes) AS DOUBLE) AS yes, CAST(sum(no) AS DOUBLE) AS no FROM train GROUP BY 1),
x{k} AS (SELECT left(g, {k - 1}) AS g, sum(yes) AS yes_n, sum(no) AS no_n, CAST(count(*) FILTER (WHERE yes > 0) AS DOUBLE) AS yes_t, CAST(count(*) FILTER (WHERE no > 0) AS DOUBLE) AS no_t FROM c{k} GROUP BY 1),
p{k} AS (SELECT w.g, {p('yes')}, {p('no')} FROM (SELECT DISTINCT right(g, {k}) AS g FROM own) w LEFT JOIN c{k} c ON c.g = w.g LEFT JOIN x{k} x ON x.g = left(w.g, {k - 1}) {lower})"""


_RULED = [("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow")]  # longest first
_SQL_RULE = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in _RULED) + " END"
_SQL_BY_RULE = "CASE " + " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in _RULED) + " END"
SQL = f"""WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
b AS (SELECT *, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM a),
d AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, substring(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM b),
e AS (SELECT *, {_SQL_RULE} AS rule FROM d), r AS (SELECT *, {_SQL_BY_RULE} AS by_rule FROM e),
u AS (SELECT url, translate(url, '{UPPER}', '{LOWER}') AS t, count(*) AS n, min(by_rule) AS by_rule, CAST(concat('0x', substring(md5(url), 1, 8)) AS BIGINT) % {FOLDS} AS fold FROM r GROUP BY url),
own AS (SELECT url, n, by_rule, fold, length(t) AS size, substring(concat(repeat(chr(2), {ORDER}), t), unnest(range(1, length(t) + 1)), {ORDER + 1}) AS g FROM u),
train AS (SELECT g, sum(CASE WHEN by_rule = 'allow' THEN n ELSE 0 END) AS yes, sum(CASE WHEN by_rule = 'block' THEN n ELSE 0 END) AS no FROM own WHERE by_rule IS NOT NULL AND fold > 0 GROUP BY g),
{", ".join(_sql_level(k) for k in range(1, ORDER + 2))},
trained AS (SELECT coalesce(sum(yes), 0) > 0 AND coalesce(sum(no), 0) > 0 AS ok FROM train),
s AS (SELECT url, round(sum(ln(p.yes) - ln(p.no)) / any_value(size), 6) AS score FROM own JOIN p{ORDER + 1} p USING (g) GROUP BY url),
z AS (SELECT u.url, n, by_rule, fold, CASE WHEN ok THEN coalesce(score, 0) ELSE 0 END AS score FROM u LEFT JOIN s USING (url) CROSS JOIN trained),
h AS (SELECT CAST(floor(score / CAST({STEP} AS DOUBLE)) AS BIGINT) AS step, sum(CASE WHEN by_rule = 'allow' THEN n ELSE 0 END) AS yes, sum(CASE WHEN by_rule = 'block' THEN n ELSE 0 END) AS no FROM z WHERE by_rule IS NOT NULL AND fold = 0 GROUP BY 1),
t AS (SELECT a.step, sum(CASE WHEN b.step >= a.step THEN b.yes ELSE 0 END) * (SELECT sum(no) FROM h) + sum(CASE WHEN b.step < a.step THEN b.no ELSE 0 END) * (SELECT sum(yes) FROM h) AS rate FROM h a CROSS JOIN h b GROUP BY a.step),
l AS (SELECT CASE WHEN (SELECT coalesce(sum(yes), 0) > 0 AND coalesce(sum(no), 0) > 0 FROM h) THEN CAST((SELECT step FROM t ORDER BY rate DESC, step LIMIT 1) AS DOUBLE) * CAST({STEP} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS threshold)
SELECT CAST(page_id AS BIGINT) AS page_id, host, path, rule, coalesce(r.by_rule, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, CAST(score AS DOUBLE) AS score, threshold FROM r JOIN z USING (url) CROSS JOIN l"""
