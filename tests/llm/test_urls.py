import hashlib
import math
import re
from collections import defaultdict

from corpusloom.llm import urls

SCHEMA = "page_id long, url string, host string, score double, gram string, n int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", 0.5, "g", 1) for i, u in rows], SCHEMA)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


ROWS = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/1?x=/fr/", "http://example.com/en/", "http://a.b.net/es/x#y", "http://net/fr/", "http://x.net/de/", "ftp://com/", "http://com", "http://xcom/a", "http://É.org/ü", "a://b://c/d", "http://ex.com?x", "http://user@Q.com:80/p"]


def test_hosts_paths_and_rules(spark):
    rows = [(k, u) for k, u in enumerate(ROWS)] + [(None, "http://a.com/"), (3, "http://a.com/")]
    out = urls.filter_urls(pages(spark, rows)).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in out), key=repr)
    assert got == sorted(((i, *split(u), rule(*split(u))[0]) for i, u in rows), key=repr)
    assert all(r.verdict == (rule(r.host, r.path)[1] or r.verdict) and r.verdict in ("allow", "block") for r in out)
    assert urls.filter_urls(pages(spark, [])).count() == 0


def test_one_kind_of_training_url(spark):
    out = urls.filter_urls(pages(spark, [(1, "http://a.com/"), (2, "http://b.org/")])).collect()
    assert {(r.score, r.threshold, r.verdict) for r in out} == {(0.0, 0.0, "allow")}


def test_scores_against_brute_force(spark, data):
    """Witten-Bell models of the rule-judged urls outside the held-out fold, counted in plain Python."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    out = urls.filter_urls(df)
    sites = out.join(df, "page_id").select(F.lower("url").alias("site"), "url", "rule", "verdict", "score").collect()
    fold = lambda u: int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % urls.FOLDS
    order, pad = urls.ORDER, urls.PAD
    counts = {k: [defaultdict(int) for _ in range(order + 1)] for k in ("allow", "block")}
    for r in sites:
        if r.rule and fold(r.url):
            t = pad * order + r.site
            for i in range(order, len(t)):
                for k in range(order + 1):
                    counts[r.verdict][k][t[i - k : i + 1]] += 1

    totals = {v: [(defaultdict(int), defaultdict(int)) for _ in range(order + 1)] for v in counts}
    for v, levels in counts.items():
        for k, level in enumerate(levels):
            for g, n in level.items():
                totals[v][k][0][g[:-1]] += n
                totals[v][k][1][g[:-1]] += 1

    def p(v, gram):
        out = 1 / 256
        for k in range(order + 1):
            g = gram[len(gram) - 1 - k :]
            n, t = totals[v][k][0][g[:-1]], totals[v][k][1][g[:-1]]
            if n:
                out = (counts[v][k][g] + t * out) / (n + t)
        return out

    for r in sites:
        t = pad * order + r.site
        s = sum(math.log(p("allow", t[i - order : i + 1])) - math.log(p("block", t[i - order : i + 1])) for i in range(order, len(t))) / max(1, len(r.site))
        assert abs(s - r.score) < 1e-6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_threshold_is_the_best(spark):
    rows = [(0.5, "allow", 3), (0.2, "allow", 1), (0.1, "block", 2), (-0.3, "block", 5), (-0.4, "allow", 1)]
    t = urls.threshold(spark.createDataFrame(rows, "score double, by_rule string, n long")).first()[0]
    rate = lambda x: sum(n for s, k, n in rows if k == "allow" and s >= x) / 5 + sum(n for s, k, n in rows if k == "block" and s < x) / 7
    assert abs(rate(t - 1e-9) - max(rate(x / 100) for x in range(-60, 60))) < 1e-9


def test_against_sql(spark, data, tmp_path):
    from tests import oracle

    oracle.same(urls.op2(spark, data), oracle.connect(data), urls.SQL)
    c = oracle.connect(data)
    c.execute("CREATE OR REPLACE VIEW pages AS SELECT * FROM (VALUES " + ", ".join(f"({k}, {'NULL' if u is None else chr(39) + u + chr(39)})" for k, u in enumerate(ROWS * 3)) + ") t(page_id, url)")
    oracle.same(urls.filter_urls(pages(spark, list(enumerate(ROWS * 3)))), c, urls.SQL)


def test_grams_of_long_urls(spark):
    """Segments lose and double nothing, whatever the length; time grows with it."""
    import time

    texts = ["", "a", "abcd", *("".join(chr(97 + (k * k + n) % 26) for k in range(n)) for n in (59, 60, 61, 63, 64, 65, 128, 200)), "é漢🙂" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = sorted(map(tuple, urls._grams(df, "t", 4).collect()))
    assert got == sorted((k, (urls.PAD * 4 + t)[i : i + 5]) for k, t in enumerate(texts) for i in range(len(t)))
    took = []
    for n in (100_000, 400_000):
        long = spark.createDataFrame([(1, "abcdefghij" * (n // 10))], "id int, t string")
        began = time.time()
        assert urls._grams(long, "t", 4).count() == n
        took.append(time.time() - began)
    assert took[1] < 20 * max(took[0], 0.5)
