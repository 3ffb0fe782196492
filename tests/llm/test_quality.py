import math

import numpy as np

from corpusloom.llm import quality
from tests.llm import data


def test_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (8, 0, 0), (8, 0, 1), (None, 1, 0), (9, None, 0), (99, 0, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    df = data.docs(spark)
    out = quality.classify(df, labels).collect()
    assert len(out) == len(data.texts()) and all(0 < r.posterior < 1 and r.keep is not None for r in out)
    assert quality.kept(df, labels).columns == df.columns
    none = quality.classify(df, labels.where("false")).collect()
    assert all(r.keep and r.p_document == 0.5 for r in none)
    assert quality.classify(data.empty(spark), labels).count() == 0


def test_posteriors_against_brute_force(spark, data_dir=None):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = [(k, (data.prose(30, k) if k % 2 else "BUY!! NOW!! $$$ " * 9), f"l{k % 3}", f"s{k % 5 * (k % 2)}") for k in range(120)]
    out = {r.doc_id: r for r in quality.classify(data.docs(spark, rows), labels).collect()}
    p = {k: r.p_document for k, r in out.items()}
    mean = np.mean(list(p.values()))

    def groups(key):
        g = {}
        for k, _, lang, src in rows:
            g.setdefault(key(lang, src), []).append(p[k])
        return g

    def pseudo(g, centre, m):
        n = np.array([len(x) for x in g.values()], float)
        s = np.array([sum(x) for x in g.values()])
        c, mm = np.array([centre(k) for k in g]), np.array([m(k) for k in g])
        var = (n * mm * (1 - mm)).sum() / n.sum()
        spread = ((n * (s / n - c) ** 2).sum() - (len(g) - 1) * var) / max(1e-9, n.sum() - (n * n).sum() / n.sum())
        return min(1e6, max(1.0, var / spread - 1)) if spread > 0 else 1e6

    hosts, paths = groups(lambda lang, s: s), groups(lambda lang, s: (s, lang))
    k1 = pseudo(hosts, lambda h: mean, lambda h: mean)
    hp = {h: (sum(x) + k1 * mean) / (len(x) + k1) for h, x in hosts.items()}
    k2 = pseudo(paths, lambda q: hp[q[0]], lambda q: hp[q[0]])
    logit = lambda x: math.log(x / (1 - x))
    for k, _, lang, src in rows:
        x = paths[src, lang]
        rest = min(1 - 1e-9, max(1e-9, (sum(x) - p[k] + k2 * hp[src]) / (len(x) - 1 + k2)))
        odds = logit(p[k]) + logit(rest) - logit(mean)
        assert abs(out[k].host_posterior - hp[src]) < 1e-9 and abs(logit(out[k].posterior) - odds) < 1e-6 and out[k].keep == (round(odds, 9) >= 0)


def test_held_out_accuracy(spark, data_dir="/root/testdata/sf0.01"):
    import os

    import pytest

    if not os.path.isdir(data_dir):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in out) >= 0.97 * len(out)
    assert sum(r.keep for r in out if r.quality == 1) >= 0.98 * sum(r.quality == 1 for r in out)


def test_the_sample_is_bounded(spark, monkeypatch):
    """More labels than the sample, and a labelled id that a third of all rows share."""
    rows = [(k if k % 3 else 3, (data.prose(30, k) if k % 2 else "BUY!! NOW!! $$$ " * 9), "en", "s") for k in range(600)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(600)], "doc_id long, quality int, toxic int")
    sizes = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: sizes.append(len(x)) or fit(x, y))
    out = quality.classify(data.docs(spark, rows), labels, sample=100).collect()
    assert len(out) == 600 and 40 <= sizes[0] <= 100
    weights = [quality.train(data.docs(spark, rows).repartition(n), labels, 100) for n in (1, 7)]
    assert np.allclose(*weights)


def test_kept_agrees_with_classify(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = [(k, (data.prose(30, k) if k % 2 else "BUY!! NOW!! $$$ " * 9), f"l{k % 3}", f"s{k % 5}") for k in range(120)] + [(None, data.prose(30, 500), None, None), (7, None, "l1", "s2"), (7, "", "l1", "s2")]
    df = data.docs(spark, rows)
    kept = quality.kept(df, labels)
    assert kept.schema == df.schema
    wanted = sorted(repr(r.doc_id) for r in quality.classify(df, labels).collect() if r.keep)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == wanted and 0 < len(wanted) < len(rows)
    assert "SortMergeJoin" not in quality.kept(df, labels)._jdf.queryExecution().executedPlan().toString()
