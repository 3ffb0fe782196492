"""Operator 12: held-out accuracy on invented and on given texts, windows, weights of evidence, odd input."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import toxicity as t
from tests.llm import data as d

SCHEMA = "doc_id long, text string, y int, counts array<long>, part string, hash long, total double, mean double, top double, fits boolean"
BAD = ["grobnix", "murklet", "sploosh", "vandrak", "wurzelo"]


def sayings(n, seed):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mo") for b in ("ling", "ver", "sto", "pan") for c in ("", "ed", "er", "ion")]
    rows, labels = [], []
    for k in range(n):
        bad = r.random() < 0.3
        text = [r.choice(words) + r.choice(("", "", ",", ".")) for _ in range(r.randrange(20, 120))]
        if bad:
            for _ in range(max(2, len(text) // 25)):
                text.insert(r.randrange(len(text)), r.choice(BAD))
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, [1], "p", 2, 0.1, 0.2, 0.3, True) for r in rows], SCHEMA)
    return docs, spark.createDataFrame([(a, b, "x") for a, b in labels], "doc_id long, toxic int, part string")


def test_held_out(spark):
    rows, labels = sayings(1200, 1)
    got = t.score(*frames(spark, rows, labels)).toPandas()
    assert len(got) == len(rows) and got.columns.tolist() == ["doc_id", "held_out", "score", "predicted"]
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in got.doc_id]).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    truth = dict(labels)
    held = got[got.held_out]
    assert np.mean([truth[k] == p for k, p in zip(held.doc_id, held.predicted, strict=True)]) > 0.93


def test_held_out_labels_are_never_learnt(spark):
    rows, labels = sayings(400, 2)
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    one, two = (t.score(*frames(spark, rows, x)).toPandas().sort_values("doc_id") for x in (labels, turned))
    assert (one.score.to_numpy() == two.score.to_numpy()).all()


@pytest.mark.parametrize("text", [b"", b" \t\n", b"one", b"one two three four five six seven eight nine ten", b"x" * 5000, b"a " * 3000, b"a " + b"y" * 1000 + b" b c"])
def test_windows_cover_all_words(text):
    x = np.frombuffer(text, np.uint8)
    at, size = t.windows(x)
    assert (size <= t.LONGEST).all() and (size > 0).all() and (at + size <= len(x)).all()
    covered = np.zeros(len(x), bool)
    for a, n in zip(at, size, strict=True):
        covered[a : a + n] = True
    assert covered[~np.isin(x, [32, 9, 10, 11, 12, 13])].all()


def test_counts_do_not_depend_on_neighbours(monkeypatch):
    distance = t.dictionaries([f"murklet grobnix tale {k}" for k in range(60)], [f"quiet evening tale {k}" for k in range(60)])
    texts = [b"a quiet evening", b"murklet " * 2000, b"", b"grobnix and murklet walk", b"y" * 40_000]
    one = distance.counts(pa.array(texts, pa.binary()))
    monkeypatch.setattr(t, "AT_ONCE", 7)
    assert (distance.counts(pa.array(texts, pa.binary()).slice(0)) == one).all()
    assert all((distance.counts(pa.array([x], pa.binary()))[0] == one[k]).all() for k, x in enumerate(texts))
    assert one[3, -t.LOW + 1 :].sum() == 1


def test_weights_rise_above_zero():
    r = np.random.default_rng(0)
    for _ in range(50):
        w = t._weights(r.integers(0, 50, (2, t.HIGH - t.LOW + 1)).astype(float))
        assert len(w) == t.HIGH - t.LOW + 1 and (np.diff(w[-t.LOW :]) >= -1e-12).all()


def test_odd_input(spark):
    docs = d.docs(spark)
    labels = spark.createDataFrame([(k, k % 2) for k in range(16)] + [(13, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = t.score(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or predicted is null or held_out is null").count() == 0
    assert t.score(docs, labels.where("toxic = 0")).where("score <> 0").count() == 0
    assert t.score(docs, labels.limit(0)).where("predicted = 0").count() == docs.count()
    assert t.score(d.empty(spark), labels).count() == 0


def test_given_rows(spark, data):
    got = t.op12(spark, data)
    assert got.count() == spark.read.parquet(f"{data}/documents.parquet").count()
