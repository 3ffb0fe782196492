"""Operator 11 against all pairs: random and clustered vectors, hot labels and copies, odd rows; bounds and tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import negatives as g

SCHEMA = "vec_id long, embedding array<float>, label int, uid long, raw string, leaf int, block int, score double, b int, own string, `a.b` int, low int, anchor string"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, y, 1, "r", 2, 3, 0.5, 4, "o", 5, 6, "an") for i, v, y in rows], SCHEMA.replace("array<float>", f"array<{kind}>"))


def usable(rows, kind=np.float32):
    out = []
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(float(kind(x)) * 256) for x in v]
            if all(abs(float(kind(x)) * 256) < g.MOST for x in v):
                out.append((i, q, y))
    return out


def expected(rows, every=50, kind=np.float32):
    rows = usable(rows, kind)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, v, y) in enumerate(rows):
        if i % every:
            continue
        others = [(-dot(v, w), j, z) for n, (j, w, z) in enumerate(rows) if n != k]
        for ps, p, _ in sorted(x for x in others if x[2] == y)[:5]:
            fits = sorted((ns, n) for ns, n, z in others if z != y and 50 * -ps <= 100 * -ns <= 95 * -ps)[:3]
            out += [(i, p, r, n, -ps, -ns) for r, (ns, n) in enumerate(fits, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def made(n, dim, seed, clusters=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(1, clusters), dim))
    x = r.standard_normal((n, dim)) * (0.2 if clusters else 1) + (centres[r.integers(0, clusters, n)] if clusters else 0)
    return [(int(k), [float(c) for c in np.float32(v)], int(r.integers(0, 4))) for k, v in enumerate(x)]


@pytest.fixture(params=["small", "as built"])
def sizes(request, monkeypatch):
    if request.param == "small":
        for name, value in (("SAMPLE", 60), ("LEAVES", 8), ("LEAF_ROWS", 40), ("BLOCK", 30), ("QUERIES", 3), ("BUCKET", 4)):
            monkeypatch.setattr(g, name, value)


@pytest.mark.parametrize("clusters", [0, 5])
def test_against_all_pairs(spark, sizes, clusters):
    rows = made(700, 6, 1, clusters)
    assert found(g.hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0)) == expected(rows, 20)


def test_hot_label_and_copies(spark, sizes):
    rows = made(300, 4, 2, 3)
    rows += [(1000 + k, rows[0][1], k % 2) for k in range(150)] + [(2000 + k, [0.0] * 4, 1) for k in range(30)] + [(k, v, 3) for k, v, _ in rows[:40]] + rows[:10]
    assert found(g.hard_negatives(frame(spark, rows), F.col("vec_id") % 25 == 0)) == expected(rows, 25)


def test_odd_rows(spark, sizes):
    rows = made(200, 5, 3) + [
        (None, [1.0] * 5, 1), (400, None, 1), (450, [1.0, None, 0.0, 0.0, 0.0], 1), (500, [math.nan] * 5, 1), (550, [math.inf] * 5, 1), (600, [1.0] * 5, None), (650, [], 1), (700, [2.0], 2), (750, [1.0] * 9, 2),
        (800, [1e30] * 5, 1), (-50, [0.5] * 5, 1), (850, [0.0] * 5, 0), (851, [1e5] * 5, 0), (900, [1e5] * 5, 0), (901, [9e4] * 5, 1),
    ]
    assert found(g.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)) == expected(rows)


def test_doubles_and_long_scores(spark, sizes):
    rows = [(k, [(k * 7919 % 97) * 5000.0 + 0.3, (k * 104729 % 89) * 5000.7], k % 3) for k in range(200)]
    assert found(g.hard_negatives(frame(spark, rows, "double"), F.col("vec_id") % 10 == 0)) == expected(rows, 10, float)


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 2.0], 1)], [(51, [1.0, 2.0], 1), (52, [1.0, 2.0], 2)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, None, None)]])
def test_few_rows(spark, rows):
    assert found(g.hard_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)) == expected(rows)


def test_bounds_hold_and_prune():
    """No score lies outside its bucket's bounds, and clustered rows let whole buckets be left out."""
    r = np.random.default_rng(4)
    x = np.floor((r.standard_normal((2000, 16)) * 0.2 + r.standard_normal((20, 16))[r.integers(0, 20, 2000)]) * 256).astype(np.int64)
    norms = (x * x).sum(axis=1)
    points = g.augmented(x, norms, int(norms.max()))
    tree = g.Tree(points, 6)
    least, most = g.Bounds(points[tree.vantage], tree.ranges, int(norms.max()))(x[:50])
    out = 0
    for k, (s, e) in enumerate(tree.leaves):
        got = g.scores(x[:50], x[tree.order[s:e]])
        assert (got >= least[:, [k]]).all() and (got <= most[:, [k]]).all()
        out += (most[:, k] < np.sort(g.scores(x[:50], x), axis=1)[:, -5]).sum()
    assert sorted(tree.order) == list(range(2000)) and out > 0.5 * 50 * len(tree.leaves)


def test_given_rows(spark, data):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(g.op11(spark, data)) == expected(rows)
