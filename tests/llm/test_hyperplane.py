import math

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import hyperplane
from tests.llm.test_simhash import reach

SCHEMA = "vec_id long, embedding array<float>, rep long, n int, sig string, raw string"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "s", "r") for i, v in vectors], schema)


def clusters(n, seed, dim=16, noise=0.05):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 10 + 1, dim))
    return [(k, (centres[r.integers(len(centres))] + noise * r.standard_normal(dim)).astype(np.float32)) for k in range(n)]


def brute(vectors):
    x = np.array([v for _, v in vectors], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= hyperplane.LIMIT
    np.fill_diagonal(link, False)
    root = reach(len(x), list(zip(*np.nonzero(link))))
    return link, root


@pytest.mark.parametrize("block", [2048, 7])
def test_recall_and_exactness(spark, block):
    vectors = clusters(600, 3)
    vectors += [(600 + k, vectors[0][1]) for k in range(50)]
    out = {r.vec_id: r for r in hyperplane.near_duplicates(frame(spark, vectors), block=block).collect()}
    link, root = brute(vectors)
    found, true = sum(r.n_links for r in out.values()), link.sum()
    assert found >= 0.9 * true and all(out[i].n_links <= link[i].sum() for i, _ in vectors)
    if found == true:
        assert all(out[i].component_id == root[i] and out[i].kept == (root[i] == i) for i, _ in vectors)


def test_blocks_change_nothing(spark):
    vectors = clusters(300, 5, noise=0.02)
    one, many = (sorted(map(tuple, hyperplane.near_duplicates(frame(spark, vectors), block=b).collect())) for b in (10_000, 5))
    assert one == many


def test_edge_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, [0, 0, 0]), (5, [math.nan, 1, 1]), (6, [math.inf, 1, 1]), (7, [None, 2, 3]), (8, []), (None, v), (9, [2.0, 4.0, 6.0]), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0])]
    out = sorted(map(tuple, hyperplane.near_duplicates(frame(spark, rows)).collect()), key=repr)
    lone = lambda i: (i, 0, i, True)
    wanted = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (9, 2, 1, False), lone(None), *map(lone, (3, 4, 5, 6, 7, 8, 10, 11))]
    assert out == sorted(wanted, key=repr)
    assert hyperplane.near_duplicates(frame(spark, [])).count() == 0


def test_double_vectors(spark):
    out = hyperplane.near_duplicates(frame(spark, clusters(50, 1), SCHEMA.replace("array<float>", "array<double>")))
    assert out.count() == 50


def test_plan_reaches_the_recall():
    for n in (0, 1, 100, 10**6, 10**9):
        bits, tables = hyperplane.plan(n)
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= 0.97


@pytest.mark.parametrize("lo,hi", [(0, 0), (0, 1)])
def test_members_are_those_with_a_near_sketch(lo, hi):
    r = np.random.default_rng(4)
    n = 700
    s = r.integers(-(2**63), 2**63, (n, 2))
    s[1::3] = s[: len(s[1::3])] ^ (1 << r.integers(0, 60, (len(s[1::3]), 2)))  # two signs from another
    own = r.integers(0, 2, n) if hi else np.zeros(n, int)
    cols = {"tab": np.zeros(n, np.int32), "sig": np.full(n, 5, np.int32), "lo": np.full(n, lo, np.int32), "hi": np.full(n, hi, np.int32), "own": own.astype(np.int32), "rep": np.arange(n), "s1": s[:, 0], "s2": s[:, 1]}
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in cols.values()], list(cols))
    got = {k for b in hyperplane._members(4)(iter([batch.slice(0, 300), batch.slice(300)])) for k in b.column("rep").to_pylist()}
    bits = np.unpackbits(s.view(np.uint8).reshape(n, 16), axis=1).astype(int)
    near = (bits[:, None, :] != bits[None, :, :]).sum(axis=2) <= 4
    np.fill_diagonal(near, False)
    if hi:
        near &= own[:, None] != own[None, :]
    assert got == set(np.flatnonzero(near.any(axis=1)).tolist()) and 0 < len(got) < n


def test_sketches_lose_nothing_at_the_limit():
    """100,000 pairs at the limit itself differ in no more signs than pass."""
    r = np.random.default_rng(6)
    a = r.standard_normal((100_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = hyperplane.LIMIT * a + np.sqrt(1 - hyperplane.LIMIT**2) * b
    p = hyperplane.planes(64, hyperplane.SKETCH, hyperplane.SEED + 1)
    apart = ((a @ p > 0) != (c @ p > 0)).sum(axis=1)
    assert apart.max() <= hyperplane.near_signs(hyperplane.LIMIT) <= 45 and 11 < apart.mean() < 15
