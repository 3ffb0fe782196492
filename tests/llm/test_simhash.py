import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import components, simhash
from tests.llm import data


def brute(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, edges):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \t\n\x0b\x1cé漢Z ", max_size=60))
def test_fingerprint(text):
    assert int.from_bytes(simhash.simhash(text.encode()), "big") == brute(text)


def test_edge_rows(spark):
    rows = [r for r in data.texts() if r[0] != 12]
    out = simhash.near_duplicates(data.docs(spark, rows)).collect()
    fps = [brute(r[1]) for r in rows]
    root = reach(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {}
    for r, c in zip(rows, root):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    wanted = sorted(map(repr, ((r[0], f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, root))))
    assert sorted(map(repr, map(tuple, out))) == wanted
    assert simhash.near_duplicates(data.empty(spark)).count() == 0


def test_long_text(spark):
    text = data.prose(60_000, 4, 10**9)
    assert int.from_bytes(simhash.simhash(text.encode()), "big") == brute(text)


@pytest.mark.parametrize("n,flips", [(3000, 1), (600, 3)])
def test_crowded_cells(spark, n, flips):
    """Dense balls of fingerprints: the links' closure is that of all pairs, with far fewer links."""
    import random

    r = random.Random(n)
    fps = set()
    while len(fps) < n:
        f = 0x0123456789ABCDEF if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randrange(flips + 2)):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    fps = sorted(fps)[:400] + sorted(fps)[-200:]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    at = {x: k for k, x in enumerate(signed)}
    got = reach(len(fps), [(at[e.a], at[e.b]) for e in links])
    assert got == reach(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert len(links) <= 66 * len(fps)


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(5, 5), (7, 3), (3, 7), (9, 8)], []])
def test_components(spark, edges):
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = reach(61, edges)
    assert got == {k: root[k] for e in edges if e[0] != e[1] for k in e}


def test_one_of_each(spark):
    rows = [r for r in data.texts() if r[0] not in (12,)]
    df = data.docs(spark, rows)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r[1] for r in rows} - {None, " \t\n\x0b\x0c\r "}) - len([1 for a in [0] if simhash.near_duplicates(df).where("doc_id = 2").first().component_id == 0])
    assert {r.doc_id for r in kept.where(F.col("text").isNull() | (F.trim("text") == "")).collect()} <= {5}
