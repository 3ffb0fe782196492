import hashlib
from collections import Counter

import numpy as np

from corpusloom.llm import cws
from tests.llm import data


def jaccard(a, b):
    a, b = (Counter(x.encode().lower().split()) for x in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_rows(spark):
    rows = [r for r in data.texts() if r[0] is not None and r[0] != 13]
    out = {r.doc_id: r for r in cws.fingerprints(data.docs(spark, rows).repartition(5)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + n[:third]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        parts = lambda f: np.array([f[4 * j : 4 * j + 4] for j in range(128)])
        assert r.near_edited == (parts(r.fingerprint) == parts(r.edited_fingerprint)).mean()
        assert r.near_next == (parts(r.fingerprint) == parts(out[order[(k + 1) % len(order)][0]].fingerprint)).mean()
    assert out[5].fingerprint == out[6].fingerprint == out[7].fingerprint == "0" * 512
    assert out[0].fingerprint == out[1].fingerprint


def test_collisions_estimate_generalised_jaccard():
    pairs = [(data.prose(200, k, 80), " ".join([*data.prose(200, k, 80).split()[: 40 * (k % 5 + 1)], *data.prose(100, k + 50, 80).split()])) for k in range(60)]
    sig = cws.signatures([x.encode() for p in pairs for x in p])
    error = [(sig[2 * k] == sig[2 * k + 1]).mean() - jaccard(*p) for k, p in enumerate(pairs)]
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_blocks_of_terms_agree(monkeypatch):
    texts = [data.prose(3000, k, 10**6).encode() for k in range(3)]
    whole = cws.signatures(texts)
    monkeypatch.setattr(cws, "BLOCK", 700)
    assert (cws.signatures(texts) == whole).all()


def test_odd_tables(spark):
    assert cws.fingerprints(data.empty(spark)).count() == 0
    one = cws.fingerprints(data.docs(spark, [(3, "abcdef", "", "")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    twice = cws.fingerprints(data.docs(spark, [(1, "b b", "", ""), (1, "a a a", "", ""), (None, "z", "", "")])).collect()
    assert len(twice) == 3 and {r.edited_sha256 for r in twice} == {hashlib.sha256(x).hexdigest() for x in (b"z", b"a a z", b"b a")}
