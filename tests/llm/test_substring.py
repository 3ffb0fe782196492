import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import substring
from tests.llm import data


def brute(rows, width=20):
    """rows: (doc_id, text), ordered as documents are."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            w = tuple(words[s : s + width])
            if w in seen:
                gone[s : s + width] = [True] * width
            seen.add(w)
        left = [w for w, g in zip(words, gone) if not g]
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest(), " ".join(left)))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    passages = [data.prose(r.randrange(18, 60), seed * 100 + k, 50) for k in range(5)]
    rows = []
    for k in range(n):
        parts = [data.prose(r.randrange(0, 30), seed * 1000 + k) for _ in range(3)]
        rows.append((k, " ".join(x for p in parts for x in (p, r.choice(passages) if r.random() < 0.5 else "") if x)))
    return rows + [(n, "a " * 90), (n + 1, "b a " * 40)]


@pytest.mark.parametrize("seed,group", [(1, substring.GROUP), (2, 3), (3, 1), (4, 20)])
def test_against_all_windows(spark, seed, group):
    """Small groups send prefixes to 4, 6 and 20 words."""
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.analyse(df, group).collect())) == sorted(r[:4] for r in brute(rows))


def test_edge_rows(spark):
    rows = [r for r in data.texts() if r[0] not in (13, None)]
    out = substring.analyse(data.docs(spark, rows)).collect()
    assert sorted(map(tuple, out)) == sorted(r[:4] for r in brute([r[:2] for r in rows]))
    assert substring.analyse(data.empty(spark)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    passage = data.prose(30, 9)
    rows = [(1, passage, "", ""), (1, passage, "", ""), (2, "x " + passage, "", ""), (None, passage + " y", "", ""), (None, passage + " y", "", "")]
    out = sorted((r.doc_id or 99, r.n_removed) for r in substring.analyse(data.docs(spark, rows)).collect())
    assert out == [(1, 0), (1, 0), (2, 30), (99, 30), (99, 30)]


def test_hot_passage(spark):
    passage = data.prose(60, 5)
    rows = [(k, f"{data.prose(5, k)} {passage}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    assert sorted(map(tuple, substring.analyse(df, 50).collect())) == sorted(r[:4] for r in brute(rows))


def test_remove_repeats(spark):
    rows = corpus(7)
    df = data.docs(spark, [(i, t, "en", "s") for i, t in rows])
    out = substring.remove_repeats(df)
    assert out.columns == df.columns
    wanted = {i: (t if not gone else left) for (i, t), (_, _, gone, _, left) in zip(rows, brute(rows))}
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {i: (t, len(t)) for i, t in wanted.items()}


def test_nodes_against_a_brute_force_tree():
    """Deep nodes, and the depth to which each leaf repeats an earlier one."""
    r = random.Random(3)
    for _ in range(60):
        letters, width = r.choice([2, 3, 6]), r.randrange(1, 6)
        texts = [[r.randrange(letters) for _ in range(r.randrange(1, 30))] for _ in range(r.randrange(1, 6))]
        ids, start, past = [], [], []
        for t in texts:
            start += range(len(ids), len(ids) + len(t))
            past += [len(ids) + len(t)] * len(t)
            ids += t
        suffixes = [tuple(ids[s:e]) for s, e in zip(start, past)]
        order, common = substring.sorted_suffixes(np.array(ids), np.array(start), np.array(past))
        assert [suffixes[k] for k in order] == sorted(suffixes)
        tree = {}  # each prefix: the leaves below it
        for k, s in enumerate(suffixes):
            for n in range(1, len(s) + 1):
                tree.setdefault(s[:n], set()).add(k)
        branching = {p: leaves for p, leaves in tree.items() if len(p) >= width and len(leaves) > 1 and not any(len(q) == len(p) + 1 and q[:-1] == p and len(tree[q]) == len(leaves) for q in tree)}
        got = {(depth, frozenset(order[a:b].tolist())) for depth, firsts, pasts in substring.deep_nodes(common, width) for a, b in zip(firsts, pasts)}
        assert got == {(len(p), frozenset(leaves)) for p, leaves in branching.items()}
        place = [r.randrange(10**6) for _ in start]
        depth = substring.repeated_depth(common, np.array(place)[order], width)
        for leaf, d in zip(order, depth):
            assert d == max((len(p) for p, leaves in tree.items() if len(p) >= width and leaf in leaves and min(place[k] for k in leaves) != place[leaf]), default=0)


def test_gram_totals():
    """Whatever the batches: positions whose gram comes twice, grams that come too often."""
    r = random.Random(5)
    rows = sorted((0, g, r.randrange(9), r.randrange(9), r.choice([1, 1, 2])) for g in (r.randrange(40) for _ in range(90)))
    rows += sorted((1, r.randrange(40), r.randrange(9), r.randrange(9), 0) for _ in range(20))
    total = {}
    for _, g, *_, n in rows:
        total[g] = total.get(g, 0) + n
    rows.sort(key=lambda x: (x[4] > 0, x[1]))
    for size in (1, 2, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[at : at + size]], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int64()))], ["gram", "did", "pos", "n"]) for at in range(0, len(rows), size)]
        out = [r for b in substring._repeated(3)(iter(batches)) for r in b.to_pylist()]
        assert sorted((x["did"], x["pos"]) for x in out if x["gram"] is None) == sorted((d, p) for _, g, d, p, n in rows if n == 0 or total[g] > 1)
        assert sorted((x["gram"], x["n"]) for x in out if x["gram"] is not None) == sorted((g, n) for g, n in total.items() if n > 3)


@pytest.mark.parametrize("group,heavy,known", [(3, 1000, 1000), (1, 1000, 0), (50, 2, 1000), (20, 2, 3), (20_000, 5, 0)])
def test_prefixes_over_a_group(spark, group, heavy, known):
    """Prefixes known to be heavy come as windows; those found to be over a group come again as windows."""
    rows = corpus(11, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring.analyse(df, group, heavy, known).collect())) == sorted(r[:4] for r in brute(rows))


def test_groups_hold_whole_prefixes():
    r = random.Random(8)
    for _ in range(200):
        keys = sorted(k for k in range(r.randrange(1, 9)) for _ in range(r.choice([1, 1, 2, 3, 9])))
        cuts = sorted(r.randrange(len(keys) + 1) for _ in range(r.randrange(5)))
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[s:e], pa.int64())], ["key"]) for s, e in zip([0, *cuts], [*cuts, len(keys)])]
        group = r.randrange(1, 7)
        whole, over = [], []
        for part, large in substring._in_groups(iter(batches), group):
            got = part.column("key").to_pylist()
            (over if large else whole).append(got)
            assert large or len(got) <= group or len(set(got)) == 1
        assert sorted(k for x in whole + over for k in x) == keys
        assert {k for x in over for k in x} == {k for k in keys if keys.count(k) > group}
        assert sum(len(set(x)) for x in whole) == len({k for x in whole for k in x})
