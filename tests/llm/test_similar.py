import random

import numpy as np
import pytest

from corpusloom.llm import similar
from tests.llm import data
from tests.llm.test_simhash import reach


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def sets(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_groups_against_all_pairs(spark):
    rows = []
    for base in range(25):
        text = data.prose(200 + 20 * base, base, 10**5)
        for k in range(6):
            rows.append((len(rows), edited(text, k * 2, len(rows))))
    rows += [(len(rows), data.prose(300, 900 + k, 10**5)) for k in range(40)]
    random.Random(1).shuffle(rows)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    root = reach(len(rows), links)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root[k], []).append(i)
    kept = {r.doc_id for r in similar.one_of_each(data.docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    wanted = {min(g) for g in groups.values()}
    assert wanted <= kept and len(kept - wanted) <= 0.03 * (len(rows) - len(wanted))


def test_hot_group_makes_few_candidates(spark):
    base = data.prose(400, 1, 10**5)
    rows = [(k, edited(base, 2, k)) for k in range(300)]
    df = data.docs(spark, [(i, t, "en", "s") for i, t in rows])
    assert similar.one_of_each(df).count() == 1
    nodes = spark.createDataFrame([(i, 0, len(s := similar.shingle_set(t.encode())), similar.bands([s])[0].view(np.int64).tolist()) for i, t in rows], "rid long, fp long, n long, bands array<long>")
    assert similar.candidates(nodes, 0.8).count() <= 2 * similar.BANDS * len(rows)


def test_star_of_copies(spark):
    """Copies that are each alike to the original but not to each other; blocks of any size find the same."""
    base = data.prose(204, 5, 10**5)
    rows = [(0, base)]
    for k in range(1, 150):
        four = edited(base, 4, k)
        rows.append((k, four if jaccard(base, four) >= 0.8 else edited(base, 3, k)))
    assert all(jaccard(base, t) >= 0.8 for _, t in rows)
    assert sum(jaccard(rows[k][1], rows[k + 1][1]) < 0.8 for k in range(1, 149)) > 100
    df = data.docs(spark, [(i, t, "en", "s") for i, t in rows])
    assert [r.doc_id for r in similar.one_of_each(df).collect()] == [0]


@pytest.mark.parametrize("block,size", [(similar.BLOCK, similar.TEXTS), (3000, similar.TEXTS), (similar.BLOCK, 17)])
def test_second_pass_against_all_pairs(spark, block, size):
    base = data.prose(150, 6, 10**5)
    texts = [base, *(edited(base, 1 + k % 5, k) for k in range(80)), *(edited(edited(base, 12, 0), 3, k) for k in range(40))]
    nodes = [(i, s) for i, t in enumerate(texts) for s in [similar.shingle_set(t.encode())]]
    total = sum(len(s) for _, s in nodes)
    keys = spark.createDataFrame([(i, len(s), 0, 7, total, len(nodes)) for i, s in nodes], "rid long, n long, band int, key long, total long, size long")
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in nodes], "rid long, shingles binary")
    roots = spark.createDataFrame([(1, 0)], "node long, root long")
    got = [(r.a, r.b) for r in similar.unjoined(keys, roots, frame, 0.8, block, size).collect()]
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in got)
    wanted = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    assert (1, 0) in wanted and reach(len(texts), [*got, (1, 0)]) == reach(len(texts), wanted)


def test_edge_rows(spark):
    df = data.docs(spark)
    kept = similar.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id if r.doc_id is not None else 99, (r.text or "")[:9]) for r in kept.collect())
    blank = [i for i, t in ids if not t.strip() and i != 12]
    assert blank == [5] and [i for i, _ in ids if i in (0, 1, 2)] == [0] and len([i for i, _ in ids if i == 13]) == 2 and 3 in [i for i, _ in ids] and 16 not in [i for i, _ in ids]
    assert similar.one_of_each(data.empty(spark)).count() == 0


def test_unlike_short_texts_stay(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(["a", "b", "a b", "b a", "A", "one two three four", "one two three four five"])]
    assert sorted(r.doc_id for r in similar.one_of_each(data.docs(spark, rows)).collect()) == [0, 1, 2, 3, 5, 6]


def test_bands_of_many_texts():
    """Each text's three least mixed shingles, in order, whatever stands beside it."""
    texts = [b"", b"a", b"a b c d e f", data.prose(40, 1).encode(), b"", data.prose(300, 2).encode(), b"one two three four five six seven"]
    sets = [similar.shingle_set(t) for t in texts]
    got = similar.bands(sets)
    for k, s in enumerate(sets):
        for j, seed in enumerate(similar._SEEDS):
            key = np.zeros(1, np.uint64)
            for x in np.sort(similar._mix(s ^ seed))[:3]:
                key = similar._mix(key * np.uint64(3) + x)
            assert got[k, j] == key[0]
