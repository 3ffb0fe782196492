import math
import time
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import mixing
from tests.llm import data


def fluid(blocks, weights):
    """By Fractions, a step at a time: (source, block) to the slots at which its service starts and ends."""
    left, t, out = {s: Fraction(n) for s, n in blocks.items()}, Fraction(0), {}
    began = dict.fromkeys(blocks, Fraction(0))
    while any(left.values()):
        active = [s for s in left if left[s]]
        total = sum(weights[s] for s in active)
        upto = {s: left[s] % 1 or Fraction(1) for s in active}  # to the end of the block at hand
        dt = min(upto[s] * total / weights[s] for s in active)
        for s in active:
            left[s] -= dt * weights[s] / total
            if upto[s] * total / weights[s] == dt:
                out[s, blocks[s] - int(left[s]) - 1] = (began[s], t + dt)
                began[s] = t + dt
        t += dt
    return out


CASES = [({"a": 9}, {"a": 1}), ({"a": 5, "b": 9}, {"a": 1, "b": 1}), ({"a": 70, "b": 20, "c": 10}, {"a": 7, "b": 2, "c": 1}), ({"a": 40, "b": 3, "c": 31, "d": 1}, {"a": 500, "b": 333, "c": 166, "d": 1})]


@pytest.mark.parametrize("blocks,weights", CASES)
def test_windows_are_those_of_the_fluid_mixture(blocks, weights):
    served = fluid(blocks, weights)
    had = dict.fromkeys(blocks, 0)
    for t, (s, release, deadline) in enumerate(mixing.earliest_deadlines(blocks, weights)):
        start, end = served[s, had[s]]
        assert (release, deadline) == (math.floor(start), math.ceil(end)) and release <= t < deadline
        had[s] += 1
    assert had == blocks


@pytest.mark.parametrize("blocks,weights", CASES)
def test_slots_against_a_plain_scheduler(blocks, weights):
    """Each slot looks at all sources' next blocks."""
    served, had, out = fluid(blocks, weights), dict.fromkeys(blocks, 0), []
    for t in range(sum(blocks.values())):
        ready = [(math.ceil(served[s, i][1]), s) for s, i in had.items() if i < blocks[s] and served[s, i][0] < t + 1]
        out.append(min(ready)[1])
        had[out[-1]] += 1
    assert [s for s, _, _ in mixing.earliest_deadlines(blocks, weights)] == out


def test_blocks_are_bounded():
    assert mixing.block_size([]) == mixing.block_size([0, 5]) == mixing.block_size([10**6, 3]) == mixing.BLOCK
    for docs in ([10**10, 7 * 10**9, 12], [10**12] * 40, [10**9] + [1] * 1000):
        size = mixing.block_size(docs)
        assert sum(-(-n // size) for n in docs) <= mixing.MOST_BLOCKS < sum(-(-n // (size // 2)) for n in docs) and size % mixing.BLOCK == 0
    assert mixing.block_size([3] * 50, least=1, most=10) == 4


def test_many_sources():
    docs = {f"s{k}": 1 + k % 700 for k in range(100_000)}
    began = time.process_time()
    plan = mixing.Schedule(docs, {s: n**0.5 for s, n in docs.items()})
    assert time.process_time() - began < 60
    assert sorted(np.concatenate([x[0] for x in plan.blocks.values()]).tolist()) == list(range(plan.slots))
    assert all((x[1] <= x[0]).all() and (x[0] < x[2]).all() for x in plan.blocks.values())


@pytest.mark.parametrize("docs,block", [({"a": 1000, "b": 130, "c": 5, "d": 64}, 64), ({"a": 3, "b": 2}, 1), ({"a": 5000, "b": 4000}, 3)])
def test_phases(docs, block):
    plan = mixing.Schedule(docs, {"a": 3.0, "b": 2.0, "c": 1.0, "d": 0.0}, block)
    seen, positions = [], []
    for s, n in docs.items():
        blocks = np.arange(-(-n // block))
        slot, release, deadline = plan.locate(s, blocks)
        assert (release <= slot).all() and (slot < deadline).all() and (np.diff(slot) > 0).all()
        seen += slot.tolist()
        rank = np.arange(n)
        positions += plan.position(slot[rank // block], rank % block).tolist()
    assert sorted(seen) == list(range(plan.slots)) and sorted(positions) == list(range(sum(docs.values())))


@pytest.mark.parametrize("explicit", [False, True])
@pytest.mark.parametrize("sources,n", [(20, 220_000), (300, 2_000_000)])
def test_deviation_from_the_given_weights(sources, n, explicit):
    """Less than a block off the weights themselves, until the first source ends; one source has a third of all rows."""
    docs = {f"s{k}": n * 2 // 3 // (sources - 1) for k in range(1, sources)} | {"s0": n // 3}
    weights = dict.fromkeys(docs, 1.0) | {"s0": sources - 1.0} if explicit else {s: k**0.5 for s, k in docs.items()}
    plan = mixing.Schedule(docs, weights)
    slots = {s: plan.slot(s, np.arange(-(-k // mixing.BLOCK))) for s, k in docs.items()}
    assert sorted(np.concatenate(list(slots.values())).tolist()) == list(range(plan.slots))
    t, share = min(x[-1] for x in slots.values()), {s: w / sum(weights.values()) for s, w in weights.items()}
    for s, x in slots.items():
        x = x[x <= t]
        i = np.arange(len(x))
        assert (i - share[s] * x > -1 - 1e-6).all() and (i + 1 - share[s] * (x + 1) < 1 + 1e-6).all()
        assert abs(len(x) - share[s] * (t + 1)) < 1 + 1e-6


def test_rows(spark):
    df = data.docs(spark)
    out = mixing.mix(df, {"a": 2.0, None: 1.0, "zz": 5.0}, block=2)
    assert out.columns == df.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    assert mixing.mix(data.empty(spark)).count() == 0 and mixing.place(data.empty(spark)).count() == 0


def test_order_within_sources(spark):
    rows = [(k, "t", "en", f"s{k % 3}" if k % 7 else "s0") for k in range(300)]
    out = mixing.place(data.docs(spark, rows), block=4).select("row.doc_id", "row.source", "place.*").orderBy("position").collect()
    assert [r.position for r in out] == list(range(300))
    for s in ("s0", "s1", "s2"):
        ids = [r.doc_id for r in out if r.source == s]
        assert ids == sorted(ids)


def test_the_query_against_a_plain_schedule(spark, data_dir="/root/testdata/sf0.001"):
    """All rows of the registered query, from the documents' counts on in plain Python."""
    import os

    if not os.path.isdir(data_dir):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "source").collect()
    groups = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        groups.setdefault(r.source, []).append(r.doc_id)
    blocks = {s: -(-len(x) // mixing.BLOCK) for s, x in groups.items()}
    served = fluid(blocks, {s: Fraction(len(x) ** 0.5) for s, x in groups.items()})
    had, wanted, position = dict.fromkeys(blocks, 0), {}, 0
    for t in range(sum(blocks.values())):
        deadline, s = min((math.ceil(served[s, i][1]), s) for s, i in had.items() if i < blocks[s] and served[s, i][0] < t + 1)
        for i in groups[s][had[s] * mixing.BLOCK : (had[s] + 1) * mixing.BLOCK]:
            wanted[i] = (s, had[s], math.floor(served[s, had[s]][0]), deadline, t, position)
            position += 1
        had[s] += 1
    got = {r.doc_id: (r.source, r.block, r.release, r.deadline, r.slot, r.position) for r in mixing.op7(spark, data_dir).collect()}
    assert got == wanted and len(got) == len(docs)


def test_against_sql(spark, data):
    from tests import oracle

    oracle.same(mixing.op7(spark, data), oracle.connect(data), mixing.SQL)
