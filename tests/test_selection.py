"""Values at ranks in two passes against a sort, for any number of ranges, groups and odd values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluate


@pytest.mark.parametrize("bins", [2, 5, 256])
def test_values_at_ranks(spark, bins, monkeypatch):
    monkeypatch.setattr(evaluate, "BINS", bins)
    r = random.Random(bins)
    odd = [math.nan, math.inf, -math.inf, 0.0, None]
    rows = [(g, r.choice([r.random(), round(r.random(), 1), r.choice(odd)]), r.randrange(4)) for g in ("a", "b", "b", "b", None) for _ in range(400)] + [("one", 2.5, 1), ("none", None, 1), ("unweighed", 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, x double, w long")
    order = lambda x: (math.isnan(x), 0 if math.isnan(x) else x)
    for weight, times in ((None, lambda w: 1), (F.col("w"), lambda w: w)):
        ranks = {f"near_{q}": evaluate.nearest_rank(q / 100) for q in (0, 50, 95)} | {f"floor_{q}": evaluate.floor_rank(q / 100) for q in (5, 50, 100)}
        got = {x.g: x for x in evaluate.values_at(df, ["g"], F.col("x"), ranks, weight).collect()}
        want = {}
        for g, x, w in rows:
            if x is not None:
                want.setdefault(g, []).extend([x] * times(w))
        want = {g: sorted(v, key=order) for g, v in want.items() if v}
        assert got.keys() == want.keys()
        for g, v in want.items():
            for q in (0, 50, 95):
                assert str(got[g][f"near_{q}"]) == str(v[round(q / 100 * (len(v) - 1))])
            for q in (5, 50, 100):
                assert str(got[g][f"floor_{q}"]) == str(v[min(len(v) - 1, math.floor(q / 100 * len(v)))])


def test_no_window_over_a_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    plan = evaluate.values_at(df, ["g"], F.col("x"), {"p50": evaluate.nearest_rank(0.5)})._jdf.queryExecution().optimizedPlan().toString()
    assert all("__s#" in line or "__bin" in line for line in plan.splitlines() if "Window [" in line)  # sums of ranges by group, values within one range
    assert evaluate.values_at(df.limit(0), ["g"], F.col("x"), {"p50": evaluate.nearest_rank(0.5)}).count() == 0
