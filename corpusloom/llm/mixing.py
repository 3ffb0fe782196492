"""Operator 7, mixing sources to target weights by Pfair scheduling.

A source's documents, in order of doc_id, form blocks of 64. In the fluid mixture every source
that has blocks left is served at once, each in proportion to its target weight; T(v) = sum of
min(blocks, weight * v) over the sources is the number of slots that have gone when each has been
served v times its weight. A source's i-th block has the window of slots that its fluid service
touches, release floor(T(i / w)) and deadline ceil(T((i + 1) / w)), and each slot goes to the
released block of earliest deadline. The fluid mixture itself keeps all windows at a rate of one
block a slot, so earliest-deadline-first keeps them too: at every moment a source has had less
than one block more or less than its fluid share, also after other sources have ended and the rest share
their slots.

Weights are taken as exact fractions, and releases and deadlines are whole-number arithmetic on
them, so the bound holds against the weights themselves however many sources and documents
there are. The schedule is made once, on the driver, from one count for each source: three numbers for
each block, and work that grows with blocks times the logarithm of the number of sources. For
10^10 documents choose blocks of some thousands. No document is left out or repeated.

A document's block needs its rank within its source. Ranks are counted within (source,
range of doc_id) cells, whose offsets are running sums of the cells' counts, so a source
that holds most rows is dealt to all tasks.

Edge cases: a null source is a source of its own; a null doc_id ranks last, and all null ids of one source are ranked by one task; equal ids
rank in any order; a source without a target weight or with one that isn't positive gets
a thousand-millionth of the least weight, so it comes when the others have ended; a single source is
in its own order; an empty table gives an empty result; texts of any length, empty or null, are
only carried along; other columns are kept by `place` and `mix`, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import row_of, table, tasks
from corpusloom.llm.substring import LAST

BLOCK = 64
MOST_BLOCKS = 2**20
POWER = 0.5  # default targets: the square roots of the sources' numbers of documents


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the weights' proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: x.numerator * (unit // x.denominator) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: x // common for s, x in out.items()}


def block_size(docs: Iterable[int], least: int = BLOCK, most: int = MOST_BLOCKS) -> int:
    """Documents of a block: least, doubled until the sources' blocks are `most` at most or one each."""
    counts, size = np.array([n for n in docs if n > 0], np.int64), least
    while len(counts) and -(-counts // size).sum() > max(most, len(counts)):
        size *= 2
    return size


class Fluid:
    """The fluid mixture: n blocks and a whole-number weight for each source."""

    def __init__(self, blocks: list[int], weights: list[int]):
        order = sorted(range(len(blocks)), key=lambda k: Fraction(blocks[k], weights[k]))
        self.ends = [Fraction(blocks[k], weights[k]) for k in order]  # when each source has had all its blocks
        self.about = [float(x) for x in self.ends]
        self.gone = [0, *accumulate(blocks[k] for k in order)]  # blocks of the sources that have ended
        total = sum(weights)
        self.left = [total, *(total - x for x in accumulate(weights[k] for k in order))]  # weights of the others

    def slots(self, i: int, w: int) -> tuple[int, int]:
        """T(i / w) as a fraction."""
        k = bisect_right(self.about, i / w)
        while k and self.ends[k - 1] * w > i:
            k -= 1
        while k < len(self.ends) and self.ends[k] * w <= i:
            k += 1
        return self.gone[k] * w + self.left[k] * i, w


def earliest_deadlines(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """Source, release and deadline of the block in each slot, earliest deadline first."""
    names = list(blocks)
    fluid = Fluid([blocks[s] for s in names], [weights[s] for s in names])

    def window(s: str, i: int) -> tuple[int, str, int, int]:
        (x, w), (y, _) = fluid.slots(i, weights[s]), fluid.slots(i + 1, weights[s])
        return x // w, s, i, -(-y // w)

    coming = [window(s, 0) for s in names]  # release, source, block, deadline
    heapify(coming)
    ready: list[tuple[int, str, int, int]] = []  # deadline, source, block, release
    for t in range(sum(blocks.values())):
        while coming and coming[0][0] <= t:
            release, s, i, deadline = heappop(coming)
            heappush(ready, (deadline, s, i, release))
        deadline, s, i, release = heappop(ready)
        yield s, release, deadline
        if i + 1 < blocks[s]:
            heappush(coming, window(s, i + 1))


class Schedule:
    """Slots of all blocks: for each source the slot, release and deadline of each of its blocks."""

    def __init__(self, docs: dict[str, int], weights: dict[str, float], block: int = BLOCK):
        self.block = block
        blocks = {s: -(-n // block) for s, n in docs.items() if n > 0}
        made: dict[str, tuple[array, array, array]] = {s: (array("q"), array("q"), array("q")) for s in blocks}
        least = Fraction(min((w for w in weights.values() if w > 0), default=1.0)) / 10**9
        whole = whole_weights({s: weights[s] if weights.get(s, 0) > 0 else least for s in blocks}) if blocks else {}
        for t, (s, release, deadline) in enumerate(earliest_deadlines(blocks, whole)):
            for x, to in zip((t, release, deadline), made[s], strict=True):
                to.append(x)
        self.slots = sum(blocks.values())
        self.blocks = {s: tuple(np.frombuffer(x, np.int64) for x in xs) for s, xs in made.items()}
        short = sorted((int(self.slot(s, np.array([(n - 1) // block]))[0]), -n % block) for s, n in docs.items() if n > 0)
        self.short_slots = np.array([t for t, _ in short], np.int64)
        self.short_sum = np.concatenate(([0], np.cumsum([k for _, k in short], dtype=np.int64)))

    def locate(self, source: str, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, release and deadline of a source's blocks."""
        slot, release, deadline = self.blocks[source]
        return slot[blocks], release[blocks], deadline[blocks]

    def slot(self, source: str, blocks: np.ndarray) -> np.ndarray:
        return self.locate(source, blocks)[0]

    def position(self, slot: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Rank of a document in the mixture; sources' last blocks may be short."""
        return slot * self.block - self.short_sum[np.searchsorted(self.short_slots, slot)] + inside


def _source(source: str):
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def place(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None, source: str = "source") -> DataFrame:
    """For each row of docs: row (all its columns, as a struct) and place: block, release, deadline, slot, position."""
    spark = docs.sparkSession
    n = tasks(spark)
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    bounds = docs.agg(F.percentile_approx(did, [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []  # one number a task
    edges = np.array(sorted(set(bounds or [])), np.int64)

    @F.arrow_udf("int")
    def cell(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, ids.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    keyed = docs.select(did.alias("did"), _source(source).alias("from"), row_of(docs).alias("row")).withColumn("cell", cell("did"))
    cells = keyed.groupBy("from", "cell").agg(F.count("*").alias("n"))
    totals = {r[0]: r[1] for r in cells.groupBy("from").agg(F.sum("n")).collect()}  # one row a source
    named = {"n" if s is None else f"s{s}": w for s, w in weights.items()} if weights is not None else {s: k**POWER for s, k in totals.items()}
    plan = Schedule(totals, named, block or block_size(totals.values()))

    @F.pandas_udf("block long, release long, deadline long, slot long, position long")
    def located(sources: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        blocks, inside = np.divmod(ranks.to_numpy(), plan.block)
        slot, release, deadline = (np.zeros(len(ranks), np.int64) for _ in range(3))
        for s, at in sources.groupby(sources).indices.items():
            slot[at], release[at], deadline[at] = plan.locate(s, blocks[at])
        return pd.DataFrame({"block": blocks, "release": release, "deadline": deadline, "slot": slot, "position": plan.position(slot, inside)})

    before = Window.partitionBy("from").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("from", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("from", "cell").orderBy("did")) - 1
    ranked = keyed.withColumn("rank", within).join(offsets, ["from", "cell"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("row", located("from", "rank").alias("place"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None) -> DataFrame:
    """All rows of docs in the mixture's order."""
    placed = place(docs, weights, block)
    return placed.repartitionByRange(tasks(docs.sparkSession), "place.position").sortWithinPartitions("place.position").select("row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "source")).select("row.doc_id", "row.source", "place.*")


#: The schedule by recursion over slots: each takes the released block of earliest deadline, of equal ones that of the first source.
#: T(i / w) is a sum over all sources; what is within 1e-9 of a whole number is one.
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE concat('s', source) END AS k FROM documents),
c AS (SELECT k, CAST(ceil(count(*) / CAST({BLOCK} AS DOUBLE)) AS BIGINT) AS nb, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM d GROUP BY k),
e AS (SELECT k, w, unnest(range(nb + 1)) AS i FROM c), t AS (SELECT e.k, e.i, sum(least(CAST(c.nb AS DOUBLE), c.w * e.i / e.w)) AS at FROM e CROSS JOIN c GROUP BY e.k, e.i),
x AS (SELECT a.k, a.i, CAST(floor(a.at + 1e-9) AS BIGINT) AS release, CAST(ceil(z.at - 1e-9) AS BIGINT) AS deadline FROM t a JOIN t z ON z.k = a.k AND z.i = a.i + 1),
l AS (SELECT k, list(release ORDER BY i) AS rel, list(deadline ORDER BY i) AS dl FROM x GROUP BY k),
w AS (SELECT list(k ORDER BY k) AS ks, list(rel ORDER BY k) AS rel, list(dl ORDER BY k) AS dl, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(rel)) AS BIGINT) AS total FROM l),
r AS (SELECT CAST(0 AS BIGINT) AS t, [CAST(1 AS BIGINT) FOR z IN range(n)] AS coming, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS BIGINT) AS block FROM w
UNION ALL SELECT t + 1, [CASE WHEN z = p THEN coming[z] + 1 ELSE coming[z] END FOR z IN range(1, n + 1)], p, coming[p] - 1
FROM (SELECT t, coming, n, list_sort([{{'d': dl[z][coming[z]], 's': z}} FOR z IN range(1, n + 1) IF coming[z] <= len(rel[z]) AND rel[z][coming[z]] <= t])[1].s AS p FROM r, w WHERE t < total)),
s AS (SELECT w.ks[pick] AS k, block, t - 1 AS slot FROM r, w WHERE pick IS NOT NULL),
o AS (SELECT doc_id, source, k, CAST(row_number() OVER (PARTITION BY k ORDER BY doc_id) - 1 AS BIGINT) AS rank FROM d),
f AS (SELECT o.*, s.block, s.slot, x.release, x.deadline FROM o JOIN s ON s.k = o.k AND s.block = o.rank // {BLOCK} JOIN x ON x.k = s.k AND x.i = s.block),
g AS (SELECT slot, count(*) AS n FROM f GROUP BY slot), h AS (SELECT slot, CAST(coalesce(sum(n) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM g)
SELECT doc_id, source, block, release, deadline, slot, before + rank % {BLOCK} AS position FROM f JOIN h USING (slot)"""
