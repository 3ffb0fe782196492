"""Operator 11, hard negatives from vantage-point trees over norm-augmented vectors.

Components become whole numbers, floor(scale * x), so scores (inner products) are exact. A row's vector gets one more coordinate,
sqrt(M^2 - |v|^2) with M the greatest norm of all; an anchor, as a query, gets 0. Then distance^2 = |a|^2 + M^2 - 2 * score: higher
scores are nearer, and a window of scores is an annulus. A tree node has a vantage point and the range of its rows' distances
to it, so the triangle inequality bounds the scores below the node from both sides.

The tree has two levels of storage. Its upper part is built on a sample of at most `SAMPLE` rows and has at most `LEAVES` leaves; every row
goes down it to one leaf, whose true ranges of distances are grouped over all rows. Rows of one leaf and label are dealt to
blocks of about `BLOCK` rows, so a hot label, or a vector that a third of all rows repeat, is many blocks. A query (an anchor, its annulus and a
number k) is routed to the leaves that can hold a better row than the k-th best within the sample, which is a bound since sample
rows are rows. Queries of neighbouring leaves travel together, `QUERIES` at most; a block meets each such group that wants it.
There a tree of the block's rows is searched for all queries at once, each nearest-first inside its annulus: its buckets come in the order
of the best score that they can hold, until that is below its k-th best. Bounds have slack for rounding; scores decide. Nothing is approximate.

First every anchor looks for its k nearest rows of its own label, then every (anchor, positive) for the nearest rows of other labels in its
window. The sample, the upper tree and the leaves' ranges, a few megabytes at most whatever the input, go to all tasks; no row of
results passes through the driver.

Edge cases: rows with a null id, label or vector, or a null, NaN or infinite component take no part, nor do rows with a component
whose scaled value is 2^27 or more in size (scores might not fit a long); a shorter vector counts as zero beyond its end; equal rows are rows of their own,
each other's positives or negatives; a positive score below zero has an empty window; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import alone, bytes_of, drop, in_groups, keep, table, tasks

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # the window of negative scores, in hundredths of the positive's
SAMPLE, LEAVES, LEAF_ROWS = 4096, 512, 4096
BLOCK, QUERIES, BUCKET = 4096, 1024, 32
MOST = 2**27
FAR = 2**62


def _packed(scale: int):
    """Usable rows: uid, vec_id, label, anchor, the vector as whole numbers of 32 bits, its squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            raw, norm = [], []
            for x in batch.column("vector"):
                ok = x.is_valid and not x.values.null_count
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale if ok else None
                if ok and np.isfinite(v).all() and (np.abs(v) < MOST).all():
                    q = np.floor(v).astype(np.int64)
                    raw.append(q.astype("<i4").tobytes())
                    norm.append(int(q @ q))
                else:
                    raw.append(None)
                    norm.append(0)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "vec_id", "label", "anchor")), pa.array(raw, pa.binary()), pa.array(norm, pa.int64())], ["uid", "vec_id", "label", "anchor", "raw", "norm"])
            yield out.filter(out.column("raw").is_valid())

    return run


def matrix(raw: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of whole numbers, zero beyond their ends."""
    data, at = bytes_of(raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw)
    values, at = np.frombuffer(data.tobytes(), "<i4"), at // 4
    if (np.diff(at) == dim).all():
        return values.reshape(len(at) - 1, dim).astype(np.int64)
    out = np.zeros((len(at) - 1, dim), np.int64)
    for k in range(len(out)):
        out[k, : at[k + 1] - at[k]] = values[at[k] : at[k + 1]]
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where these hold all sums."""
    if not a.size or not b.size or int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Tree:
    """A vantage-point tree of augmented rows: nodes in the order of their making, leaves as ranges of `order`."""

    def __init__(self, rows: np.ndarray, depth: int):
        self.order = np.arange(len(rows))
        self.vantage: list[int] = []  # of inner nodes: a row
        self.cut: list[float] = []
        self.children: list[tuple[int, int]] = []  # an inner node's number, or ~ a leaf's
        self.leaves: list[tuple[int, int]] = []
        self.ranges: list[list[tuple[int, float, float]]] = []  # of leaves: (inner node above, least, most distance to its vantage point)
        self._make(rows, 0, len(rows), depth, [])

    def _make(self, rows: np.ndarray, s: int, e: int, depth: int, above: list[tuple[int, bool]]) -> int:
        if not depth or e - s < 2:
            self.leaves.append((s, e))
            held = rows[self.order[s:e]]
            away = [(node, np.sqrt(((held - rows[self.vantage[node]]) ** 2).sum(axis=1))) for node, _ in above]
            self.ranges.append([(node, float(d.min()), float(d.max())) if len(d) else (node, np.inf, -np.inf) for node, d in away])
            return ~(len(self.leaves) - 1)
        held = rows[self.order[s:e]]
        some = np.linspace(0, e - s - 1, min(8, e - s)).astype(int)
        distances = np.sqrt(np.maximum(0, (held * held).sum(axis=1)[None] + (held[some] ** 2).sum(axis=1)[:, None] - 2 * held[some] @ held.T))
        best = int(distances.std(axis=1).argmax())  # the candidate whose distances spread most
        d = distances[best]
        node = len(self.vantage)
        self.vantage.append(int(self.order[s + some[best]]))
        by = np.argsort(d, kind="stable")
        self.order[s:e] = self.order[s:e][by]
        middle = (e - s) // 2
        self.cut.append(float(d[by[middle - 1]]))
        self.children.append((0, 0))
        inner = self._make(rows, s, s + middle, depth - 1, [*above, (node, True)])
        outer = self._make(rows, s + middle, e, depth - 1, [*above, (node, False)])
        self.children[node] = (inner, outer)
        return node


def augmented(rows: np.ndarray, norms: np.ndarray, most: int) -> np.ndarray:
    return np.column_stack((rows.astype(np.float64), np.sqrt(np.maximum(0.0, most - norms.astype(np.float64)))))


class Bounds:
    """Least and most score that the rows of each leaf can have with a query."""

    def __init__(self, vantage: np.ndarray, ranges: list[list[tuple[int, float, float]]], most: int):
        self.vantage, self.ranges, self.most = vantage, ranges, most

    def __call__(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = np.column_stack((queries.astype(np.float64), np.zeros(len(queries))))
        size = (q * q).sum(axis=1)
        away = np.sqrt(np.maximum(0.0, size[:, None] + (self.vantage**2).sum(axis=1)[None] - 2 * q @ self.vantage.T))
        near, far = np.zeros((len(q), len(self.ranges))), np.full((len(q), len(self.ranges)), np.inf)
        for k, above in enumerate(self.ranges):
            for node, least, most in above:
                d = away[:, node]
                near[:, k] = np.maximum(near[:, k], np.maximum(d - most, least - d))
                far[:, k] = np.minimum(far[:, k], d + most)
        whole = (size + self.most)[:, None]
        slack = 1e-9 * whole + 1e-3
        return (whole - far**2) / 2 - slack, (whole - near**2) / 2 + slack


def best(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's first k: higher scores first, then smaller ids."""
    order = np.lexsort((uid, vec_id, -score, query))
    nth = np.arange(len(order)) - np.searchsorted(query[order], query[order], "left")
    return order[nth < k]


def search(rows: np.ndarray, norms: np.ndarray, vec_id: np.ndarray, uid: np.ndarray, queries: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of each query's first k rows with low <= score <= high, other than its own row. Each
    query takes the tree's buckets nearest-first, in growing numbers at once, until none can better its k-th."""
    points = augmented(rows, norms, most)
    tree = Tree(points, max(0, int(np.ceil(np.log2(max(1, len(rows)) / BUCKET)))))
    least, top = Bounds(points[tree.vantage] if tree.vantage else np.zeros((0, points.shape[1])), tree.ranges, most)(queries)
    reach = np.where((top >= low[:, None]) & (least <= high[:, None]), np.minimum(top, high[:, None].astype(np.float64)), -np.inf)
    order = np.argsort(-reach, axis=1, kind="stable")
    kth = np.full(len(queries), -(2**63), np.int64)
    found_q, found_r, found_s = (np.zeros(0, np.int64) for _ in range(3))
    at, wave = 0, 1
    while at < len(tree.leaves):
        ahead = np.take_along_axis(reach, order[:, at : at + wave], axis=1)
        q, w = np.nonzero((ahead > -np.inf) & (ahead >= kth[:, None]))
        if not len(q):
            break
        leaf = order[q, at + w]
        new_q, new_r, new_s = [found_q], [found_r], [found_s]
        by = np.argsort(leaf, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            s, e = tree.leaves[leaf[part[0]]]
            who, held = q[part], tree.order[s:e]
            score = scores(queries[who], rows[held])
            i, j = np.nonzero((score >= low[who][:, None]) & (score <= high[who][:, None]) & (score >= kth[who][:, None]) & (uid[held][None] != own[who][:, None]))
            new_q.append(who[i])
            new_r.append(held[j])
            new_s.append(score[i, j])
        found_q, found_r, found_s = (np.concatenate(x) for x in (new_q, new_r, new_s))
        kept = best(found_q, found_s, vec_id[found_r], uid[found_r], k)
        found_q, found_r, found_s = found_q[kept], found_r[kept], found_s[kept]
        full = np.bincount(found_q, minlength=len(queries)) >= k
        lowest = np.full(len(queries), 2**63 - 1)
        np.minimum.at(lowest, found_q, found_s)
        kth = np.where(full, lowest, -(2**63))
        at, wave = at + wave, wave * 2
    return found_q, found_r, found_s


class Upper:
    """The upper part of the tree, with the sample it was built on; ranges are filled in from all rows."""

    def __init__(self, sample: pa.Table, n: int, dim: int, most: int):
        self.dim, self.most = dim, most
        self.rows = matrix(sample.column("raw"), dim)
        self.uid, self.vec_id = sample.column("uid").to_numpy(), sample.column("vec_id").to_numpy()
        self.label = np.array(sample.column("label").to_pylist(), object)
        points = augmented(self.rows, sample.column("norm").to_numpy(), most)
        tree = Tree(points, int(np.ceil(np.log2(max(1, min(LEAVES, n / LEAF_ROWS))))))
        self.vantage = points[tree.vantage] if tree.vantage else np.zeros((0, dim + 1))
        self.cut, self.children = np.array(tree.cut), tree.children
        self.above = [[node for node, _, _ in x] for x in tree.ranges]
        self.bounds: Bounds | None = None

    def leaf(self, rows: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, and its distances to all vantage points."""
        points = augmented(rows, norms, self.most)
        away = np.sqrt(np.maximum(0.0, (points**2).sum(axis=1)[:, None] + (self.vantage**2).sum(axis=1)[None] - 2 * points @ self.vantage.T))
        at = np.zeros(len(rows), np.int64) if self.children else np.full(len(rows), -1)
        while (at >= 0).any():
            go = np.flatnonzero(at >= 0)
            outer = away[go, at[go]] > self.cut[at[go]]
            at[go] = np.array(self.children)[at[go], outer.astype(int)]
        return ~at, away


def _placed(upper: Upper):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            leaf, away = upper.leaf(matrix(batch.column("raw"), upper.dim), batch.column("norm").to_numpy())
            path = [away[k, upper.above[x]] for k, x in enumerate(leaf)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in path]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(path) if path else np.zeros(0)))
            names = ["uid", "vec_id", "label", "anchor", "raw", "norm"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(leaf.astype(np.int32)), lists], [*names, "leaf", "away"])

    return run


def _routed(upper: Upper, same: bool, k: int):
    """The leaves that each query visits: queries have a label, low and high scores and the uid of their own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                batch = whole.slice(s, 512)
                q = matrix(batch.column("raw"), upper.dim)
                low, high, own = (batch.column(c).to_numpy() for c in ("low", "high", "own"))
                label = np.array(batch.column("label").to_pylist(), object)
                score = scores(q, upper.rows)
                fits = ((upper.label[None] == label[:, None]) == same) & (score >= low[:, None]) & (score <= high[:, None]) & (upper.uid[None] != own[:, None])
                score = np.where(fits, score, -FAR)
                kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -FAR)
                least, top = upper.bounds(q)
                want = (top >= np.maximum(low, kth)[:, None]) & (least <= high[:, None])
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(want.sum(axis=1)))).astype(np.int32), pa.array(np.nonzero(want)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "leaves"])

    return run


def _met(dim: int, k: int, most: int):
    """Blocks with the queries that visit them: queries (kind 0) come before rows (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for group in in_groups(batches, ("block", "slice")):
            kind = group.column("kind").to_numpy()
            asked, rows = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
            if not rows.num_rows:
                continue
            vec_id, uid = rows.column("vec_id").to_numpy(), rows.column("uid").to_numpy()
            x = matrix(rows.column("raw"), dim)
            for s in range(0, asked.num_rows, QUERIES):
                some = asked.slice(s, QUERIES)
                own, low, high = (some.column(c).to_numpy() for c in ("own", "low", "high"))
                q, r, score = search(x, rows.column("norm").to_numpy(), vec_id, uid, matrix(some.column("raw"), dim), own, low, high, k, most)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(some.column("uid").to_numpy()[q]), pa.array(uid[r]), pa.array(vec_id[r]), pa.array(score)], ["query", "uid", "vec_id", "score"])

    return run


class Index:
    """All rows in blocks below the upper tree, as tables in the shared folder."""

    def __init__(self, vectors: DataFrame, vec_id: str, label: str, column: str, anchor, scale: int):
        spark = vectors.sparkSession
        kind = vectors.schema[label].dataType.simpleString()
        rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(column).alias("vector"), anchor.alias("anchor")).where("vec_id is not null and label is not null and vector is not null")
        rows, path = keep(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_packed(scale), f"uid long, vec_id long, label {kind}, anchor boolean, raw binary, norm long"), "packed")
        facts = rows.agg(F.count("*").alias("n"), F.max("norm").alias("most"), F.max(F.octet_length("raw")).alias("bytes"), F.count_if("anchor").alias("anchors")).first()
        self.spark, self.kind, self.dim, self.most = spark, kind, (facts.bytes or 0) // 4, facts.most or 0
        sample = rows
        if facts.n > SAMPLE:
            sample = rows.where(F.xxhash64("uid") < F.lit(int(2**64 * 0.95 * SAMPLE / facts.n) - 2**63))
        held = sample.select("uid", "vec_id", "label", "raw", "norm").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).toArrow()
        self.upper = upper = Upper(held, facts.n, self.dim, self.most)
        placed, _ = keep(rows.mapInArrow(_placed(upper), f"uid long, vec_id long, label {kind}, anchor boolean, raw binary, norm long, leaf int, away array<double>"), "placed")
        drop(spark, path)
        depth = max((len(x) for x in upper.above), default=0)
        ends = placed.groupBy("leaf").agg(F.count_if("anchor").alias("anchors"), *(f(F.get("away", F.lit(k))).alias(f"{n}{k}") for k in range(depth) for f, n in ((F.min, "least"), (F.max, "most")))).collect()  # a row a leaf
        ends = {r.leaf: r for r in ends}
        upper.bounds = Bounds(upper.vantage, [[(node, ends[x][f"least{k}"], ends[x][f"most{k}"]) if x in ends else (node, np.inf, -np.inf) for k, node in enumerate(above)] for x, above in enumerate(upper.above)], self.most)
        self.slices, at = {}, 0  # of each leaf's anchors: neighbouring leaves share one, until it has QUERIES anchors
        for x in sorted(ends):
            n = ends[x].anchors
            self.slices[x] = (at // QUERIES, max(1, -(-n // QUERIES)))
            at += n if n <= QUERIES else -(-n // QUERIES) * QUERIES
        sizes = placed.groupBy("leaf", "label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        blocks = sizes.select("leaf", "label", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).withColumn("block", F.monotonically_increasing_id())
        self.blocks, _ = keep(blocks, "blocks")
        dealt = placed.join(sizes, ["leaf", "label"]).withColumn("b", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
        self.rows, _ = keep(dealt.join(self.blocks.drop("blocks"), ["leaf", "label", "b"]).select("block", "leaf", "label", "uid", "vec_id", "anchor", "raw", "norm"), "indexed")

    def nearest(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """query, uid, vec_id and score of the first k rows of the same or of other labels, by block: not yet merged.
        queries: uid, own, label, leaf (of the anchor), raw, low, high."""
        spark = self.spark
        firsts = F.create_map(*(x for leaf, (first, n) in self.slices.items() for x in (F.lit(leaf), F.struct(F.lit(first).alias("first"), F.lit(n).alias("n"))))) if self.slices else None
        if firsts is None:
            return spark.createDataFrame([], "query long, uid long, vec_id long, score long")
        place = firsts[F.col("leaf")]
        queries = queries.withColumn("slice", (place["first"] + F.pmod(F.xxhash64("own"), place["n"])).cast("long"))
        routed = queries.select("uid", "own", "label", "slice", "raw", "low", "high").mapInArrow(_routed(self.upper, same, k), f"uid long, own long, label {self.kind}, slice long, raw binary, low long, high long, leaves array<int>")
        routed, _ = keep(routed, "routed")
        at = routed.select("uid", "own", F.col("label").alias("mine"), "slice", F.explode("leaves").alias("leaf"))
        wanted = at.join(self.blocks.select("leaf", "label", "block"), "leaf").where(F.col("label") == F.col("mine") if same else F.col("label") != F.col("mine")).select("uid", "slice", "block")
        groups = wanted.select("block", "slice").distinct()
        asked = wanted.join(routed.select("uid", "own", "raw", "low", "high"), "uid")
        asked = asked.select("block", "slice", F.lit(0).alias("kind"), "uid", F.lit(0).cast("long").alias("vec_id"), "own", "raw", F.lit(0).cast("long").alias("norm"), "low", "high")
        none = F.lit(0).cast("long")
        held = self.rows.join(groups, "block").select("block", "slice", F.lit(1).alias("kind"), "uid", "vec_id", none.alias("own"), "raw", "norm", none.alias("low"), none.alias("high"))
        met = asked.union(held).repartition(tasks(spark), "block", "slice").sortWithinPartitions("block", "slice", "kind")
        return met.mapInArrow(_met(self.dim, k, self.most), "query long, uid long, vec_id long, score long")


def hard_negatives(vectors: DataFrame, anchor, vec_id: str = "vec_id", label: str = "label", column: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (LOWEST, HIGHEST)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: a condition on vectors' columns."""
    index = Index(vectors, vec_id, label, column, F.coalesce(anchor, F.lit(False)), scale)
    anchors = index.rows.where("anchor").select("uid", "vec_id", "label", "leaf", "raw")
    asked = anchors.select("uid", F.col("uid").alias("own"), "label", "leaf", "raw", F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    first = lambda df, n: df.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid"))).where(F.col("rank") <= n)
    pairs = first(index.nearest(asked, positives, same=True), positives).select(F.col("query").alias("own"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs, _ = keep(pairs.withColumn("uid", F.monotonically_increasing_id()), "positives")
    exact = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(exact * window[0] / 100).cast("long"), F.floor(exact * window[1] / 100).cast("long")
    asked = pairs.join(anchors.select(F.col("uid").alias("own"), F.col("vec_id").alias("anchor_id"), "label", "leaf", "raw"), "own").withColumns({"low": low, "high": high}).where("low <= high")
    found = first(index.nearest(asked.select("uid", "own", "label", "leaf", "raw", "low", "high"), negatives, same=False), negatives)
    named = pairs.join(anchors.select(F.col("uid").alias("own"), F.col("vec_id").alias("anchor_id")), "own").select(F.col("uid").alias("query"), "anchor_id", "positive_id", "positive_score")
    return found.join(named, "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 50 == 0)


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM s WHERE same QUALIFY n <= {POSITIVES})
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOWEST} * p.score <= 100 * s.score AND 100 * s.score <= {HIGHEST} * p.score
QUALIFY rank <= {NEGATIVES}
"""
