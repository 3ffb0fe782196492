"""Operator 6, embedding near-dedup by random-hyperplane sign hashing.

Equal vectors form a class, which stands for all its copies from then on. A class has
one signature in each of several tables, the signs of its products with random
hyperplanes; classes that share a signature are compared exactly, by cosine in double
precision. Bits for each signature grow with the logarithm of the number of classes, so
that buckets hold some 256 classes if they are spread evenly: what is shuffled grows with the number of
tables, and larger buckets need shorter signatures and so fewer tables (7 for 50,000 classes, 16 for 5
million, 35 for 10^9). Tables are as many as give a pair at the limit itself the wanted
chance to meet (0.97; pairs of higher cosine meet more often).

Signatures are made once and written beside their vectors, with a sketch of 128 more signs. Signatures and sketches alone are
shuffled for every table (some 40 bytes a class and table): buckets are counted from them, those of more than `block`
classes are split into blocks, and each pair of blocks is a group of its own, so no task holds more than two
blocks and no pair is lost. Within a group, sketches tell which classes have a near one at all: pairs at the limit differ in 13
signs on average, with a deviation of 3.4, and those of up to 41 pass, so what this loses is beyond measure beside the tables' own 3 %.
Only the vectors of these classes are fetched, for exact comparison in the same groups. A pair counts in the first table in
which it meets. Groups return each class's number of linked vectors and a spanning forest of their links,
never the pairs.

Edge cases: vectors that are null, zero, empty or hold null or non-finite components link
with nothing, and neither do rows whose id is null; vectors of different lengths don't
link; equal rows count as one vector; rows of one vec_id with different vectors are
vectors of their own, and not counted among each other's copies; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import alone, drop, in_groups, keep, table, tasks
from corpusloom.llm.components import connected_components

LIMIT = 0.95
RECALL = 0.97
BUCKET = 256  # classes in a bucket, were they spread evenly
BLOCK = 512
SEED = 20240229
SKETCH = 128


def plan(n: int, limit: float = LIMIT, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a signature and number of tables for n classes."""
    bits = min(31, max(8, math.ceil(math.log2(max(1, n) / BUCKET)) if n > BUCKET else 8))
    meet = (1 - math.acos(limit) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def planes(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((n, dim)).T


def near_signs(limit: float) -> int:
    """The most signs of a sketch in which a pair at the limit may differ: eight deviations above the mean."""
    p = math.acos(limit) / math.pi
    return math.ceil(SKETCH * p + 8 * math.sqrt(SKETCH * p * (1 - p)))


def _packed(column: str):
    """Usable vectors' components as bytes, in their own precision or in double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            kind = np.float32 if pa.types.is_float32(lists.type.value_type) else np.float64
            lists = lists.cast(pa.list_(pa.float32() if kind == np.float32 else pa.float64()))
            out = []
            for x in lists:
                ok = x.is_valid and len(x) and not x.values.null_count
                v = x.values.to_numpy() if ok else None
                out.append(v.tobytes() if ok and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "raw"])

    return run


def _signed(bits: int, tables: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        place = np.uint32(1) << np.arange(bits, dtype=np.uint32)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                raw = batch.column("raw").to_pylist()
                sizes = np.array([len(x) for x in raw])
                signs, sketch = np.zeros((len(raw), tables), np.uint32), np.zeros((len(raw), SKETCH // 8), np.uint8)
                for size in np.unique(sizes):
                    some = np.flatnonzero(sizes == size)
                    x = np.frombuffer(b"".join(raw[k] for k in some), kind).reshape(len(some), -1).astype(np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    h = (x @ planes(x.shape[1], bits * tables) > 0).reshape(len(some), tables, bits)
                    signs[some] = (h * place).sum(axis=2, dtype=np.uint32)
                    sketch[some] = np.packbits(x @ planes(x.shape[1], SKETCH, SEED + 1) > 0, axis=1)
                lists = pa.ListArray.from_arrays(np.arange(len(raw) + 1, dtype=np.int32) * tables, pa.array(signs.astype(np.int32).ravel()))
                two = sketch.view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), batch.column("raw"), lists, pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], ["rep", "n", "raw", "signs", "s1", "s2"])

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each of n nodes to the least of its component."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    some = np.flatnonzero(label != np.arange(n))
    return label[some], some


def _compare(group: pa.Table, kind: str, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rep, linked vectors) and edges (a, b) of one group: all pairs, or those across its two blocks."""
    rep, n, own = group.column("rep").to_numpy(), group.column("n").to_numpy(), group.column("own").to_numpy()
    tab, lo, hi = group.column("tab")[0].as_py(), group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    raw = group.column("raw").to_pylist()
    signs = pa.concat_arrays([x.flatten() for x in group.column("signs").chunks]).to_numpy().reshape(len(rep), -1)[:, :tab]
    sizes = np.array([len(x) for x in raw])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # a lone block of a pair links nothing
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(raw[k] for k in some), kind).reshape(len(some), -1).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        rows, cols = (some, some) if lo == hi else (some[own[some] == lo], some[own[some] == hi])
        at = np.searchsorted(some, cols)
        for k in range(0, len(rows), 512):
            r = np.searchsorted(some, rows[k : k + 512])
            cos = (x[r] @ x[at].T) / (norm[r][:, None] * norm[at][None, :])
            i, j = np.nonzero(cos >= limit)
            i, j = rows[k : k + 512][i], cols[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            new = ~(signs[i] == signs[j]).any(axis=1)
            left.append(i[new])
            right.append(j[new])
    a, b = np.concatenate(left), np.concatenate(right)
    links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
    some = np.flatnonzero(links)
    f, t = _forest(len(rep), a, b)
    return rep[some], links[some].astype(np.int64), rep[f], rep[t]


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows to compare with which: all with all of one block, or those of two blocks across."""
    own = group.column("own").to_numpy()
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    every = np.arange(len(own))
    return (every, every, True) if lo == hi else (np.flatnonzero(own == lo), np.flatnonzero(own == hi), False)


def _members(most: int):
    """Of each group the classes that have another one within `most` signs of their sketches. Rows come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ("tab", "sig", "lo", "hi")):
            s = np.column_stack([group.column(c).to_numpy() for c in ("s1", "s2")]).view(np.uint64)
            rows, cols, same = _sides(group)
            near = np.zeros(len(s), bool)
            for at in range(0, len(rows), 512):
                r = rows[at : at + 512]
                apart = sum(np.bitwise_count(s[r, k][:, None] ^ s[cols, k][None, :]).astype(np.uint8) for k in (0, 1))
                meets = apart <= most
                if same:
                    meets[np.arange(len(r)), r] = False
                near[r] |= meets.any(axis=1)
                near[cols] |= meets.any(axis=0)
            if near.any():
                found = group.filter(pa.array(near)).combine_chunks().to_batches()
                yield from (x.select(["tab", "sig", "lo", "hi", "own", "rep"]) for x in found)

    return run


def _groups(kind: str, limit: float):
    """Rows come sorted by group; only the group at hand is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ("tab", "sig", "lo", "hi")):
            rep, links, a, b = _compare(group, kind, limit)
            if len(rep):
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(links)], ["a", "b", "links"])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", limit: float = LIMIT, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), column).mapInArrow(_packed(column), "vec_id long, raw binary")
    rows, _ = keep(rows, "vectors")
    usable = rows.where("raw is not null and vec_id is not null")
    classes, path = keep(usable.distinct().groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    bits, tables = plan(classes.count(), limit, recall)
    signed, _ = keep(classes.mapInArrow(_signed(bits, tables, kind), "rep long, n long, raw binary, signs array<int>, s1 long, s2 long"), "signed")
    drop(spark, path)
    slim = signed.select("rep", F.posexplode("signs").alias("tab", "sig"))
    full = slim.groupBy("tab", "sig").agg(F.count("*").alias("size")).where(F.col("size") > block)
    full = full.select("tab", "sig", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    crowded = slim.join(full, ["tab", "sig"]).groupBy("rep").agg(F.collect_list(F.struct("tab", "blocks")).alias("crowded"))  # an entry a table
    group = ["tab", "sig", "lo", "hi"]
    dealt = signed.select("rep", "s1", "s2", "signs").join(crowded, "rep", "left").select("rep", "s1", "s2", "crowded", F.posexplode("signs").alias("tab", "sig"))
    own = F.filter("crowded", lambda x: x["tab"] == F.col("tab"))
    dealt = dealt.withColumn("blocks", F.coalesce(F.get(own, F.lit(0))["blocks"], F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tab", "sig", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "s1", "s2")
    gathered = lambda rows: rows.repartition(tasks(spark), *group).sortWithinPartitions(*group)
    members, _ = keep(gathered(dealt).mapInArrow(_members(near_signs(limit)), "tab int, sig int, lo int, hi int, own int, rep long"), "members")
    vectors_of = members.join(signed.select("rep", "n", "raw", "signs"), "rep")
    found, _ = keep(gathered(vectors_of).mapInArrow(_groups(kind, limit), "a long, b long, links long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    known = signed.select("raw", "rep", "n").join(links, "rep", "left").join(roots, "rep", "left")
    known = known.select("raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = usable.join(known, "raw").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    apart = rows.where("raw is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(apart)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
      WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS root FROM e
      UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.node AS vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.node = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.node
"""
