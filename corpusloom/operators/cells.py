"""An inverted file of product-quantised vectors, written once and opened by path (R-5).

    centroids        cell, vector: unit vectors, by k-means
    codebooks        part, code, vector: `CODES` codewords for each stretch of a residual
    codes/cell=c     id, code: a byte for each stretch, what a search reads of a probed cell
    vectors/cell=c   id, vector: for the exact score of a search's best candidates
    stats            rows, dim, cells, parts

k-means runs in Spark: each round assigns rows in Arrow batches, sums them by cell (combined before the shuffle) and brings one row a cell to the driver. It
trains on rows whose hash is below a threshold set by their number, `TRAINED` for each cell or codeword, none of which the
driver sees but the first centres. There are at most `MOST_CELLS` cells, so centroids and codebooks are a few megabytes whatever the
number of vectors; every vector is indexed.

A query goes to its `nprobe` nearest cells, whose numbers prune the partitions that are read. Within a cell a score is approximated from the codes,
as the product with the centroid plus one table entry for each stretch; the best `refine` times `limit` candidates of a query are
ranked exactly. Vectors that are null, zero, not finite or of another length than most aren't indexed, as they rank nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.postings import ranked
from corpusloom.sources import tables

MOST_CELLS, CODES, STRETCH = 4096, 256, 4  # STRETCH: components for each byte of a code
TRAINED, ROUNDS, SEED = 256, 10, 7
BLOCK = 8192  # codes that are scored at once


@dataclass(frozen=True)
class Cells:
    path: str
    centroids: np.ndarray
    codebooks: np.ndarray  # parts x CODES x stretch
    rows: int
    codes: DataFrame
    vectors: DataFrame


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and these as unit vectors."""
    lists = column.cast(pa.list_(pa.float64()))
    fine = np.array([x.is_valid and len(x) == dim and not x.values.null_count for x in lists], bool)
    x = lists.filter(pa.array(fine)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if fine.any() else np.zeros((0, dim))
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    fine[np.flatnonzero(fine)[~good]] = False
    return fine, x[good] / norm[good, None]


def _cell(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)


def _code(residual: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The nearest codeword of each stretch."""
    parts, _, width = codebooks.shape
    out = np.zeros((len(residual), parts), np.uint8)
    for p in range(parts):
        r, c = residual[:, p * width : (p + 1) * width], codebooks[p]
        out[:, p] = ((c * c).sum(axis=1)[None] - 2 * r @ c.T).argmin(axis=1) if len(r) else 0
    return out


def _padded(x: np.ndarray, width: int, parts: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1])))


def _sums(group, dim: int):
    """group: unit rows -> list of (part, code of each row, rows to add up). Partial sums of a batch, one row for each part and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _unit(batch.column("vector"), dim)
            part, code, n, sums = [], [], [], []
            for p, label, rows in group(x):
                for k in np.unique(label):
                    some = rows[label == k]
                    part.append(p)
                    code.append(int(k))
                    n.append(len(some))
                    sums.append(some.sum(axis=0))
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "code": pa.array(code, pa.int32()), "n": pa.array(n, pa.int64()), "sums": pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))})

    return run


def _gathered(rows: DataFrame, group, dim: int, width: int) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    parts = rows.mapInArrow(_sums(group, dim), "part int, code int, n long, sums array<double>")
    added = parts.groupBy("part", "code").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width))).collect()  # a row a centre
    return {(r.part, r.code): (r.n, np.array([r[f"s{k}"] for k in range(width)])) for r in added}


def _sample(rows: DataFrame, n: int, wanted: int) -> DataFrame:
    return rows if n <= wanted else rows.where(F.xxhash64(F.lit(SEED), "id") < F.lit(int(2**64 * wanted / n) - 2**63))


def write_cells(vectors: DataFrame, path: str, cells: int | None = None) -> Cells:
    """vectors: id, vector. By default one cell for each root of the number of vectors."""
    spark = vectors.sparkSession
    rows = vectors.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (sizes["dim"], sizes["count"]) if sizes else (0, 0)
    cells = max(1, min(cells or int(math.sqrt(n)), MOST_CELLS, max(1, n)))
    sample = tables.kept(_sample(rows, n, TRAINED * max(cells, CODES)), "trained")
    first = np.array([r.vector for r in sample.where(F.size("vector") == dim).orderBy(F.xxhash64(F.lit(SEED + 1), "id"), "id").limit(2 * cells).collect()], np.float64).reshape(-1, max(1, dim))
    norm = np.sqrt((first * first).sum(axis=1))
    first = first[np.isfinite(norm) & (norm > 0)] / norm[np.isfinite(norm) & (norm > 0), None]
    centroids = np.unique(first.round(12), axis=0)[:cells] if dim and len(first) else np.zeros((1, max(1, dim)))
    for _ in range(ROUNDS):
        now = centroids
        for (_, k), (_, s) in _gathered(sample, lambda x: [(0, _cell(x, now), x)], dim, len(now[0])).items() if dim else ():  # noqa: B023
            size = np.sqrt((s * s).sum())
            centroids = centroids if centroids is not now else now.copy()
            if size > 0:
                centroids[k] = s / size
    parts = max(1, -(-dim // STRETCH))
    final = centroids

    def stretches(x: np.ndarray) -> np.ndarray:
        return _padded(x - final[_cell(x, final)], STRETCH, parts)

    start = stretches(_unit(pa.array([r.vector for r in sample.orderBy(F.xxhash64(F.lit(SEED + 2), "id"), "id").limit(CODES).collect()], pa.list_(pa.float64())), dim)[1]) if dim else np.zeros((0, parts * STRETCH))
    codebooks = np.zeros((parts, CODES, STRETCH))
    for p in range(parts):
        codebooks[p, : len(start)] = start[:, p * STRETCH : (p + 1) * STRETCH]
        codebooks[p, len(start) :] = start[0, p * STRETCH : (p + 1) * STRETCH] if len(start) else 0
    for _ in range(ROUNDS if dim else 0):
        now = codebooks

        def coded(x: np.ndarray, now=now) -> list:
            r = stretches(x)
            code = _code(r, now)
            return [(p, code[:, p], r[:, p * STRETCH : (p + 1) * STRETCH]) for p in range(parts)]

        codebooks = now.copy()
        for (p, k), (m, s) in _gathered(sample, coded, dim, STRETCH).items():
            codebooks[p, k] = s / m
    kind = vectors.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, x = _unit(batch.column("vector"), dim)
            cell = _cell(x, final)
            code = _code(_padded(x - final[cell], STRETCH, parts), codebooks)
            kept = batch.filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), kept.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), kept.column("vector")], ["cell", "id", "code", "vector"])

    both = tables.kept(rows.mapInArrow(placed, f"cell int, id {kind}, code binary, vector array<double>"), "placed")
    by_cell = lambda df: df.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell")
    by_cell(both.select("cell", "id", "code")).parquet(f"{path}/codes")
    by_cell(both.select("cell", "id", "vector")).parquet(f"{path}/vectors")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, vector array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(p, k, codebooks[p, k].tolist()) for p in range(parts) for k in range(CODES)], "part int, code int, vector array<double>").write.mode("overwrite").parquet(f"{path}/codebooks")
    spark.createDataFrame([(both.count(), dim, kind)], "rows long, dim int, kind string").write.mode("overwrite").parquet(f"{path}/stats")
    return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> Cells:
    stats = spark.read.parquet(f"{path}/stats").first()
    centroids = np.array([r.vector for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()], np.float64)
    books = np.array([r.vector for r in spark.read.parquet(f"{path}/codebooks").orderBy("part", "code").collect()], np.float64).reshape(-1, CODES, STRETCH)
    opened = lambda name, more: spark.read.schema(f"id {stats.kind}, {more}, cell int").parquet(f"{path}/{name}")
    return Cells(path, centroids, books, stats.rows, opened("codes", "code binary"), opened("vectors", "vector array<double>"))


def _probed(index: Cells, nprobe: int):
    dim = index.centroids.shape[1]
    centroids = index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, q = _unit(batch.column("q_vector"), dim)
            near = np.argsort(-(q @ centroids.T), axis=1, kind="stable")[:, :nprobe].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * near.shape[1], pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").filter(pa.array(fine)), pa.array([x.tobytes() for x in q], pa.binary()), lists], ["query_id", "q", "cells"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes as blocks of one cell: cell, ids, the codes' bytes."""
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            for at in range(s, e, BLOCK):
                some = batch.slice(at, min(BLOCK, e - at))
                yield pa.RecordBatch.from_arrays([some.column("cell").slice(0, 1), pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("id")), pa.array([b"".join(some.column("code").to_pylist())], pa.binary())], ["cell", "ids", "codes"])


def _approximate(index: Cells, wanted: int):
    """For pairs of a query and a block (query_id, q, cell, ids, codes) the block's best `wanted` by approximate score."""
    parts = len(index.codebooks)
    centroids, books = index.centroids, index.codebooks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                q = np.frombuffer(batch.column("q")[k].as_py(), np.float64)
                cell, ids = batch.column("cell")[k].as_py(), batch.column("ids")[k].values
                entries = np.einsum("pcw,pw->pc", books, _padded(q[None], STRETCH, parts).reshape(parts, STRETCH))
                codes = np.frombuffer(batch.column("codes")[k].as_py(), np.uint8).reshape(-1, parts)
                about = q @ centroids[cell] + entries[np.arange(parts)[None], codes].sum(axis=1)
                best = np.argpartition(-about, wanted - 1)[:wanted] if len(about) > wanted else np.arange(len(about))
                query = batch.column("query_id").slice(k, 1).take(pa.array(np.zeros(len(best), np.int64)))
                out.append(pa.RecordBatch.from_arrays([query, ids.take(pa.array(best)), pa.array(np.full(len(best), cell, np.int32)), pa.array(about[best])], ["query_id", "id", "cell", "score"]))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def search(queries: DataFrame, index: Cells, nprobe: int, limit: int = 50, refine: int = 8) -> DataFrame:
    """(query_id, id, score, rank) by exact cosine of the best approximate candidates in the nprobe nearest cells. queries: query_id, q_vector."""
    q_kind, kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (index.codes, "id")))
    probes = tables.kept(queries.where("q_vector is not null").select("query_id", "q_vector").mapInArrow(_probed(index, nprobe), f"query_id {q_kind}, q binary, cells array<int>"), "probes")
    held = sorted(r[0] for r in probes.select(F.explode("cells")).distinct().collect())  # numbers of cells
    blocks = index.codes.where(F.col("cell").isin(held)).select("cell", "id", "code").mapInArrow(_blocks, f"cell int, ids array<{kind}>, codes binary")
    pairs = probes.select("query_id", "q", F.explode("cells").alias("cell")).join(blocks, "cell").select("query_id", "q", "cell", "ids", "codes")
    about = pairs.mapInArrow(_approximate(index, refine * limit), f"query_id {q_kind}, id {kind}, cell int, score double")
    candidates = ranked(about, refine * limit).select("query_id", "id", "cell")
    exact = candidates.join(index.vectors.where(F.col("cell").isin(held)), ["cell", "id"]).join(queries.select("query_id", "q_vector"), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("q_vector", "vector") / (F.sqrt(dot("q_vector", "q_vector")) * F.sqrt(dot("vector", "vector")))
    return ranked(exact.select("query_id", "id", F.round(cosine, 6).alias("score")), limit)
