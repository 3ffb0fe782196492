"""Operator 1, SimHash near-dedup.

Fingerprints are 64-bit SimHashes of word shingles. The links within a given
Hamming distance come from a segment-popcount embedding: a fingerprint is cut
into 16 segments of four bits and mapped to the vector of their bit counts. A
differing bit changes one count by one at most, so the Manhattan distance of two
vectors is a lower bound of the Hamming distance. Each point is replicated to the
unit grid cells within Manhattan radius 1, so two points at distance 2 or less
share a cell; what shares a cell is verified bit by bit.

A cell of two points is one candidate pair, which the grouped minimum and maximum
name without gathering rows. Points of fuller cells go to a second, exact grid
whose segments are single bits: there the embedding is the fingerprint itself, a
cell holds 65 points at most, all pairwise within the limit, and a star stands for
all its links. So no group emits its pairs, however many near copies it has.

What the first grid saves depends on how full its cells are: bit counts of random fingerprints fill some tens of
millions of cells densely, so above 10^8 different fingerprints nearly all cells are crowded, all points go to the second
grid as well, and a point costs 33 + 65 replicas of two numbers; cost stays in proportion to the number of points.

Edge cases: a text of any length is hashed in blocks of shingles, in memory of some ten times its size; a null or wordless text has fingerprint zero and is linked like any
other; one or two words are one shingle; rows of one doc_id with several texts keep
a row each and share links by fingerprint only; a null doc_id gets a fingerprint
and a null component if no other row shares its class; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import keep, row_of, table, text_bytes
from corpusloom.llm.components import connected_components

BITS, SEGMENT = 64, 4
LIMIT = 2  # the grids replicate to radius 1, half of it
_BLOCK = 1 << 15


def simhash(text: bytes, size: int = 3) -> bytes:
    """The fingerprint's 8 bytes, big-endian. A-Z count as a-z; words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    ones, n = np.zeros(BITS, np.int64), 0
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
    for at in range(0, len(digests), _BLOCK):
        part = digests[at : at + _BLOCK]
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, rid, fp) for each row of docs, rid a hash of the text; whole texts, one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join(simhash(x.as_py(), size) for x in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["doc_id", "rid", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("rid"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, rid long, fp long")


def _counts(fp):
    """The sixteen segments' bit counts, each in its own four bits of a long."""
    out = F.lit(0).cast("long")
    for k in range(0, BITS, SEGMENT):
        count = F.bit_count(F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(15))).cast("long")
        out = out.bitwiseOR(F.shiftleft(count, k))
    return out


def _replicas(points: DataFrame) -> DataFrame:
    """(fp, cell): the unit cells within Manhattan radius 1 of each point, as far as they lie in the grid."""
    near = points.select("fp", _counts(F.col("fp")).alias("at")).select("fp", "at", F.explode(F.sequence(F.lit(0), F.lit(2 * BITS // SEGMENT))).alias("k"))
    shift = f"{SEGMENT} * ((k - 1) div 2)"
    count, step = f"(shiftrightunsigned(at, int({shift})) & 15)", f"shiftleft(1L, int({shift}))"
    cell = f"CASE WHEN k = 0 THEN at WHEN k % 2 = 1 AND {count} > 0 THEN at - {step} WHEN k % 2 = 0 AND {count} < {SEGMENT} THEN at + {step} END"
    return near.select("fp", F.expr(cell).alias("cell")).where("cell is not null")


def links(points: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) whose transitive closure is that of
    all pairs at Hamming distance 2 or less."""
    grid = _replicas(points)
    cells, _ = keep(grid.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = cells.where("n = 2").where(apart <= LIMIT).select("a", "b")
    crowded = grid.join(cells.where("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct()
    flips = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("k")).select("fp", F.expr("CASE WHEN k < 0 THEN fp ELSE fp ^ shiftleft(1L, k) END").alias("cell"))
    exact = flips.groupBy("cell").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = exact.select("a", F.explode("all").alias("b")).where("a <> b").where(apart <= LIMIT)
    return pairs.union(stars).distinct()


def components(fps: DataFrame) -> DataFrame:
    """fps (doc_id, rid, fp) with root, which names the component, and component_id, its least doc_id."""
    points, _ = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = connected_components(links(points)).withColumnRenamed("node", "fp")
    known = points.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(known.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    fps, _ = keep(fingerprints(docs, size), "fps")
    return components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs with one row of each component: that of least doc_id (a null one counts as greatest), of its
    rows the one whose text has the least hash, of equal rows one. All columns stay."""
    fps, _ = keep(fingerprints(docs, size), "fps")
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    first = components(fps).groupBy("root").agg(F.min(F.struct(did.alias("did"), "rid")).alias("k")).select("k.*")
    keyed = docs.select(did.alias("did"), F.xxhash64(text_bytes()).alias("rid"), row_of(docs).alias("row"))
    return keyed.join(first, ["did", "rid"], "left_semi").dropDuplicates(["did", "rid"]).select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
