"""Near duplicates at a stated similarity of word shingles, for the pipeline's SimHash stage.

Fingerprints within two bits find copies that differ in a word or two. At the
similarity of 0.8 that a near-dedup stage must reach (five-word shingles, Jaccard),
SimHashes differ in six bits or more by the median, far beyond what the popcount bound
can tell from chance, so fingerprint links alone miss most such pairs. The stage
therefore takes its candidates from two searches and verifies all of them exactly:

- the fingerprint links of operator 1;
- 16 bands: under each of 16 hash orders a text's three least shingles form a key; texts
  of similarity s share a band with a chance near s cubed, so at 0.8 all 16 bands miss with
  a chance of 1 in 90,000. One shared band makes a pair a candidate.

A first pass tests each text of a band's group against the group's least and greatest
member (by a hash of the text), found by grouped minimum and maximum: two candidates for
each text and band, however large the group, which cover all pairs of groups of up to
three. Larger groups whose members the first pass has not brought into one component go
through a second pass, which leaves no pair of different components untested: groups are
dealt into blocks of bounded size, each pair of blocks is a task's work, and shared shingles
are counted through an inverted index. Pairs whose link is already known (same component)
need no test, and a pair of blocks returns the links that join its components, never all
pairs. Links of both passes are closed by connected components.

Edge cases: as for operator 1; texts without words are alike; texts of fewer words than
a shingle are alike only if their words are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.common import alone, in_groups, keep, row_of, tasks, text_bytes
from corpusloom.llm.components import connected_components
from corpusloom.llm.substring import LAST, _mix, in_pieces

SIZE, SIMILARITY = 5, 0.8
BANDS, LEAST = 16, 3
BLOCK, TEXTS = 1 << 19, 512  # shingles and texts in a block of the second pass, were texts dealt evenly

AT_ONCE = 1 << 18  # text bytes worked on at once
_MOST = np.uint64((1 << 64) - 1)
_SEEDS = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), ">u8").astype(np.uint64))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A key for each text (row) and band; texts without shingles share all keys. A text's shingles differ and are mixed
    one to one, so taking out the least leaves the next."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    some, size = np.flatnonzero(size), size[size > 0]
    if not len(some):
        return out
    flat, first = np.concatenate([sets[k] for k in some]), np.cumsum(size) - size
    for k, seed in enumerate(_SEEDS):
        h = _mix(flat ^ seed)
        key = np.zeros(len(some), np.uint64)
        for j in range(LEAST):
            least = np.minimum.reduceat(h, first)
            key = np.where(size > j, _mix(key * np.uint64(3) + least), key)
            if j + 1 < LEAST:
                h[h == np.repeat(least, size)] = _MOST
        out[some, k] = key
    return out


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for whole in batches:
            for batch, texts in in_pieces(whole, "text", AT_ONCE):
                sets = [shingle_set(x, size) for x in texts]
                fps = [int.from_bytes(simhash.simhash(x), "big", signed=True) for x in texts]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(bands(sets).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rid"), pa.array(fps, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists], ["did", "rid", "fp", "n", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([shingle_set(x.as_py(), size).tobytes() for x in batch.column("text")], pa.binary())], ["rid", "shingles"])

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return run


def _join(group: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (rid, rid) that join the components of a group's texts: all pairs, or those across its two blocks."""
    rid, label, own = (group.column(c).to_numpy() for c in ("rid", "root", "own"))
    label = np.unique(label, return_inverse=True)[1]
    n = group.column("n").to_numpy()
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    rows, cols = (np.arange(len(rid)), np.arange(len(rid))) if lo == hi else (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
    found: tuple[list[int], list[int]] = ([], [])
    if not len(rows) or not len(cols):
        return rid[:0], rid[:0]
    raw = group.column("shingles").to_pylist()
    flat = np.frombuffer(b"".join(raw[k] for k in cols), np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], np.repeat(np.arange(len(cols)), n[cols])[order]
    for r in rows:
        other = (label[cols] != label[r]) & (np.minimum(n[cols], n[r]) >= similarity * np.maximum(n[cols], n[r]))
        if not other.any():
            continue
        x = np.frombuffer(raw[r], np.uint64)
        first, size = np.searchsorted(flat, x), np.searchsorted(flat, x, "right")
        size -= first
        ends = np.cumsum(size)
        both = np.bincount(holder[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], minlength=len(cols))
        for c in cols[other & (both >= similarity * (n[cols] + n[r] - both))]:
            if label[c] != label[r]:
                found[0].append(r)
                found[1].append(c)
                label[label == label[c]] = label[r]
    return rid[found[0]], rid[found[1]]


def _joins(similarity: float):
    """Rows come sorted by group; only the group at hand is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ("band", "key", "lo", "hi")):
            a, b = _join(group, similarity)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _keys(nodes: DataFrame) -> DataFrame:
    return nodes.select("rid", "n", F.posexplode("bands").alias("band", "key"))


def band_groups(nodes: DataFrame) -> DataFrame:
    """(band, key) of more than one text: size, least, most, and the texts' number of shingles."""
    return _keys(nodes).groupBy("band", "key").agg(F.count("*").alias("size"), F.min("rid").alias("least"), F.max("rid").alias("most"), F.sum("n").alias("total")).where("size > 1")


def candidates(nodes: DataFrame, similarity: float, groups: DataFrame | None = None) -> DataFrame:
    """Different pairs (a, b) of texts for the first pass to verify. nodes: rid, fp, n, bands."""
    by_fp = nodes.groupBy("fp").agg(F.min("rid").alias("first"))
    same = nodes.join(by_fp, "fp").where("rid <> first").select(F.col("first").alias("a"), F.col("rid").alias("b"))
    links = simhash.links(by_fp.select("fp"))
    name = lambda c: by_fp.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    near = links.join(name("a"), "a").join(name("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    groups = keep(band_groups(nodes), "bands")[0] if groups is None else groups
    met = _keys(nodes).join(groups.drop("size", "total"), ["band", "key"]).select("rid", F.explode(F.array("least", "most")).alias("other")).where("rid <> other")
    met = met.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")).distinct()
    side = lambda c: nodes.select(F.col("rid").alias(c), F.col("n").alias(f"{c}_n"))
    met = met.join(side("a"), "a").join(side("b"), "b").where(F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n")).select("a", "b")
    every = same.union(near).union(met).where("a <> b")
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def unjoined(keys: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK, texts: int = TEXTS) -> DataFrame:
    """Links (a, b) between components within the groups of more than three texts. keys: rid, n, band, key, total and size of
    these groups' members; roots: node, root; sets: rid, shingles."""
    rooted = keys.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    open_ = rooted.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band", "key")
    open_, _ = keep(open_, "open")  # beside an aggregation in its own stage the join couldn't split a hot group
    dealt = rooted.join(open_, ["band", "key"], "left_semi").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("total") / block), F.ceil(F.col("size") / texts)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rid"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rid", "n", "root", "band", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    sorted_groups = dealt.join(sets, "rid").repartition(tasks(keys.sparkSession), "band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi")
    return sorted_groups.mapInArrow(_joins(similarity), "a long, b long")


def one_of_each(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near duplicates: that of least doc_id (a null one counts as greatest), of
    its rows the one whose text has the least hash, of equal rows one. All columns stay."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(did.alias("did"), F.xxhash64(text_bytes()).alias("rid"), text_bytes().alias("text"))
    sketched, _ = keep(rows.mapInArrow(_sketch(size), "did long, rid long, fp long, n long, bands array<long>"), "sketches")
    nodes, _ = keep(sketched.groupBy("rid").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("did").alias("did")), "nodes")
    groups, _ = keep(band_groups(nodes), "bands")
    pairs, _ = keep(candidates(nodes, similarity, groups), "pairs")
    crowded, _ = keep(_keys(nodes).join(groups.where("size > 3").select("band", "key", "total", "size"), ["band", "key"]), "crowded")
    asked = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).union(crowded.select("rid")).distinct()
    texts = rows.select("rid", "did", "text").join(nodes.select("rid", "did"), ["rid", "did"], "left_semi").join(asked, "rid", "left_semi").dropDuplicates(["rid"])
    sets, _ = keep(texts.select("rid", "text").mapInArrow(_sets(size), "rid long, shingles binary"), "sets")
    side = lambda c, s: sets.select(F.col("rid").alias(c), F.col("shingles").alias(s))
    edges = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(_verify(similarity), "a long, b long")
    edges, _ = keep(edges, "links")
    more, _ = keep(unjoined(crowded, connected_components(edges), sets, similarity), "links")
    roots = connected_components(edges.union(more)).select(F.col("node").alias("rid"), "root")
    least = nodes.join(roots, "rid", "left").groupBy(F.coalesce("root", "rid").alias("root")).agg(F.min(F.struct("did", "rid")).alias("k"))
    keyed = docs.select(did.alias("did"), F.xxhash64(text_bytes()).alias("rid"), row_of(docs).alias("row"))
    return keyed.join(least.select("k.*"), ["did", "rid"], "left_semi").dropDuplicates(["did", "rid"]).select("row.*")
