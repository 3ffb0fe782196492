"""Operator 12, toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into windows of a few words, each
is compressed once with either, and the bytes that the toxic dictionary saves over the ordinary one are the window's
difference. Both dictionaries end in the same base, trained on ordinary text: what either class has in common costs the same
bytes twice, so a difference other than zero comes from what sets the classes apart. For the same reason the two trainers get
words that come in a larger share of the one class's documents than of the other's (by more deviations than chance gives the largest of as many words), each with its blanks, once for
each document that has it: trained on raw text, either dictionary fills with what all texts share.

The labelled rows with crc32(doc_id) % 5 other than 0 are split by a hash of the text, so that copies stay together. Three
fifths train the dictionaries, from a sample of at most `SAMPLE` texts of each class, bounded by `SAMPLE_BYTES`. All the
others calibrate them: a document's windows are counted by their difference, the counts by label give the weight of evidence of
each difference, and a logistic curve over the summed and the mean weight turns them into a probability. Differences above
zero never weigh less than smaller ones. The counts and sums are grouped in Spark; the curve is fitted on how many documents of
each label have which rounded weights.

Whole texts are scored, lower-cased, in Arrow batches, a bounded number of windows at a time. A word is a run of bytes that aren't
white space; windows have `WORDS` words, at most `LONGEST` bytes, and share one word with the next; longer runs of bytes are cut
in windows that overlap by half.

Edge cases: a null or empty text and one of white space have no windows and get the calibrated prior; without both
labels in the training part every score is 0; a null doc_id counts as the empty string for the fold, and its label is unknown; a
document with several labels is toxic if one says so; rows of one doc_id are scored each by its own text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import alone, bytes_of, drop, keep, table

SAMPLE, SAMPLE_BYTES = 3000, 24_000_000  # texts of each class, and bytes of both, that the dictionaries are trained on
BASE, OWN = 32_768, 8_192  # bytes of the shared base and of either class's own part at most
LEVEL, WORDS, LONGEST = 12, 6, 256
LOW, HIGH = -4, 7  # differences beyond these count as these
AT_ONCE = 200_000  # windows compressed in one call
FEATURES = ("total", "mean", "top")
RIDGE = 0.5
STEP = 0.25  # weights of evidence are rounded to this before the curve is fitted

_WORD = re.compile(r"[^\W_]+")
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def windows(data: np.ndarray, words: int = WORDS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a text's windows. Each begins with the blank before its first word and ends with the one after its last."""
    blank = np.concatenate(([True], _SPACE[data], [True]))
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.arange(0, max(1, len(starts) - 1), words - 1)
    at, end = np.maximum(starts[first] - 1, 0), np.minimum(ends[np.minimum(first + words - 1, len(ends) - 1)] + 1, len(data))
    size = end - at
    if (size > longest).any():
        pieces = np.maximum(1, -(-(size - longest // 2) // (longest // 2)))
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, end = np.repeat(at, pieces) + nth * (longest // 2), np.repeat(end, pieces)
        size = np.minimum(end - at, longest)
    return at, size


class Distance:
    """Differences of windows: bytes with the ordinary dictionary less bytes with the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.contents = (ordinary, toxic)

    def _tools(self) -> list[zstandard.ZstdCompressor]:
        raw = [zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in self.contents]
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=x, write_content_size=False, write_dict_id=False) for x in raw]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """For each text (bytes, lower-cased) the number of its windows by difference, LOW to HIGH."""
        tools = self._tools()
        data, offsets = bytes_of(texts)
        out = np.zeros((len(texts), HIGH - LOW + 1), np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # windows that wait for a call
        waiting = 0

        def compress() -> None:
            if not held:
                return
            own, at, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            begin = int(at.min())
            piece = data[begin : int((at + size).max())].tobytes()
            for s in range(0, len(at), AT_ONCE):
                view = zstandard.BufferWithSegments(piece, np.column_stack((at[s : s + AT_ONCE] - begin, size[s : s + AT_ONCE])).astype(np.uint64).tobytes())
                one, two = (np.fromiter(map(len, tool.multi_compress_to_buffer(view)), np.int64, len(view)) for tool in tools)
                np.add.at(out, (own[s : s + AT_ONCE], np.clip(one - two, LOW, HIGH) - LOW), 1)

        for k in range(len(texts)):
            at, size = windows(data[offsets[k] : offsets[k + 1]])
            if len(at):
                held.append((np.full(len(at), k), at + offsets[k], size))
                waiting += len(at)
            if waiting >= AT_ONCE:
                compress()
                waiting = 0
        compress()
        return out


def _frequencies(texts: list[str]) -> Counter:
    out: Counter = Counter()
    for x in texts:
        out.update(set(_WORD.findall(x)))
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the samples; of those too few for the trainer the distinct ones themselves."""
    mixed = [x for _, x in sorted((zlib.crc32(b"%d %b" % (k, x)), x) for k, x in enumerate(samples))]  # the trainer takes the best of each stretch
    try:
        return zstandard.train_dictionary(size, mixed, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def dictionaries(toxic: list[str], ordinary: list[str]) -> Distance:
    """Both dictionaries, trained on lower-cased texts."""
    t, o = _frequencies(toxic), _frequencies(ordinary)
    nt, no = max(1, len(toxic)), max(1, len(ordinary))

    def apart(w: str) -> float:
        p = (t[w] + o[w]) / (nt + no)
        return (t[w] / nt - o[w] / no) / math.sqrt(max(1e-12, p * (1 - p) * (1 / nt + 1 / no)))

    marks = {w: apart(w) for w in t.keys() | o.keys() if t[w] + o[w] > 1}
    edge = math.sqrt(2 * math.log(len(marks) + 2))  # what the largest of as many deviations reaches by chance
    of_toxic = sorted(w for w, z in marks.items() if z >= edge)
    of_ordinary = heapq.nsmallest(len(of_toxic), marks, key=lambda w: (marks[w], w))

    def samples(words: list[str], n: Counter) -> list[bytes]:
        return [f" {w} ".encode() for w in words for _ in range(n[w])]

    base = _trained([x[k : k + 64] for x in (y.encode() for y in ordinary) for k in range(0, len(x), 64)], BASE)
    return Distance(_trained(samples(of_ordinary, o), OWN) + base, _trained(samples(of_toxic, t), OWN) + base)


def _scored(distance: Distance):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            counts = distance.counts(batch.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1], pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), lists], ["doc_id", "part", "counts"])

    return run


def _weights(counts: np.ndarray) -> np.ndarray:
    """Weight of evidence of each difference from its windows in ordinary (row 0) and toxic documents (row 1). Above
    zero it doesn't fall: neighbours that would are pooled."""
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
    pools = [[share[0, k], share[1, k], 1] for k in range(-LOW, counts.shape[1])]
    k = 1
    while k < len(pools):
        if k and pools[k][1] * pools[k - 1][0] < pools[k - 1][1] * pools[k][0]:
            pools[k - 1] = [x + y for x, y in zip(pools[k - 1], pools.pop(k), strict=True)]
            k = max(1, k - 1)
        else:
            k += 1
    rising = [math.log(t / o) for o, t, n in pools for _ in range(n)]
    return np.concatenate((np.log(share[1, :-LOW] / share[0, :-LOW]), rising))


def _folds(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("part", F.when(F.crc32(key) % 5 == 0, "held out").when(F.pmod("hash", F.lit(5)) < 3, "dictionary").otherwise("calibration"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y"))
    return rows, known


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """For each row of docs: doc_id, held_out, score, predicted. labels: doc_id, toxic."""
    spark = docs.sparkSession
    rows, known = _folds(docs, labels, doc_id, text)
    chosen = rows.where("part = 'dictionary'").select("doc_id", "hash").join(known, "doc_id").groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    chosen, path = keep(chosen, "chosen")
    sizes = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}
    some = F.lit(False)
    for y, n in sizes.items():
        some = some | ((F.col("y") == y) & (F.xxhash64("hash") <= F.lit(min(2**63 - 1, int(2**64 * min(1.0, 0.9 * sample / n)) - 2**63))))
    picked = rows.join(F.broadcast(chosen.where(some).select("doc_id", "hash", "y")), ["doc_id", "hash"])  # `sample` rows of 20 bytes a class
    picked = picked.dropDuplicates(["hash"])
    bounded = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)) <= SAMPLE_BYTES // 2
    read = picked.withColumn("fits", bounded).where("fits").select("y", "text", "hash").collect() if len(sizes) == 2 else []
    drop(spark, path)
    read.sort(key=lambda r: r["hash"])
    distance = dictionaries([r["text"] for r in read if r.y], [r["text"] for r in read if not r.y])
    scored, _ = keep(rows.select("doc_id", "part", F.col("text").cast("binary").alias("text")).mapInArrow(_scored(distance), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, part string, counts array<long>"), "toxicity")
    labelled = scored.where("part = 'calibration'").join(known, "doc_id")
    weights = F.lit(0.0)
    curve = None
    if len(sizes) == 2:
        bins = labelled.groupBy("y").agg(*(F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(HIGH - LOW + 1))).collect()
        counts = np.zeros((2, HIGH - LOW + 1))
        for r in bins:
            counts[r.y] = [r[f"n{k}"] or 0 for k in range(HIGH - LOW + 1)]
        weights = _evidence(_weights(counts))
        curve = _curve(labelled.select("y", "counts").withColumns(_features(weights)))
    probability = F.lit(0.0)
    if curve is not None:
        probability = 1 / (1 + F.exp(-sum((F.col(f) * F.lit(float(w)) for f, w in zip(FEATURES, curve, strict=False)), F.lit(float(curve[-1])))))
    out = scored.withColumns(_features(weights)).select("doc_id", (F.col("part") == "held out").alias("held_out"), probability.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def _evidence(weights: np.ndarray) -> Column:
    return sum((F.col("counts")[k].cast("double") * F.lit(float(w)) for k, w in enumerate(weights)), F.lit(0.0))


def _features(evidence: Column) -> dict[str, Column]:
    """The summed weight of evidence, signed and on a logarithmic scale, the mean one, and the largest difference. Rounded, so that documents can be counted by them."""
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    largest = F.lit(0.0)
    for k in range(HIGH - LOW + 1):
        largest = F.when(F.col("counts")[k] > 0, F.lit(float(max(0, k + LOW)))).otherwise(largest)
    return {
        "total": F.round(F.signum(evidence) * F.log1p(F.abs(evidence)) / STEP) * STEP,
        "mean": F.round(evidence / F.greatest(n, F.lit(1.0)) * 20) / 20,
        "top": largest,
    }


def _curve(labelled: DataFrame) -> np.ndarray | None:
    """Weights of the logistic curve, the constant last. Rounded features keep the groups few, whatever the number of documents."""
    groups = labelled.groupBy("y", *FEATURES).count().toPandas()
    if groups["y"].nunique() < 2:
        return None
    groups = groups.sort_values(["y", *FEATURES])
    x = np.column_stack((groups[list(FEATURES)].to_numpy(float), np.ones(len(groups))))
    y, n, w = groups["y"].to_numpy(float), groups["count"].to_numpy(float), np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method, a slight ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * RIDGE, x.T @ (n * (y - p)) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
