"""Operator 10, document fingerprints by consistent weighted sampling (Ioffe 2010).

A document's terms are its words (A-Z as a-z), each weighted by its number of
occurrences. For sample k and term x, hashes of (x, k) give r and c from Gamma(2, 1)
and b from [0, 1); with weight w, t = floor(ln w / r + b), and the term with the least
ln c - r (t - b + 1) is sampled. Two documents sample the same (term, t) with a
probability that is the generalised Jaccard similarity of their weights, the sum of
lesser weights over the sum of greater ones. A fingerprint has 128 samples of 16 bits
each; the share of equal ones estimates that similarity with a standard error of 0.044
at most.

Documents are dealt by ranges of doc_id once, with their texts. A document's successor
in descending order stands before it in its range, so one pass over sorted ranges makes
nearly all results; the two ends of each range, written with their texts, are joined
with the neighbouring range's afterwards.

Edge cases: null text is empty; texts without words have the same fingerprint, all zero
digits; a null doc_id sorts after all others, and all rows without one share a range, which is read as a stream; rows of one doc_id are ordered by their
texts' bytes; a single row is its own successor; an empty table gives an empty result;
other columns are ignored. Long texts are sampled in blocks of terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import keep, table, tasks, text_bytes
from corpusloom.llm.substring import LAST, _mix, word_codes

SAMPLES = 128
PIECE = 1 << 20
BLOCK = 1 << 14

_SEEDS = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
_HALF, _U32, _U21 = np.float32(0.5), np.float32(2.0**-32), np.float32(2.0**-21)


def _unit(h: np.ndarray, shift: int, mask: int, unit: np.float32) -> np.ndarray:
    return ((h >> np.uint64(shift) & np.uint64(mask)).astype(np.uint32).astype(np.float32) + _HALF) * unit


def _keys(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each term (row) and sample (column) one number, ordered as the value that the least of is
    sampled; its low 32 bits are a hash of (term, t)."""
    h = _mix(codes[:, None] ^ _SEEDS)
    r = -np.log(_unit(h, 0, 0xFFFFFFFF, _U32) * _unit(h, 32, 0xFFFFFFFF, _U32))
    h = h * np.uint64(0xD1342543DE82EF95) + np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    ln_c = np.log(-np.log(_unit(h, 43, 0x1FFFFF, _U21) * _unit(h, 22, 0x1FFFFF, _U21)))
    b = _unit(h, 0, 0x1FFFFF, _U21)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)  # 0 where the weight is 1
    value = (ln_c - r * (t - b + np.float32(1))).view(np.int32)
    low = _mix(codes)[:, None] * (t.astype(np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return (value ^ (value >> 31 & 0x7FFFFFFF)).astype(np.int64) << 32 | (low >> np.uint64(32)).astype(np.int64)


def signatures(texts: list[bytes]) -> np.ndarray:
    """One row of SAMPLES 16-bit samples for each text."""
    codes, firsts = word_codes([t.lower() for t in texts])
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    if not len(codes):
        return out
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    order = np.lexsort((codes, text))
    codes, text = codes[order], text[order]
    at = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (text[1:] != text[:-1]))))
    weight = np.diff(np.concatenate((at, [len(codes)])))
    codes, text = codes[at], text[at]
    by_term = np.lexsort((weight, codes))  # terms that several texts share, at one weight, are drawn once
    c, w = codes[by_term], weight[by_term]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
    kind = np.empty(len(c), np.int64)
    kind[by_term] = np.cumsum(new) - 1
    c, w = c[new], w[new]
    best = np.full((len(texts), SAMPLES), LAST, np.int64)
    for lo in range(0, len(c), BLOCK):
        hi = min(len(c), lo + BLOCK)
        value = np.concatenate([_keys(c[k : k + 512], w[k : k + 512]) for k in range(lo, hi, 512) if k < hi])
        inside = (kind >= lo) & (kind < lo + BLOCK) if len(c) > BLOCK else slice(None)
        k, x = kind[inside] - lo, text[inside]
        cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
        for s, e in zip(cuts, [*cuts[1:], len(x)], strict=True):
            np.minimum(best[x[s]], value.take(k[s:e], axis=0).min(axis=0), out=best[x[s]])
    some = np.unique(text)
    out[some] = (best[some] & 0xFFFF).astype(np.uint16)
    return out


def edited(text: str, following: str) -> str:
    """text with its last third (by code points, rounded down) replaced by the following text's first as many."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_PASS = "doc_id long, part int, first boolean, last boolean, text binary, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double"


def _row(doc_id, part, first, last, text: str, sig, following, next_sig, new, new_sig) -> tuple:
    end = first or last
    known = following is not None
    return (
        doc_id, part, first, last, text.encode() if end else None, len(text),
        hashlib.sha256(new.encode()).hexdigest() if known else None,
        sig.tobytes(), new_sig.tobytes() if known else None,
        float((sig == new_sig).mean()) if known else None, float((sig == next_sig).mean()) if known else None,
    )


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, schema.field(k).type) for k, x in enumerate(zip(*rows, strict=True))], schema=schema)


_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("text", pa.binary()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.binary()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in ascending order; the last row so far waits, for it may end the range."""
    part = TaskContext.get().partitionId()
    before = None  # text and signature of the row before
    waiting: list[tuple] = []
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [x.decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and size < PIECE:
                size += len(texts[end])
                end += 1
            own = texts[at:end]
            nexts = [before[0] if before else None, *own[:-1]]
            news = [None if n is None else edited(x, n) for x, n in zip(own, nexts, strict=True)]
            sig = signatures([*(x.encode() for x in own), *((x or "").encode() for x in news)])
            rows = []
            for k, x in enumerate(own):
                next_sig = sig[k - 1] if k else before and before[1]
                rows.append((ids[at + k], x, sig[k], nexts[k], next_sig, news[k], sig[len(own) + k], before is None and k == 0))
            before = (own[-1], sig[len(own) - 1].copy())
            ready, waiting = [*waiting, *rows[:-1]], rows[-1:]
            if ready:
                yield _batch([_row(i, part, f, False, x, s, n, ns, e, es) for i, x, s, n, ns, e, es, f in ready], _ARROW.names, _ARROW)
            at = end
    if waiting:
        yield _batch([_row(i, part, f, True, x, s, n, ns, e, es) for i, x, s, n, ns, e, es, f in waiting], _ARROW.names, _ARROW)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First rows of ranges, with the row that follows each."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text, following = r["text"].decode(), r["next_text"].decode()
            new = edited(text, following)
            sig, next_sig = np.frombuffer(r["fp"], np.uint16), np.frombuffer(r["next_fp"], np.uint16)
            rows.append(_row(r["doc_id"], r["part"], True, True, text, sig, following, next_sig, new, signatures([new.encode()])[0]))
        if rows:
            yield _batch(rows, _ARROW.names, _ARROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs, with the next row in descending doc_id (after the last: the first): doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"))
    dealt = keyed.repartitionByRange(tasks(spark), "did").sortWithinPartitions("did", "text").select("doc_id", "text")
    walked, _ = keep(dealt.mapInArrow(_walk, _PASS), "walked")
    parts = sorted(r.part for r in walked.where("last").select("part").collect())  # one number for each range
    if parts:
        previous = spark.createDataFrame(list(zip(parts, [parts[-1], *parts[:-1]], strict=True)), "part int, next_part int")
        lasts = walked.where("last").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
        firsts = walked.where("first").select("doc_id", "part", "text", "fp").join(previous, "part").join(lasts, "next_part")
        walked = walked.where("not first").union(firsts.mapInArrow(_ends, _PASS))
    show = lambda c: F.lower(F.hex(c))
    return walked.select("doc_id", "n_chars", "edited_sha256", show("fp").alias("fingerprint"), show("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
