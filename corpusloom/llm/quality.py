"""Operator 5, quality classifier by hierarchical empirical Bayes.

A document's own evidence is the probability that a logistic regression on a dozen
measures of its whole text gives. It is fitted by Newton's method on the labelled
documents, at most `sample` (20,000) of them, those whose hash of doc_id is below a
threshold set by the number of labels; everything else covers all documents.

Documents belong to a host (here the source) and a path below it (here the language).
Sums of the documents' probabilities for each path and host, grouped with partial sums,
give Beta posteriors: a host's mean is drawn towards the global mean, a path's towards
its host's, each by a number of pseudo-documents estimated from the spread between
groups (method of moments), so sparse sites take their prior. A document's log-odds are
its own plus its path's, without its own part in it, less the global ones; it is kept if
they aren't negative.

Edge cases: null text is empty; null host or path is a group of its own; labels without
a document or with null quality are left out, several labels of one doc_id are averaged, and
so are the measures of several rows of one; without both kinds of label every document has
probability 1/2 and is kept; rows repeat as they are, and rows with a null doc_id are judged
like others; an empty table gives an empty result; a text is measured in one piece, which takes
about ten times its size; other columns are ignored by `classify` and kept by `kept`, whatever
their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import alone, drop, keep, row_of, table, text_bytes

SAMPLE = 20_000
AT_ONCE = 500
#: Bytes that count as upper case, digits, symbols and exclamations.
UPPER_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
CALLS = b"!?"
MEASURES = ["words", "word_length", "upper", "digits", "symbols", "calls", "bars", "variety", "top_word", "repeated_lines", "wordless", "lines"]


def measure(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    bare = text.translate(None, SYMBOLS + CALLS + DIGITS + b".,;:-'\"()").split()
    return [
        math.log1p(n), min(40.0, size / max(1, n)), share(UPPER_BYTES), share(DIGITS), share(SYMBOLS), share(CALLS), text.count(b"|") / size,
        math.log1p(len(counts)) / math.log1p(n) if n else 1.0, max(counts.values(), default=0) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0, 1 - len(bare) / max(1, n), len(lines) / max(1, n),
    ]


def _measured(texts: pa.Array) -> np.ndarray:
    """A row of measures for each text, a few texts in hand at a time."""
    alone()
    out = np.empty((len(texts), len(MEASURES)))
    for at in range(0, len(texts), AT_ONCE):
        for k, x in enumerate(texts.slice(at, AT_ONCE).to_pylist(), at):
            out[k] = measure(x)
    return out


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _measured(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(x[:, k].copy()) for k in range(len(MEASURES)))], ["doc_id", "y", *MEASURES])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights on the raw measures, the constant last."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1
    z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _logit(p):
    return F.ln(p) - F.ln(1 - p)


def _pseudo(groups: DataFrame, mean, centre) -> float:
    """Pseudo-documents of the groups' prior, by moments: groups has n and s (sum of probabilities)."""
    r = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("g"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - centre, 2)).alias("between"), F.sum(F.col("n") * mean * (1 - mean)).alias("var"),
    ).first()
    if not r.n or r.g < 2:
        return 1.0
    var = r["var"] / r.n
    spread = (r.between - (r.g - 1) * var) / max(1e-9, r.n - r.nn / r.n)
    return float(min(1e6, max(1.0, var / spread - 1))) if spread > 0 else 1e6


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights on the measures; None without both kinds of label. Labels are cut to about `sample` by a threshold on
    the hash of doc_id before any text is read; only those few ids go to all tasks, and their measures to the driver."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    known = known.where("doc_id is not null")
    n = known.count()
    if n > sample:
        known = known.where(F.xxhash64("doc_id") < F.lit(int(2**64 * 0.95 * sample / n) - 2**63))
    chosen, path = keep(known, "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` ids of 16 bytes
    kinds = "doc_id long, y double, " + ", ".join(f"{m} double" for m in MEASURES)
    rows = texts.mapInArrow(_measures, kinds).groupBy("doc_id").agg(F.first("y").alias("y"), *(F.avg(m).alias(m) for m in MEASURES))
    rows = rows.withColumn("h", F.xxhash64("doc_id")).toPandas().sort_values("h").head(sample)
    drop(docs.sparkSession, path)
    y = (rows["y"].to_numpy() >= 0.5).astype(float)
    return fit(rows[MEASURES].to_numpy(), y) if 0 < y.sum() < len(y) else None


def probability(w: np.ndarray | None):
    """A function of the text's bytes: the classifier's probability that the document is good."""

    @F.arrow_udf("double")
    def p(texts: pa.Array) -> pa.Array:
        if w is None:
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(1 / (1 + np.exp(-np.clip((_measured(texts) * w[:-1]).sum(axis=1) + w[-1], -14.0, 14.0))))

    return p


class Sites:
    """Posteriors of hosts and paths, from sums over all documents."""

    def __init__(self, scored: DataFrame):
        """scored: host, path, p of every document."""
        paths, _ = keep(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
        self.mean = total.s / total.n if total.n else 0.5
        k1 = _pseudo(hosts, F.lit(self.mean), F.lit(self.mean))
        hosts = hosts.select("host", ((F.col("s") + k1 * self.mean) / (F.col("n") + k1)).alias("host_posterior"))
        self.paths = paths.join(hosts, "host")
        self.pseudo = _pseudo(self.paths, F.col("host_posterior"), F.col("host_posterior"))

    def judge(self, docs: DataFrame) -> DataFrame:
        """docs (host, path, p, others) with host_posterior, path_posterior and odds."""
        out, k = docs.join(self.paths, ["host", "path"]), self.pseudo
        rest = (F.col("s") - F.col("p") + k * F.col("host_posterior")) / (F.col("n") - 1 + k)
        odds = _logit(F.col("p")) + _logit(F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), rest))) - F.lit(math.log(self.mean) - math.log(1 - self.mean))
        return out.withColumns({"path_posterior": (F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k), "odds": odds})


def _site(column: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n"))


def _good():
    return F.round("odds", 9) >= 0


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """For each row of docs: doc_id, p_document, host_posterior, path_posterior, posterior, keep."""
    p = probability(train(docs, labels, sample))
    scored, _ = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _site(host).alias("host"), _site(path).alias("path"), p(text_bytes()).alias("p")), "scored")
    out = Sites(scored).judge(scored)
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("odds")))))
    return out.select("doc_id", F.col("p").alias("p_document"), "host_posterior", "path_posterior", posterior.alias("posterior"), _good().alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """docs without those that `classify` rejects. Texts are measured again for the decision rather than written or
    shuffled: beside them goes only what is known of their path, one row for each."""
    p = probability(train(docs, labels, sample))
    rows = docs.select(_site(host).alias("host"), _site(path).alias("path"), p(text_bytes()).alias("p"), row_of(docs).alias("row"))
    return Sites(rows.select("host", "path", "p")).judge(rows).where(_good()).select("row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
