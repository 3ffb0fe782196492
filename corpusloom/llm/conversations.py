"""Operator 13, conversation structure repair by weighted finite-state composition.

A conversation's rows are an acceptor: a chain of symbols, each the initial of a row's role with what is wrong with the row.
The edit transducer reads symbols and writes initials: Keep, Rerole, Delete, Insert, each with its cost and its
letter. The grammar acceptor accepts `(s?(ua)+)?` in four states. Their composition is never built: its states are pairs of a place in
the chain and a grammar state, met in topological order (places ascend; at one place two insertions at most follow each other, as three
come back to a state that is already reached for less). Paths are weighed by cost, then by the letters in ASCII order. In each
grammar state only one initial may come next beside s, so letters determine states and costs: of two equally cheap
paths to one state neither is a prefix of the other, and the order of the letters survives whatever follows.

That weight is associative, so a conversation of any length is cut into segments of at most `SEGMENT` rows. Each segment is reduced
by itself to the best paths from each grammar state to each; segments are then multiplied in their order, and letters that all
surviving paths share are put out at once. What is ordered, compared and grouped before are rows without their texts: role
initial, faults and a digest. Texts move once, to be hashed in order beside their letters, in a stream that holds one batch;
SHA-256 goes from front to back, so the texts of one conversation are one task's, but never in memory together.

Rows are taken by turn (nulls first), those of one turn by role, then by the SHA-256 of their text; equal rows may come in any order.

Edge cases: null conv_id, turn, role and text count as one space in the damage's key, role and text; a null conv_id is a conversation
of its own and comes back null; an empty role has no initial and isn't legal; roles count by their first character; turns so far
apart that their number doesn't fit give null gaps; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import alone, keep, table, tasks

SEGMENT = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}  # the turn that may follow
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

Weight = tuple[int, str]
Paths = dict[int, Weight]


def _insertions(paths: Paths) -> Paths:
    """The best paths to each state with up to two insertions at this place."""
    out = dict(paths)
    for _ in range(2):
        for g, (cost, letters) in list(out.items()):
            to, new = NEXT[g][1], (cost + INSERT, letters + "I")
            if to not in out or new < out[to]:
                out[to] = new
    return out


def _read(paths: Paths, sign: str) -> Paths:
    """The best paths over one more row."""
    out: Paths = {}

    def reach(to: int, new: Weight) -> None:
        if to not in out or new < out[to]:
            out[to] = new

    extra = TRUNCATED if sign.isupper() else 0
    initial = sign.lower()
    for g, (cost, letters) in paths.items():
        reach(g, (cost + DELETE, letters + "D"))
        if sign != "-":
            follows, to = NEXT[g]
            reach(to, (cost + REROLE + extra, letters + "R"))
            if initial == follows:
                reach(to, (cost + KEEP + extra, letters + "K"))
            if initial == "s" and g == START:
                reach(SYSTEM, (cost + KEEP + extra, letters + "K"))
    return out


def best_paths(signs: str, start: int) -> Paths:
    """Weights of the best paths over a segment from one grammar state to each; insertions before each row. Signs are the rows' initials,
    x for any but s, u and a; capitals for truncated rows, - for one that must be deleted."""
    paths: Paths = {start: (0, "")}
    for sign in signs:
        paths = _read(_insertions(paths), sign)
    return paths


@lru_cache(maxsize=4096)
def _short(signs: str) -> tuple[Paths, ...]:
    return tuple(best_paths(signs, g) for g in range(4))


def segment(signs: str) -> tuple[Paths, ...]:
    """best_paths from each grammar state."""
    return _short(signs) if len(signs) <= 32 else tuple(best_paths(signs, g) for g in range(4))


class Product:
    """Segments multiplied from the left. Letters that all paths share are final."""

    def __init__(self) -> None:
        self.paths: Paths = {START: (0, "")}
        self.done: list[str] = []

    def times(self, parts: tuple[Paths, ...]) -> None:
        out: Paths = {}
        for g, (cost, letters) in self.paths.items():
            for to, (more, rest) in parts[g].items():
                new = (cost + more, letters + rest)
                if to not in out or new < out[to]:
                    out[to] = new
        shared = os.path.commonprefix([x for _, x in out.values()])
        self.done.append(shared)
        self.paths = {g: (cost, x[len(shared) :]) for g, (cost, x) in out.items()}

    def result(self) -> Weight:
        paths = _insertions(self.paths)
        cost, letters = min(paths[g] for g in FINAL if g in paths)
        return cost, "".join(self.done) + letters


class Writer:
    """Hashes the repaired rows as they come, led by the letters of the audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.first = audit, 0, START, hashlib.sha256(), True

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        self.first = False

    def _turn(self) -> str:
        initial, self.state = NEXT[self.state]
        return ROLE[initial]

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._put(self._turn(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            if self.state == START and role[:1] == "s":
                self.state = SYSTEM
            else:
                self._turn()
            self._put(role, text)
        elif letter == "R":
            self._put(self._turn(), text)

    def end(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after damage: conv, turn, role, text, and copy (0, or 1 for the repetition)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), fate.alias("fate")).where("fate <> 0")
    out = out.withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return out.select("conv", "turn", "role", "text", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


BLANKS = " \t\n\x0b\x0c\r"


def _faults() -> tuple[Column, Column]:
    """Whether a row's text is blank, and whether it is truncated."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    return stripped == "", ~F.right(stripped, F.lit(1)).isin(".", "!", "?")


def _key() -> Column:
    return F.when(F.col("conv").isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), F.col("conv").cast("string")))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and cost of each conversation from its segments, which come in order."""
    alone()
    now, product, illegal, last = None, Product(), 0, ""

    def out() -> pa.RecordBatch:
        cost, audit = product.result()
        return pa.RecordBatch.from_pydict({"key": [now], "cost": [cost], "audit": [audit], "illegal": [illegal]}, pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())]))

    for batch in batches:
        done = []
        for key, signs, initials, pairs in zip(*(batch.column(c).to_pylist() for c in ("key", "signs", "initials", "pairs")), strict=True):
            if key != now:
                if now is not None:
                    done.append(out())
                now, product, illegal, last = key, Product(), 0, None
            product.times(segment(signs))
            illegal += pairs + (last is not None and last + initials[:1] not in LEGAL)
            last = initials[1:]
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if now is not None:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation: its audit comes first, then its rows in order."""
    alone()
    now, writer = None, None
    for batch in batches:
        keys, digests = [], []
        for key, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "audit", "role", "text")), strict=True):
            if audit is not None:
                if writer is not None:
                    keys.append(now)
                    digests.append(writer.end())
                now, writer = key, Writer(audit)
            else:
                writer.row(role, text)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "repaired_sha256": pa.array(digests, pa.string())})
    if writer is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([now], pa.string()), "repaired_sha256": pa.array([writer.end()], pa.string())})


def audited(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """For each conversation of rows (conv, turn, role, text, copy): key, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    spark = rows.sparkSession
    blank, cut = _faults()
    slim = rows.select(
        _key().alias("key"), "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), blank.alias("blank"), cut.alias("cut"), F.monotonically_increasing_id().alias("nth"),
    )
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest", "nth"]
    ordered = slim.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ordered, _ = keep(ordered.drop("nth"), "turns")
    same = ordered.where("not blank").groupBy("key", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = ordered.join(same, ["key", "role", "digest"], "left").withColumn("repeats", ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False)))
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    sign = F.when(F.col("blank") | F.col("repeats"), "-").when(F.col("cut"), F.upper(letter)).otherwise(letter)
    at = marked.select("key", "turn", "blank", "repeats", (~F.col("blank") & ~F.col("repeats") & F.col("cut")).alias("cut"), F.floor(F.col("place") / size).alias("part"), "place", sign.alias("sign"), letter.alias("initial"))
    parts = at.groupBy("key", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "sign", "initial"))).alias("rows"),  # at most `size` of some 20 bytes
        *(F.count_if(c).alias(n) for c, n in (("blank", "blank"), ("repeats", "duplicate"), ("cut", "truncated"))),
    )
    initials = F.array_join("rows.initial", "")
    pairs = F.transform(F.sequence(F.lit(2), F.length("initials")), lambda k: F.substring("initials", k - 1, F.lit(2)))
    parts = parts.select("key", "part", "blank", "duplicate", "truncated", F.array_join("rows.sign", "").alias("signs"), initials.alias("initials"))
    illegal = F.when(F.length("initials") < 2, 0).otherwise(F.size(F.filter(pairs, lambda x: ~x.isin(*LEGAL))))
    parts, _ = keep(parts.withColumn("pairs", illegal).withColumn("initials", F.concat(F.left("initials", F.lit(1)), F.right("initials", F.lit(1)))), "segments")
    paths = parts.select("key", "part", "signs", "initials", "pairs").repartition(tasks(spark), "key").sortWithinPartitions("key", "part").mapInArrow(_summed, "key string, cost long, audit string, illegal long")
    counts = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    turns = at.where("turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count("*").alias("n"))
    gaps = F.coalesce(F.try_add(F.try_subtract("most", "least"), 1 - F.col("n")), F.when(F.col("n").isNull(), F.lit(0)))
    return counts.join(paths, "key").join(turns, "key", "left").select("key", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] = damaged, conv: str = "conv_id", size: int = SEGMENT) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = conversations.sparkSession
    rows = damage(conversations)
    found, _ = keep(audited(rows, size), "audits")
    texts = rows.select(_key().alias("key"), F.lit(1).alias("kind"), "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit(None).cast("string").alias("audit"), "text")
    heads = found.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), "audit", F.lit("").alias("text"))
    stream = heads.union(texts).repartition(tasks(spark), "key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    digests = stream.select("key", "audit", "role", "text").mapInArrow(_hashed, "key string, repaired_sha256 string")
    ids = conversations.select(F.col(conv).alias("conv")).distinct().select(F.col("conv").alias("conv_id"), _key().alias("key"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return ids.join(found.withColumn("known", F.lit(True)), "key", "left").join(digests, "key", "left").select(
        "conv_id", F.when(F.col("known"), F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps"), *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
