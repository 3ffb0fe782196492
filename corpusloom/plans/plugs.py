"""Extension points (X-1 to X-7) and the stand-ins that tests use. No model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import chunks as chunk_rows
from corpusloom.operators import filters, retrieval


class Toolbox(Protocol):
    """What an agent may ask for; each tool answers a table of queries at once (X-1)."""

    def search(self, queries: DataFrame) -> DataFrame: ...
    def lookup(self, references: DataFrame) -> DataFrame: ...
    def timeline(self, queries: DataFrame) -> DataFrame: ...
    def neighbours(self, chunk_ids: DataFrame) -> DataFrame: ...
    def status(self, needle: str) -> DataFrame: ...


def encoder(make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16):
    """A column function text -> unit vector (R-4, X-2). `make` builds the model once a task; a batch that doesn't fit in
    memory is halved."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for series in texts:
            rows, at, size = [], 0, batch
            values = series.fillna("").tolist()
            while at < len(values):
                try:
                    got = np.asarray(model(values[at : at + size]), np.float32)
                except MemoryError:
                    if size == 1:
                        raise
                    size //= 2
                    continue
                rows += list(got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12))
                at += size
            yield pd.Series(rows)

    return encode


def pair_scorer(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """A column function (query, text) -> score (R-9, X-3)."""

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in parts:
            yield pd.Series(model(list(zip(q, t, strict=True))), dtype=float)

    return score


def hashed_encoder(dim: int = 16) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A stand-in encoder: hashed bags of words (X-7)."""

    def make():
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for k, t in enumerate(texts):
                for w in t.lower().split():
                    out[k, zlib.crc32(w.encode()) % dim] += 1
            out[:, 0] += 1e-3
            return out

        return encode

    return make


def tokenizer_spans(path: str, at_once: int = 1 << 20) -> Callable[[Column], Column]:
    """Character spans of a tokenizer file's tokens, for chunks (X-4). A task holds the tokens of some `at_once` characters and of one text, as
    numbers in Arrow's columns."""

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)

        def made(texts: pa.Array) -> pa.Array:
            found = [np.array(x.offsets, np.int32).reshape(-1, 2) for x in tool.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            start, end = np.ascontiguousarray(np.concatenate(found).T)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))

        for texts in batches:
            made_of = [made(x) for x in _slices(texts, at_once)]
            if made_of:
                yield pa.concat_arrays(made_of)

    return spans


def _slices(texts: pa.Array, at_once: int) -> list[pa.Array]:
    """Slices of some `at_once` bytes of text, or of one text."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // at_once
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def tokenizer_windows(path: str, at_once: int = 1 << 20) -> Callable[[Column, int, int], Column]:
    """Windows of a tokenizer file's tokens, for chunks (X-4): what `tokenizer_spans` and `chunk` cut, without the tokens of all texts."""

    def windows(text: Column, size: int, overlap: int) -> Column:
        if size <= overlap:
            raise ValueError("the stride must be positive")

        @F.arrow_udf("array<struct<ordinal: int, body: string, n_tokens: int>>")
        def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            from corpusloom.functions.tokens import tokens

            tool = tokens(path)
            for texts in batches:
                yield pa.concat_arrays([tool.windows(x, size, overlap) for x in _slices(texts, at_once) or [texts]])

        return cut(text)

    return windows


def structured(make: Callable[[], Callable[[str], str]], check: Callable[[object], str | None], attempts: int = 2):
    """A column function prompt -> struct of answer (JSON that passes the check, else null) and calls (X-5). check gives what is wrong with a parsed
    answer, or None; the next prompt has it, and then the model is given up."""
    import json

    @F.pandas_udf("answer string, calls int")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for prompts in batches:
            rows = []
            for prompt in prompts:
                answer, put, calls = None, prompt, 0
                while answer is None and calls < attempts and prompt is not None:
                    calls += 1
                    raw = model(put)
                    try:
                        wrong = check(json.loads(raw))
                    except (TypeError, ValueError) as e:
                        wrong = str(e)
                    answer = raw if wrong is None else None
                    put = f"{prompt}\n\nThe last answer doesn't fit the schema ({wrong}). Answer with JSON that does."
                rows.append((answer, calls))
            yield pd.DataFrame(rows, columns=["answer", "calls"])

    return ask


@dataclass
class Tables:
    """The tools over tables (X-1): an index of chunks, the chunks (chunk_id, volume_id, document_id, ordinal, date_from, date_to, text), the manifest."""

    index: retrieval.Index
    chunks: DataFrame
    manifest: DataFrame
    top_k: int = 10

    def search(self, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """queries: query_id, query; allowed: ids."""
        return retrieval.bm25(queries, self.index, self.top_k, allowed)

    def lookup(self, references: DataFrame) -> DataFrame:
        """references: query_id, volume_id, document_id."""
        return references.join(self.chunks, ["volume_id", "document_id"]).select("query_id", "chunk_id", "ordinal", "text")

    def timeline(self, queries: DataFrame) -> DataFrame:
        """queries: query_id, query, q_from, q_to: the best chunks of documents that overlap the dates, by date."""
        pairs = filters.overlapping(queries.select("query_id", "q_from", "q_to"), self.chunks.select(F.col("chunk_id").alias("id"), "date_from", "date_to")).select("query_id", "id", "date_from")
        hits = retrieval.bm25(queries, self.index, self.top_k, pairs.select("query_id", "id"))
        return retrieval.timeline(hits.join(pairs, ["query_id", "id"]))

    def neighbours(self, chunk_ids: DataFrame) -> DataFrame:
        return chunk_rows.adjacent(chunk_ids, self.chunks)

    def status(self, needle: str) -> DataFrame:
        return filters.series_status(self.manifest, needle)


@dataclass
class ScriptedModel:
    """A stand-in language model that answers from a script, in order, and counts its calls (X-5, X-7)."""

    script: list = field(default_factory=list)
    calls: int = 0

    def __call__(self, prompt: str, check: Callable[[object], bool] = lambda x: True):
        """The next answer that passes the check; one more is asked for after a bad one."""
        for _ in range(2):
            self.calls += 1
            answer = self.script.pop(0) if self.script else None
            if answer is not None and check(answer):
                return answer
        return None


def judged(runs: DataFrame, score: Column) -> DataFrame:
    """Scores by rule where there is one (an unanswerable case is right exactly if abstained; an abstained answerable one is
    wrong), by the judge elsewhere; null stays unjudged (X-6)."""
    abstained = F.col("outcome") == "abstained"
    rule = F.when(~F.col("answerable"), abstained.cast("double")).when(abstained, F.lit(0.0))
    return runs.withColumn("score", F.coalesce(rule, score))
