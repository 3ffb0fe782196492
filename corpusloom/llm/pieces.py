"""Operator 8, SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised by the model's own rules and cut before each run of space marks
that follows another character; no piece of a merge-type vocabulary reaches across such
a cut (asserted when the model is loaded), so the parts are encoded independently and
their ids remembered. A part's symbols start as its characters. An agenda holds each
adjacent pair whose concatenation is a piece, best score first, leftmost among equals;
taking a pair joins its symbols and puts the new neighbours' pairs on the agenda. Parts of
up to 64 characters have their agendas worked off side by side in arrays, a pair of each
in a step; longer ones have a heap each. Symbols that are no piece fall back to their UTF-8 bytes' pieces, or to the unknown id.

Every Arrow batch checks each part that is new to the worker against the sentencepiece
library's own encoding and stops on any difference. A part that the library can't be given on its own (it begins with
no space mark or with several, or normalises differently) has the texts that hold it checked whole. Decoding is the library's. Models of
another type than BPE, and those with user-defined symbols, which match before merges, are refused.

Edge cases: null text is empty, has no ids and decodes to the empty text; a text may be as long as a task's memory allows,
some tens of times its size; rows repeat as
they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Remembered, alone, binary, bytes_of, table, text_bytes, utf8

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_MARK = MARK.encode()
AT_ONCE, NEW_AT_ONCE = 1000, 20_000  # texts; new parts
SHORT = 64
NONE = np.int64(1) << 62

_models: dict[str, Pieces] = {}


#: Fixed values of the model file's format: the merge type, and the type of user-defined symbols.
BPE, USER_DEFINED = 2, 4


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


def _model_types(raw: bytes) -> tuple[int, set[int]]:
    """The model's type and the types of its pieces; both are 1 where the file names none."""
    kind, types = 1, set()
    for field, value in _fields(raw):
        if field == 1:
            types.add(next((x for f, x in _fields(value) if f == 3), 1))
        elif field == 2:
            kind = next((x for f, x in _fields(value) if f == 3), 1)
    return kind, types


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.library, self.library.get_piece_size()
        usual = [k for k in range(n) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))]
        kind, types = _model_types(m.serialized_model_proto())
        if kind != BPE or USER_DEFINED in types:
            raise ValueError("only models of the merge type without user-defined symbols are supported")
        self.ids = {m.id_to_piece(k): k for k in usual}
        self.cost = {m.id_to_piece(k): -m.get_score(k) for k in usual}
        self.bytes = {int(m.id_to_piece(k)[1:-1], 16): k for k in range(n) if m.is_byte(k)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece reaches across a space; this vocabulary isn't of the merge type that is supported")
        self.known = Remembered(3, 500_000)
        self.size = n
        self.decimal = pa.array([f"{k},".encode() for k in range(n)], pa.binary())
        self.char = np.arange(0x110000, dtype=np.int64) + n  # characters that are no piece get numbers beyond the pieces'
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = k
        symbol = lambda s: self.ids.get(s, n + ord(s) if len(s) == 1 else None)
        rank = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
        pairs = sorted((a << 32 | b, k, rank[self.cost[s]]) for s, k in self.ids.items() for cut in range(1, len(s)) if (a := symbol(s[:cut])) is not None and (b := symbol(s[cut:])) is not None)
        self.pair, self.joined, self.rank = (np.array([*x, -1], np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.array([-1]),) * 3
        self.pair[-1] = NONE

    def merge(self, part: str) -> list[str]:
        """The part's pieces, by the agenda of adjacent pairs."""
        symbols, cost = list(part), self.cost.get
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for k in range(n - 1):
            c = cost(symbols[k] + symbols[k + 1])
            if c is not None:
                agenda.append((c, k, symbols[k] + symbols[k + 1]))
        heapify(agenda)
        while agenda:
            _, left, joined = heappop(agenda)
            right = after[left]
            if symbols[left] is None or right >= n or symbols[left] + symbols[right] != joined:
                continue  # one of them has been joined meanwhile
            symbols[left], symbols[right] = joined, None
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                c = cost(joined + symbols[far])
                if c is not None:
                    heappush(agenda, (c, left, joined + symbols[far]))
            near = before[left]
            if near >= 0:
                c = cost(symbols[near] + joined)
                if c is not None:
                    heappush(agenda, (c, near, symbols[near] + joined))
        return [s for s in symbols if s is not None]

    def to_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(part):
            k = self.ids.get(s)
            if k is not None:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            elif not out or out[-1] != self.library.unk_id():
                out.append(self.library.unk_id())
        return out

    def _side_by_side(self, parts: list[str]) -> list[bytes | None]:
        """Each part's ids as 32-bit numbers; None where a symbol is no piece and the vocabulary has no bytes."""
        symbol = self.char[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        size = np.array([len(p) for p in parts])
        first = np.cumsum(size) - size
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first + size - 1], before[first] = n, -1
        symbol = np.append(symbol, NONE >> 32)  # what stands after a part: joins nothing
        result, agenda = np.zeros(n, np.int64), np.full(n, NONE)

        def judge(at: np.ndarray) -> None:
            pair = symbol[at] << 32 | symbol[after[at]]
            k = np.searchsorted(self.pair, pair)
            hit = self.pair[k] == pair
            result[at] = self.joined[k]
            agenda[at] = np.where(hit, self.rank[k] << 32 | at, NONE)

        judge(np.arange(n))
        while True:
            best = np.minimum.reduceat(agenda, first)
            left = best[best < NONE] & 0xFFFFFFFF
            if not len(left):
                break
            right = after[left]
            symbol[left] = result[left]
            symbol[right], agenda[right] = -1, NONE
            after[left] = far = after[right]
            before[far[far < n]] = left[far < n]
            judge(left)
            near = before[left]
            judge(near[near >= 0])
        left = symbol[:n] >= 0
        count = np.add.reduceat(left, first, dtype=np.int64)
        ids, part = symbol[:n][left], np.repeat(np.arange(len(first)), count)
        odd = ids >= self.size
        none = np.zeros(len(first), bool)
        if odd.any() and self.bytes:  # characters that are no piece, as their bytes' pieces
            chars, which = np.unique(ids[odd] - self.size, return_inverse=True)
            raw = [[self.bytes[b] for b in chr(c).encode()] for c in chars.tolist()]
            size = np.ones(len(ids), np.int64)
            size[odd] = np.array([len(x) for x in raw])[which]
            start = (np.cumsum(size) - size)[odd]
            ids, part = np.repeat(ids, size), np.repeat(part, size)
            for k in range(4):
                some = size[odd] > k
                ids[start[some] + k] = np.array([x[k] if k < len(x) else 0 for x in raw])[which[some]]
            count = np.bincount(part, minlength=len(first))
        elif odd.any():
            none[part[odd]] = True
        raw, ends = ids.astype(np.int32).tobytes(), np.cumsum(count)
        return [None if x else raw[4 * (e - c) : 4 * e] for e, c, x in zip(ends.tolist(), count.tolist(), none.tolist(), strict=True)]

    def _all_ids(self, parts: list[str]) -> list[bytes]:
        """Each part's ids as 32-bit numbers."""
        out: list = [None] * len(parts)
        order = sorted((k for k in range(len(parts)) if len(parts[k]) <= SHORT), key=lambda k: len(parts[k]))
        for at in range(0, len(order), 4096):  # of like lengths, so that they end together
            some = order[at : at + 4096]
            for k, ids in zip(some, self._side_by_side([parts[k] for k in some]), strict=True):
                out[k] = ids
        return [np.array(self.to_ids(p), np.int32).tobytes() if ids is None else ids for p, ids in zip(parts, out, strict=True)]

    def _new(self, parts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Each part's ids, by the agenda, held against the library's; and a byte for those that can't be."""
        out = self._all_ids(parts)
        plain = [k for k, p in enumerate(parts) if len(p) > 1 and p[0] == MARK and p[1] != MARK and self.library.normalize(p[1:]) == p]
        theirs = self.library.encode([parts[k][1:] for k in plain], num_threads=1)
        for k, other in zip(plain, theirs, strict=True):
            if out[k] != struct.pack(f"={len(other)}i", *other):
                raise ValueError(f"{parts[k]!r}: {np.frombuffer(out[k], np.int32).tolist()} differ from the library's {other}")
        unchecked = [b"?"] * len(parts)
        for k in plain:
            unchecked[k] = b""
        return out, unchecked

    def _made(self, parts: pa.Array) -> list[pa.Array]:
        """Ids of new parts as 32-bit numbers, and as decimals with a comma after each; a byte for those unchecked."""
        none = pa.array([], pa.binary())
        some = [self._new(parts.slice(k, NEW_AT_ONCE).cast(pa.string()).to_pylist()) for k in range(0, len(parts), NEW_AT_ONCE)]
        ids, unchecked = (pa.concat_arrays([none, *(pa.array(x[k], pa.binary()) for x in some)]) for k in (0, 1))
        data, at = bytes_of(ids)
        _, offsets, decimals = self.decimal.take(pa.array(data.view(np.int32))).buffers()
        return [ids, binary(np.frombuffer(offsets, np.int32)[at // 4], decimals), unchecked]

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Each text's ids as 32-bit numbers, and as decimals with a comma after each. Parts of many texts are numbered
        by Arrow, so that each different one is looked up once; results are gathered by their numbers."""
        column = pa.array([x.encode() for x in map(self.library.normalize, texts)], pa.binary())
        data, offsets = bytes_of(column)
        mark = np.zeros(len(data) + 3, bool)  # with no mark before the first byte
        if len(data) > 2:
            mark[3:-2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
        cut = mark[3:] & ~mark[:-3]
        cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        at = np.flatnonzero(cut)
        coded = binary(np.append(at, len(data)), data).dictionary_encode()
        first = np.searchsorted(at, offsets)
        out = []
        for values in self.known.values(coded.dictionary, self._made):
            _, ends, flat = values.take(coded.indices).buffers()
            out.append(binary(np.frombuffer(ends, np.int32)[first], flat) if len(at) else pa.array([b""] * len(texts), pa.binary()))
        ids, decimals, unchecked = out
        whole = np.flatnonzero(pc.binary_length(unchecked).to_numpy()).tolist()
        for k, theirs in zip(whole, self.library.encode([texts[k] for k in whole], num_threads=1), strict=True):
            if ids[k].as_py() != struct.pack(f"={len(theirs)}i", *theirs):
                raise ValueError(f"{texts[k][:200]!r}: ids differ from the library's")
        return ids, decimals


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _run(path: str, with_values: bool, also: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = model(path)
        alone(tool.known)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                got, decimals = tool.encode(utf8(batch.column("text")).cast(pa.string()).to_pylist())
                numbers, cuts = (x.view(np.int32) if k == 0 else x // 4 for k, x in enumerate(bytes_of(got)))
                ids = [numbers[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
                decoded = [tool.library.decode(x.tolist()) if len(x) else "" for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(cuts).astype(np.int64)),
                        pa.array([hashlib.sha256(x[:-1]).hexdigest() for x in decimals.to_pylist()], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                        pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(numbers)) if with_values else pa.nulls(batch.num_rows, pa.list_(pa.int32())),
                        pa.array([x if with_values else None for x in decoded], pa.string()),
                        *map(batch.column, also),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded", *also],
                )

    return run


def encode_decode(docs: DataFrame, path: str, with_values: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids and the decoded
    text if with_values; then its columns named in `also`, of type long. One pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), *also)
    more = "".join(f", {c} long" for c in also)
    return rows.mapInArrow(_run(path, with_values, also), f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string{more}")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL)).drop("ids", "decoded")
