"""Windows over a tokenizer file's tokens, a column of texts at a time, in tasks."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes: white space that words have before them, those that begin characters none of which is white space to any tokenizer, ASCII's letters and its marks. Fixed values.
GAP = np.isin(np.arange(256), [10, 32])
SOLID = np.array([33 <= k < 127 or 0xC3 <= k < 0xE1 or 0xE4 <= k < 0xEF or 0xF0 <= k < 0xF5 for k in range(256)])
LETTER = np.array([chr(k).isalpha() and k < 128 for k in range(256)])
MARK = np.array([33 <= k < 127 and not chr(k).isalnum() for k in range(256)])
TOGETHER = 512  # pieces that are encoded as one text


class _Numbers(dict):
    """Numbers by piece, dealt when they are first asked for."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        return self.setdefault(piece, len(self))


class _Grown:
    """An array that others are added to."""

    def __init__(self, kind: type):
        self.size, self.held = 0, np.zeros(1024, kind)

    def add(self, more: np.ndarray) -> None:
        if self.size + len(more) > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.zeros(len(more) + self.size // 2, self.held.dtype)))
        self.held[self.size : self.size + len(more)] = more
        self.size += len(more)


def _before(sizes) -> np.ndarray:
    """The sum of the sizes before each, and of all."""
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value starts in them (one more entry at the end)."""
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def _values(texts: pa.Array) -> list[bytes]:
    data, at = _bytes_of(texts)
    raw, at = data.tobytes(), at.tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _characters(data) -> np.ndarray:
    """Where characters begin in UTF-8, and the end."""
    data = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero(data & 0xC0 != 0x80), len(data))


class Tokens:
    """A tokenizer that remembers where tokens stand in the pieces that texts are made of.

    A byte-level BPE with its own splitting always cuts before the last white space of a run that something else follows, and between a letter
    and a mark, so pieces from such places on are encoded independently, and many new ones that start with white space as one text. Texts with an
    added token's string are one piece, and so are all texts of tokenizers of other kinds. What is remembered goes when it takes more than some `most` bytes.
    """

    def __init__(self, path: str, most: int = 192 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        made = json.loads(self.library.to_str())
        split, model = made["pre_tokenizer"] or {}, made["model"]
        own = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        plain = not any(made[k] for k in ("normalizer", "post_processor", "truncation", "padding"))
        self.cuts = own and plain and model.get("type") == "BPE" and not model.get("dropout")
        self.added = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self.bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, k in self.library.get_vocab().items():  # byte-level: a character for each byte
            self.bytes[k] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known, self.held = _Numbers(), 0
        self.first, self.count = _Grown(np.int64), _Grown(np.int32)  # of each piece: its tokens
        self.start, self.end = _Grown(np.int32), _Grown(np.int32)  # of each token: its bytes in the piece, whole characters

    def _cut(self, texts: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pieces start."""
        cut = np.zeros(len(data), bool)
        if self.cuts:
            cut[:-1] = GAP[data[:-1]] & SOLID[data[1:]]
            cut[1:] |= LETTER[data[:-1]] & MARK[data[1:]]
            for x in self.added:
                for k in np.flatnonzero(pc.match_substring(texts, x).to_numpy(zero_copy_only=False)).tolist():
                    cut[at[k] : at[k + 1]] = False
        full = at[1:] > at[:-1]
        cut[at[1:][full] - 1] = False  # what follows is another text
        cut[at[:-1][full]] = True
        return np.flatnonzero(cut)

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each piece, and where they start and end in it; pieces that may stand side by side."""
        texts = [b"".join(pieces[k : k + TOGETHER]).decode() for k in range(0, len(pieces), TOGETHER)]
        ids = np.concatenate([np.array(x.ids, np.int64) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)])
        size = self.bytes[ids]
        end = np.cumsum(size)
        start = end - size
        at = _before(list(map(len, pieces)))
        of = np.searchsorted(at, start, "right") - 1
        if end[-1] != at[-1] or (end > at[of + 1]).any():
            raise ValueError("a token reaches across a space before a word; this tokenizer isn't of the kind that is supported")
        char = _characters(b"".join(pieces))
        start, end = char[np.searchsorted(char, start, "right") - 1], char[np.searchsorted(char, end)]
        return np.bincount(of, minlength=len(pieces)), start - at[of], end - at[of]

    def _alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.library.encode_batch([x.decode() for x in pieces], add_special_tokens=False)
        made = [_characters(p)[np.array(x.offsets, np.int64).reshape(-1, 2)] for p, x in zip(pieces, found, strict=True)]
        return np.array(list(map(len, made))), *np.concatenate(made).T

    def _learn(self, new: list[bytes]) -> None:
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        at, joined = _before(sizes)[:-1], b"".join(new)
        data = np.frombuffer(joined, np.uint8)
        inner = (sizes > 1) & GAP[data[at]] & SOLID[data[np.minimum(at + 1, len(data) - 1)]] & self.cuts
        for y in self.added:
            if y in joined:
                inner &= np.array([y not in x for x in new])
        first, count = np.zeros(len(new), np.int64), np.zeros(len(new), np.int32)
        for which, make in ((np.flatnonzero(inner), self._together), (np.flatnonzero(~inner), self._alone)):
            if len(which):
                count[which], start, end = make([new[k] for k in which.tolist()])
                first[which] = self.start.size + _before(count[which])[:-1]
                self.start.add(start)
                self.end.add(end)
        self.first.add(first)
        self.count.add(count)
        self.held += 160 * len(new) + len(data) + 8 * int(count.sum())

    def windows(self, texts: pa.Array, size: int, overlap: int) -> pa.Array:
        """Of each text a list of windows: ordinal, body (from the first token's start to the last one's end), n_tokens."""
        if self.held > self.most:
            self.forget()
        texts = pc.fill_null(texts, "").cast(pa.string()).cast(pa.binary())
        data, at = _bytes_of(texts)
        cut = self._cut(texts, data, at)
        pieces = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(np.append(cut, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        numbers = np.fromiter(map(self.known.__getitem__, _values(pieces.dictionary)), np.int64, len(pieces.dictionary))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        which = numbers[pieces.indices.to_numpy()]
        token = _before(self.count.held[which])  # before each piece
        before = token[np.searchsorted(cut, at)]  # before each text
        n, stride = np.diff(before), size - overlap
        number = np.where(n > 0, 1 + np.maximum(0, -((size - n) // stride)), 0)
        of = np.repeat(np.arange(len(texts)), number)
        ordinal = np.arange(len(of)) - _before(number)[of]
        a = before[of] + ordinal * stride
        z = np.minimum(a + size, before[of + 1]) - 1

        def place(t: np.ndarray, edge: _Grown) -> list[int]:
            p = np.searchsorted(token, t, "right") - 1
            return (cut[p] + edge.held[self.first.held[which[p]] + t - token[p]]).tolist()

        raw = data.tobytes()
        bodies = pa.array([raw[b:e] for b, e in zip(place(a, self.start), place(z, self.end), strict=True)], pa.string())
        rows = pa.StructArray.from_arrays([pa.array(ordinal, pa.int32()), bodies, pa.array(z - a + 1, pa.int32())], ["ordinal", "body", "n_tokens"])
        return pa.ListArray.from_arrays(pa.array(_before(number), pa.int32()), rows)


_tools: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """A worker's own for the file; what it remembers serves its next task, too."""
    if path not in _tools:
        _tools[path] = Tokens(path)
    return _tools[path]
