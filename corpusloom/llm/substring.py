"""Operator 9, substring dedup by prefix-partitioned suffix trees.

A window is `width` (20) consecutive words of one document. A word goes if a window
that covers it has the same words as a window that starts earlier: in a document of
smaller doc_id, or earlier in its own. Windows are judged on the input.

The way to the repeats:

1. Sparse suffixes. Each window elects its least 6-gram (by hash, leftmost on ties), a
   choice that depends on the window's words only, so equal windows elect the same one
   at the same offset. Only elected positions, a seventh or so, are shuffled, by the
   6-gram's hash; what comes once lies under no deep node. What a batch already knows to
   come twice is marked at once; its first position brings the batch's count, so a common
   passage sends one row a batch.
2. Prefix partition. A marked position's record is the text of the windows that elect it,
   34 words at most. Records meet by the 6 words at the elected position. A worker reads
   them sorted by prefix and takes as many prefixes at a time as make a memory-sized group
   (`group` records). Where 6 words aren't enough, the prefix is lengthened to all 20 words
   of each window: for the prefixes known beforehand to come more than `heavy` times (the
   `known` most frequent of these at most, so what all tasks are told is bounded), and in a
   second round for any other that turns out larger than a group. A group of a 20-word prefix is a
   single node and is read in order of place, holding its first leaf alone. Equal records
   of a batch are combined before they are sent.
3. Subtrees. The suffixes of a group's records are sorted, word by word, and neighbours'
   common prefixes measured. Runs of them that reach a depth are the subtree's internal
   nodes (`deep_nodes`); those of 20 words or more give the maximal repeats. A leaf that
   isn't the earliest below a node repeats the node's whole depth from where it starts.
   Words are numbered within a group by their bytes, so equal means equal; hashes choose
   candidates only.
4. Ranges of repeated window starts go back to their documents.

Documents without a marked position are done after step 1 and their text moves no more.

Edge cases: null text has no words; fewer than 20 words are kept whole; rows of one
doc_id with different texts are documents of their own, ordered by a hash of the text;
rows that are equal in both count as one document and each get its result; a null doc_id
comes after all others; empty tables give empty results; other columns are ignored (in
`remove_repeats` they are kept, whatever their names). A document may be as long as a task's
memory allows: about 40 times its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import alone, keep, row_of, table, tasks, text_bytes

WIDTH = 20
GRAM = 6
SPAN = WIDTH - GRAM + 1
LONGEST = 2 * WIDTH - GRAM  # words of the windows that can elect one position
GROUP = 20_000  # records in a worker's hands at once
HEAVY, KNOWN = 1000, 100_000
PIECE = 2 << 20  # text bytes worked on at once
LAST = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 40)) | np.uint64(1)


_GRAM_W = _weights(GRAM, 1)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, which of them belong to words, where the words start and how long they are."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = ~_SPACE[data]
    step = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(step == 1)
    return data, word, starts, np.flatnonzero(step == -1) - starts


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code of each word of the texts, and each text's first word (one more entry at the end)."""
    data, word, starts, lens = _words(texts)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    firsts = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int32) - np.repeat(at.astype(np.int32), lens)
    part = (data[word].astype(np.uint64) + np.uint64(1)) * _weights(int(lens.max()), 0)[place]
    return _mix(np.add.reduceat(part, at) + lens.astype(np.uint64)), firsts


class Clean:
    """The texts' words with one space between them, to cut records from."""

    def __init__(self, texts: list[bytes]):
        data, word, starts, lens = _words(texts)
        both = word.copy()
        both[starts + lens] = True  # the first space after each word
        self.data = np.where(word, data, np.uint8(32))[both].tobytes()
        self.at = np.concatenate(([0], np.cumsum(lens + 1)))

    def cut(self, first: np.ndarray, past: np.ndarray) -> list[bytes]:
        """The words from `first` up to `past` of each pair."""
        return [self.data[s:e] for s, e in zip(self.at[first].tolist(), (self.at[past] - 1).tolist(), strict=True)]


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += codes[k : k + n] * _GRAM_W[k]
    return _mix(out)


def elected(codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, first window, last window, text) of each elected 6-gram, and the 6-grams' hashes."""
    none = np.zeros(0, np.int64)
    if len(codes) < WIDTH:
        return none, none, none, none, np.zeros(0, np.uint64)
    grams = _grams(codes, GRAM)
    value, index, width = grams, np.arange(len(grams)), 1
    while width < SPAN:
        by = min(width, SPAN - width)
        left, right = slice(0, len(value) - by), slice(by, None)
        less = value[right] < value[left]
        value, index, width = np.where(less, value[right], value[left]), np.where(less, index[right], index[left]), width + by
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    start = np.flatnonzero(text[: len(codes) - WIDTH + 1] == text[WIDTH - 1 :])
    if not len(start):
        return none, none, none, none, grams
    at = index[start]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:] - 1, [len(start) - 1]))
    return at[head], start[head], start[tail], text[start[head]], grams


def in_pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in parts of about `limit` text bytes."""
    texts, at, size = [], 0, 0
    for k, x in enumerate(batch.column(column)):
        texts.append(x.as_py())
        size += len(texts[-1])
        if size >= limit:
            yield batch.slice(at, k + 1 - at), texts
            texts, at, size = [], k + 1, 0
    if texts:
        yield batch.slice(at), texts


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elected positions: (gram, did, pos, n). n: occurrences of the gram in this part of a batch, at the first
    of them; 0 at the others."""
    alone()
    for whole in batches:
        for batch, texts in in_pieces(whole, "text"):
            codes, firsts = word_codes(texts)
            at, _, _, text, grams = elected(codes, firsts)
            if not len(at):
                continue
            gram = grams[at].view(np.int64)
            _, first, count = np.unique(gram, return_index=True, return_counts=True)
            n = np.zeros(len(at), np.int64)
            n[first] = count
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(batch.column("did").to_numpy()[text]), pa.array((at - firsts[text]).astype(np.int32)), pa.array(n)], ["gram", "did", "pos", "n"])


def _repeated(heavy: int):
    """Of rows sorted by (n = 0, gram): the positions (did, pos) whose gram comes more than once, and (gram, n) of the
    grams that come more than `heavy` times. Holds a number for the gram at hand, and a row while it is the only one."""

    def marks(did: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(did), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(did), pa.array(pos), none, none], _MARKS)

    def totals(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(gram), pa.int64()), pa.nulls(len(gram), pa.int32()), pa.array(gram), pa.array(n)], _MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, waiting = None, 0, None  # the gram at hand, its occurrences so far, its row while there is but one
        for batch in batches:
            gram, did, pos, n = (batch.column(c).to_numpy() for c in ("gram", "did", "pos", "n"))
            known = n == 0
            if known.any():
                yield marks(did[known], pos[known])
                gram, did, pos, n = gram[~known], did[~known], pos[~known], n[~known]
            if not len(gram):
                continue
            starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            total = np.add.reduceat(n, starts)
            size = np.diff(np.concatenate((starts, [len(gram)])))
            if last is not None and gram[0] == last:
                total[0] += count
                if waiting is not None:
                    yield marks(*waiting)
            elif last is not None and count > heavy:
                yield totals(np.array([last]), np.array([count]))
            over = np.flatnonzero(total[:-1] > heavy)
            if len(over):
                yield totals(gram[starts[over]], total[over])
            twice = np.repeat(total > 1, size)
            if twice.any():
                yield marks(did[twice], pos[twice])
            last, count = gram[-1], int(total[-1])
            waiting = None if twice[-1] else (did[-1:], pos[-1:])
        if last is not None and count > heavy:
            yield totals(np.array([last]), np.array([count]))

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without marked positions get their result; the others keep text and positions."""
    for batch in batches:
        marked = batch.column("positions").is_valid().to_pylist()
        texts = batch.column("text").to_pylist()
        n, sha = [], []
        for x, m in zip(texts, marked, strict=True):
            words = [] if m else x.split()
            n.append(len(words))
            sha.append(None if m else hashlib.sha256(b" ".join(words)).hexdigest())
        text = pa.array([x if m else None for x, m in zip(texts, marked, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("did"), batch.column("rid"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), text, batch.column("positions")], ["doc_id", "did", "rid", "n_words", "kept_sha256", "text", "positions"])


def _marked(whole: pa.RecordBatch) -> Iterator[tuple]:
    """The marked positions of a batch of documents: codes, position, first and last window, text, grams; the part, its first words."""
    for batch, texts in in_pieces(whole, "text"):
        codes, firsts = word_codes(texts)
        at, lo, hi, text, grams = elected(codes, firsts)
        positions = batch.column("positions")
        counts = positions.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        wanted = np.repeat(firsts[:-1], counts) + positions.flatten().to_numpy()
        sel = np.isin(at, wanted)
        yield codes, at[sel], lo[sel], hi[sel], text[sel], grams, batch, firsts


_MARKS = ["did", "pos", "gram", "n"]
#: kind 0: settled ranges, 1: records by the gram they elect, 2: windows by a hash of their words.
SETTLED, BY_GRAM, BY_WINDOW = range(3)
_SUFFIX = "kind int, key long, did long, rid long, lo int, hi int, words binary"
_RANGE = "did long, rid long, lo int, hi int, words binary"


def _earliest(words: list[bytes], did: np.ndarray, rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal words: the earliest of each kind, and those at other places."""
    kind = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
    order = np.lexsort((start, rid, did, kind))
    new = np.concatenate(([True], kind[order][1:] != kind[order][:-1]))
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    own = (did[order] == did[head]) & (rid[order] == rid[head]) & (start[order] == start[head])
    return order[new], order[~own]


def _documents(did: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """Each row's document's number in the order of documents."""
    order = np.lexsort((rid, did))
    out = np.empty(len(did), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], (did[order][1:] != did[order][:-1]) | (rid[order][1:] != rid[order][:-1]))))
    return out


def _joined(did, rid, lo, hi) -> tuple[np.ndarray, ...]:
    """Ranges of the same document that touch each other as one."""
    order = np.lexsort((lo, rid, did))
    did, rid, lo, hi = did[order], rid[order], lo[order], hi[order]
    if not len(lo):
        return did, rid, lo, hi
    first = np.flatnonzero(np.concatenate(([True], (did[1:] != did[:-1]) | (rid[1:] != rid[:-1]) | (lo[1:] > hi[:-1] + 1))))
    return did[first], rid[first], lo[first], np.maximum.reduceat(hi, first)


def _rows(kind: int, key: np.ndarray, did: np.ndarray, rid: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: list[bytes] | None) -> pa.RecordBatch:
    n = len(key)
    text = pa.nulls(n, pa.binary()) if words is None else pa.array(words, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key.view(np.int64)), pa.array(did), pa.array(rid), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), text], ["kind", "key", "did", "rid", "lo", "hi", "words"])


def _settled(did, rid, lo, hi) -> pa.RecordBatch:
    did, rid, lo, hi = _joined(did, rid, lo, hi)
    return _rows(SETTLED, _mix(rid.view(np.uint64) ^ did.view(np.uint64)), did, rid, lo, hi, None)


def _windows(words: list[bytes], did: np.ndarray, rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The windows of records, a record's own starts being lo to hi: the earliest of equal ones, and what is settled."""
    if not words:
        return
    clean = Clean(words)
    n = (hi - lo + 1).astype(np.int64)
    first = np.cumsum(n + WIDTH - 1) - (n + WIDTH - 1)  # each record's first word
    own = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    start = lo.astype(np.int64)[own] + offset
    texts = clean.cut(first[own] + offset, first[own] + offset + WIDTH)
    head, again = _earliest(texts, did[own], rid[own], start)
    key = np.array([xxhash.xxh3_64_intdigest(texts[k]) for k in head.tolist()], np.uint64)
    yield _rows(BY_WINDOW, key, did[own][head], rid[own][head], start[head], start[head], [texts[k] for k in head.tolist()])
    if len(again):
        yield _settled(did[own][again], rid[own][again], start[again], start[again])


def _suffixes(heavy: np.ndarray):
    """Records of the marked positions: the words of the windows that elect them. Those whose gram is heavy come as windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for codes, at, lo, hi, text, grams, batch, firsts in _marked(whole):
                if not len(at):
                    continue
                did, rid = batch.column("did").to_numpy()[text], batch.column("rid").to_numpy()[text]
                words = Clean(batch.column("text").to_pylist()).cut(lo, hi + WIDTH)
                lo, hi = lo - firsts[text], hi - firsts[text]
                first, again = _earliest(words, did, rid, lo)
                if len(again):
                    yield _settled(did[again], rid[again], lo[again], hi[again])
                full = np.isin(grams[at[first]], heavy)
                light = first[~full]
                yield _rows(BY_GRAM, grams[at[light]], did[light], rid[light], lo[light], hi[light], [words[k] for k in light.tolist()])
                over = first[full]
                for k in range(0, len(over), GROUP):
                    some = over[k : k + GROUP]
                    yield from _windows([words[k] for k in some.tolist()], did[some], rid[some], lo[some], hi[some])

    return run


def deep_nodes(common: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Internal nodes of a suffix tree by depth from `width` on: the depth, and each node's first leaf and the leaf after
    its last. common: what each sorted leaf has in common with the one before it, 0 at the first."""
    for depth in np.unique(common[common >= width]).tolist():
        first = np.flatnonzero(common < depth)
        past = np.append(first[1:], len(common))
        is_node = np.logical_or.reduceat(common == depth, first)
        yield depth, first[is_node], past[is_node]


def repeated_depth(common: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """For each leaf: the depth of the deepest node of `width` or more below which it isn't the earliest, else 0."""
    out = np.zeros(len(common), np.int64)
    for depth, first, past in deep_nodes(common, width):
        size = past - first
        inside = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        least = np.repeat(np.minimum.reduceat(place[inside], np.cumsum(size) - size), size)
        out[inside[place[inside] != least]] = depth
    return out


def sorted_suffixes(ids: np.ndarray, start: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ids[start:past], each cut at LONGEST, in lexicographic order, and what each has in common with the one before."""
    column = np.arange(LONGEST)
    inside = start[:, None] + column < past[:, None]
    rows = np.where(inside, ids[np.minimum(start[:, None] + column, len(ids) - 1)] + 1, 0).astype(">u4")
    order = np.argsort(rows.view(f"V{4 * LONGEST}").ravel(), kind="stable")
    rows = rows[order]
    same = (rows[1:] == rows[:-1]) & (rows[1:] > 0)
    return order, np.concatenate(([0], np.where(same.all(axis=1), LONGEST, same.argmin(axis=1))))


def _subtrees(group: pa.Table) -> pa.RecordBatch | None:
    """Ranges of the window starts that repeat an earlier one, from the records of whole prefixes."""
    did, rid, lo, hi = _places(group)
    data = b" ".join([*group.column("words").to_pylist(), b""])
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    words = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data)])
    ids = words.dictionary_encode().indices.to_numpy()
    n = (hi - lo + 1).astype(np.int64)  # windows of each record
    past = np.cumsum(n + WIDTH - 1)
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    first = (past - n - WIDTH + 1)[row] + offset
    order, common = sorted_suffixes(ids, first, past[row])
    deep = common >= WIDTH
    deep |= np.append(deep[1:], False)
    if not deep.any():
        return None
    order, common = order[deep], common[deep]  # runs of leaves below deep nodes; the first of a run has less in common with the one before
    row, start = row[order], lo[row[order]] + offset[order]
    depth = repeated_depth(common, _documents(did, rid)[row] << 32 | start, WIDTH)
    again = np.flatnonzero(depth)
    row, start, depth = row[again], start[again], depth[again]
    return _ranges(*_joined(did[row], rid[row], start, start + depth - WIDTH))


def _ranges(did, rid, lo, hi, words: pa.Array | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(did), pa.array(rid), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.nulls(len(did), pa.binary()) if words is None else words], ["did", "rid", "lo", "hi", "words"])


def _single_nodes(windows: pa.RecordBatch, seen: dict) -> pa.RecordBatch:
    """Windows sorted by (key, place): those whose words came before. seen: the first places of the last key's words."""
    again = np.zeros(windows.num_rows, bool)
    rows = zip(*(windows.column(c).to_pylist() for c in ("key", "words", "did", "rid", "lo")), strict=True)
    for k, (key, words, *place) in enumerate(rows):
        if seen.get("key") != key:
            seen.clear()
            seen["key"] = key
        again[k] = seen.setdefault(words, place) != place
    found = windows.filter(pa.array(again))
    return _ranges(*_places(found))


def _in_groups(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by key as tables of whole prefixes, about `group` rows at a time. Rows of a prefix that has more come as they
    are read, told by True."""
    held: list[pa.RecordBatch] = []  # the last prefix's rows perhaps not all
    over = None
    for batch in chain(batches, [None]):
        if batch is not None:
            n = int((batch.column("key").to_numpy() == over).sum()) if over is not None else 0
            if n:
                yield pa.Table.from_batches([batch.slice(0, n)]), True
            if n == batch.num_rows:
                continue
            over = None
            held.append(batch.slice(n))
            if sum(x.num_rows for x in held) < group:
                continue
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        key = whole.column("key").to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        complete, at = len(cut) - (1 if batch is None else 2), 0
        while at < complete:
            to = min(complete, max(at + 1, int(np.searchsorted(cut, cut[at] + group, "right")) - 1))
            part = whole.slice(cut[at], cut[to] - cut[at])
            yield part, part.num_rows > group
            at = to
        rest = whole.slice(cut[complete])
        if rest.num_rows > group:
            over = key[-1]
            yield rest, True
        held = rest.to_batches() if 0 < rest.num_rows <= group else []


def _by_prefix(group: int):
    """Reads rows sorted by (kind, key, place). Out come ranges, and as they are the records of prefixes with more than `group`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: list[pa.RecordBatch] = []

        def of(kind: int) -> Iterator[pa.RecordBatch]:
            for batch in chain(ahead[:1], batches):
                ahead.clear()
                n = int(np.searchsorted(batch.column("kind").to_numpy(), kind, "right"))
                if n:
                    yield batch.slice(0, n)
                if n < batch.num_rows:
                    ahead.append(batch.slice(n))
                    return

        for batch in of(SETTLED):
            yield _ranges(*_places(batch))
        for part, over in _in_groups(of(BY_GRAM), group):
            if over:
                yield _ranges(*_places(part), _one(part.column("words")))
            elif part.num_rows > 1 and (found := _subtrees(part)) is not None:
                yield found
        seen: dict = {}
        for batch in of(BY_WINDOW):
            yield _single_nodes(batch, seen)

    return run


def _places(rows: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in ("did", "rid", "lo", "hi")]


def _one(column: pa.ChunkedArray) -> pa.Array:
    got = column.combine_chunks()
    return pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got


def _to_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch, words in in_pieces(whole, "words"):
            yield from _windows(words, *_places(batch))


def _mask(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n words the windows that start in the ranges cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + WIDTH, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(words: list[bytes], lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    if not len(lo):
        return words
    return [words[k] for k in np.flatnonzero(~_mask(len(words), lo.astype(np.int64), hi.astype(np.int64)))]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept words of documents with their repeated ranges, counted and digested."""
    for batch in batches:
        n, gone, sha = [], [], []
        for x, lo, hi in zip(batch.column("text"), batch.column("lo"), batch.column("hi"), strict=True):
            words = x.as_py().split()
            left = _kept(words, lo.values.to_numpy(), hi.values.to_numpy()) if lo.is_valid else words
            n.append(len(words))
            gone.append(len(words) - len(left))
            sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


@F.pandas_udf(T.StringType())
def _cut_text(texts: pd.Series, los: pd.Series, his: pd.Series) -> pd.Series:
    """The kept words joined by one space; null if all words are kept."""
    out = []
    for x, lo, hi in zip(texts, los, his, strict=True):
        out.append(None if lo is None or not len(lo) else b" ".join(_kept(bytes(x).split(), lo, hi)).decode("utf-8", "replace"))
    return pd.Series(out, dtype=object)


def _did():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _marked_positions(docs: DataFrame, heavy: int, known: int) -> tuple[DataFrame, np.ndarray]:
    """(did, positions) of documents (did, text) with positions that may start repeats, and the grams of more than
    `heavy` positions, at most `known`."""
    positions = docs.select("did", "text").mapInArrow(_positions, "gram long, did long, pos int, n long")
    first = F.col("n") > 0
    dealt = positions.repartition(tasks(docs.sparkSession), F.when(first, F.xxhash64("gram")).otherwise(F.xxhash64("did", "pos"))).sortWithinPartitions(first, "gram")
    marks, _ = keep(dealt.mapInArrow(_repeated(heavy), "did long, pos int, gram long, n long"), "marks")
    over = marks.where("gram is not null").orderBy(F.desc("n"), "gram").limit(known).select("gram").collect()
    return marks.where("pos is not null").groupBy("did").agg(F.collect_list("pos").alias("positions")), np.array([r.gram for r in over], np.int64).view(np.uint64)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(tasks(rows.sparkSession), "key").sortWithinPartitions("kind", "key", "did", "rid", "lo")


def _repeats(docs: DataFrame, heavy: np.ndarray, group: int) -> DataFrame:
    """(did, rid, lo, hi), arrays of the ranges of repeated window starts, from documents (did, rid, text, positions)."""
    suffixes = docs.select("did", "rid", "text", "positions").mapInArrow(_suffixes(heavy), _SUFFIX)
    found, _ = keep(_dealt(suffixes).mapInArrow(_by_prefix(group), _RANGE), "ranges")
    large = found.where("words is not null").mapInArrow(_to_windows, _SUFFIX)
    more = _dealt(large).mapInArrow(_by_prefix(group), _RANGE)
    ranges = found.where("words is null").union(more).groupBy("did", "rid").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    return ranges.select("did", "rid", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


def analyse(docs: DataFrame, group: int = GROUP, heavy: int = HEAVY, known: int = KNOWN) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _did().alias("did"), text_bytes().alias("text"))
    marks, over = _marked_positions(docs, heavy, known)
    joined = docs.join(marks, "did", "left").withColumn("rid", F.xxhash64("text")).select("doc_id", "did", "rid", "text", "positions")
    settled, _ = keep(joined.mapInArrow(_settle, "doc_id long, did long, rid long, n_words long, kept_sha256 string, text binary, positions array<int>"), "texts")
    open_docs = settled.where("positions is not null").select("doc_id", "did", "rid", "text", "positions")
    cut = open_docs.drop("positions").join(_repeats(open_docs, over, group), ["did", "rid"], "left").select("doc_id", "text", "lo", "hi")
    cut = cut.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return cut.union(settled.where("positions is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))


def remove_repeats(docs: DataFrame, group: int = GROUP, heavy: int = HEAVY, known: int = KNOWN) -> DataFrame:
    """docs with repeated words gone from text; n_chars, where there is one, follows. Texts that keep all
    their words stay as they are."""
    marks, over = _marked_positions(docs.select(_did().alias("did"), text_bytes().alias("text")), heavy, known)
    keyed = docs.select(_did().alias("did"), F.xxhash64(text_bytes()).alias("rid"), row_of(docs).alias("row"))
    joined, _ = keep(keyed.join(marks, "did", "left"), "texts", "zstd")
    open_docs = joined.where("positions is not null")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary")
    repeats = _repeats(open_docs.select("did", "rid", text.alias("text"), "positions"), over, group)
    cut = open_docs.join(repeats, ["did", "rid"], "left").withColumn("kept", _cut_text(text, "lo", "hi"))
    row = F.col("row").withField("text", F.coalesce("kept", "row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return cut.select(row.alias("row")).select("row.*").union(joined.where("positions is null").select("row.*"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyse(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) > 1 AS again FROM s),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
c AS (SELECT t.doc_id, j, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.j),
a AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
