"""Operator 3, token-id output: canonical length-limited Huffman coding of token ids.

Whole texts are encoded with the tokenizers library and id 0 ends each document. Code
lengths come from the counts of all ids over all documents (one number for each id of
the vocabulary reaches the driver) by the package-merge algorithm, limited to 16 bits or
what the vocabulary needs; codes are canonical, so the lengths are the whole codebook.

The file format is a folder of three Parquet datasets, so that any store Spark writes to
serves, with its commit protocol:

  codebook  id, length: the code lengths of the ids that occur
  blocks    part, seq, start, doc_ids, n_tokens, offsets, payload
  index     part, start: ids before each part

Parts hold ascending ranges of doc_id, blocks within a part follow each other by seq. A
block is decoded on its own: payload has its documents' codes, each document from a
whole byte, most significant bit first; offsets are the bit offsets of checkpoints, one
at each document's start and after every 128 of its ids; start counts the part's ids
before the block. A reader looks 16 bits up in a table that gives id and length, at all
checkpoints in step.

Edge cases: null text is empty and gives the end id alone; a text may be as long as a task's memory allows, some ten times its
size, and stands in one block, which is as long as it needs; many null doc_ids share the last part, which is read as a stream; a null doc_id sorts last; rows
of one doc_id stand in the order of their codes; an empty table writes empty datasets;
other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Remembered, alone, binary, bytes_of, drop, keep, running, scratch, table, tasks, text_bytes, utf8
from corpusloom.llm.substring import LAST

END = 0
STRIDE = 128  # ids between checkpoints
BLOCK_IDS = 1 << 17
LIMIT = 16
AT_ONCE, TEXT_AT_ONCE = 10_000, 12 << 20  # texts, and their bytes
TOKENIZER = "byte_bpe_50k.json"

#: All that is white space to a tokenizer of any kind; more than one of them knows does no harm. Fixed values.
WHITE = "\t-\r\x1c- \x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
PLAIN = f"(?s)\\A[ \\n][^{WHITE}](?:.*[^{WHITE}])?\\z"
_BEYOND = [c.encode() for c in map(chr, range(128, 1 << 16)) if not 0xD800 <= ord(c) < 0xE000 and re.match(f"[{WHITE}]", c)]
_TWO, _THREE = (np.array([int.from_bytes(c, "big") for c in _BEYOND if len(c) == k], np.uint32) for k in (2, 3))
_SOLID = np.array([33 <= k < 127 for k in range(256)])  # bytes that are characters of their own and no white space

_encoders: dict[str, Encoder] = {}


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where to cut texts (offsets into their UTF-8 bytes): at their starts and before each space or line end that
    stands alone, between characters that are no white space."""
    cut = np.zeros(len(data), bool)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    lone = (_SOLID[before] | (before > 127)) & (_SOLID[after] | (after > 127))
    at, before, after = at[lone], before[lone], after[lone]
    wide = np.flatnonzero((before > 127) | (after > 127))
    if len(wide):
        byte = lambda k: data[np.clip(at[wide] + k, 0, len(data) - 1)].astype(np.uint32)
        white = np.isin(byte(-2) << 8 | byte(-1), _TWO) | np.isin(byte(-3) << 16 | byte(-2) << 8 | byte(-1), _THREE)
        white |= np.isin(byte(1) << 8 | byte(2), _TWO) | np.isin(byte(1) << 16 | byte(2) << 8 | byte(3), _THREE)
        at = np.delete(at, wide[white])
    cut[at] = True
    full = offsets[1:] > offsets[:-1]
    cut[offsets[1:][full] - 1] = False  # what follows is another text
    cut[offsets[:-1][full]] = True
    return np.flatnonzero(cut)


class Encoder:
    """A byte-level BPE tokenizer that remembers the ids of what stands between spaces.

    The tokenizer's own splitting always cuts before a space or a line end that stands alone between other
    characters, so pieces between such places, each with the space before it, are encoded independently. Many
    new ones are encoded as one text; the tokens' byte lengths tell whose they are. Pieces that would make
    a run of white space with their neighbours are encoded each on its own, and so are whole texts with an added token's string.
    All but that is done on Arrow's columns.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bytes = np.zeros(self.size, np.int64)
        for token, k in self.library.get_vocab().items():  # byte-level: a character for each byte
            self.bytes[k] = len(token)
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.known = Remembered(1)

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _together(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces that may stand side by side."""
        data, at = bytes_of(pieces)
        data, at = data.tobytes(), at.astype(np.int64)
        parts, sizes = [], []
        firsts = range(0, len(pieces), 512)
        texts = [data[at[k] : at[min(k + 512, len(pieces))]].decode() for k in firsts]
        for k, x in zip(firsts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(x.ids)
            ends = np.cumsum(self.bytes[ids])
            wanted = at[k + 1 : k + 513] - at[k]
            past = np.searchsorted(ends, wanted, "right")
            if (past == 0).any() or (ends[past - 1] != wanted).any():
                raise ValueError("a token reaches across a space that stands alone; this tokenizer isn't of the kind that is supported")
            parts.append(ids.astype(self.kind))
            sizes.append(np.diff(past, prepend=0))
        return binary(np.concatenate(([0], np.cumsum(np.concatenate(sizes)) * self.kind.itemsize)), np.concatenate(parts))

    def _new(self, pieces: pa.Array) -> list[pa.Array]:
        text = pieces.cast(pa.string())
        plain = reduce(pc.and_not, (pc.match_substring(text, x) for x in self.added), pc.match_substring_regex(text, PLAIN))
        together = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        out = [self._together(pieces.take(pa.array(together)))] if len(together) else []
        out.append(pa.array(self._alone(text.take(pa.array(rest)).to_pylist()), pa.binary()))
        return [pa.concat_arrays(out).take(pa.array(np.argsort(np.concatenate((together, rest)), kind="stable")))]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Each text's ids, little-endian, with the end id. texts: UTF-8, as binary."""
        n = len(texts)
        if not n:
            return pa.array([], pa.binary())
        data, offsets = bytes_of(texts)
        at = cut_points(data, offsets)
        if self.added:
            text = texts.cast(pa.string())
            for k in np.flatnonzero(reduce(pc.or_, (pc.match_substring(text, x) for x in self.added)).to_numpy(zero_copy_only=False)):
                at = at[(at <= offsets[k]) | (at >= offsets[k + 1])]
        coded = binary(np.append(at, len(data)), data).dictionary_encode()
        ids = pa.concat_arrays([*self.known.values(coded.dictionary, self._new), pa.array([np.array([END], self.kind).tobytes()], pa.binary())])
        ends = np.searchsorted(at, offsets[1:]) + np.arange(n)  # of each text's pieces, where the end id goes
        which = np.full(len(at) + n, len(ids) - 1, np.int32)
        inside = np.ones(len(which), bool)
        inside[ends] = False
        which[inside] = coded.indices.to_numpy()
        _, cuts, data = ids.take(pa.array(which)).buffers()
        return binary(np.frombuffer(cuts, np.int32)[np.append(0, ends + 1)], data)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of each id's code (0: it doesn't occur), of least total size under the limit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate((leaves, packages))
        place = np.argsort(both, kind="stable")
        levels.append(place < len(leaves))  # which of the level's items are leaves
        both = both[place]
        both = both[: len(both) // 2 * 2]
        packages = both[::2] + both[1::2]
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=1))
    size = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
    codes[order] = (np.cumsum(size) - size) >> (top - lengths[order]).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for each value of the next `top` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    top = int(lengths.max(initial=1))
    size = 1 << (top - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    ids[: size.sum()], bits[: size.sum()] = np.repeat(order, size), np.repeat(lengths[order], size)
    return ids, bits, top


def pack(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Each document's payload and the bit offsets of its checkpoints. counts: ids of each document."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    first = np.cumsum(counts) - counts
    bit = ends - size
    begin = bit[first]
    total = np.add.reduceat(size, first)
    whole = (total + 7) // 8
    base = np.cumsum(whole) - whole  # in bytes
    inner = bit - np.repeat(begin, counts)
    bit = np.repeat(base * 8, counts) + inner
    shifted = codes[ids] << (64 - (bit & 31) - size).astype(np.uint64)
    words = np.zeros(int(whole.sum()) // 4 + 3, np.uint64)
    at = bit >> 5
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    words[at[new]] |= np.bitwise_or.reduceat(shifted >> np.uint64(32), new)
    words[at[new] + 1] |= np.bitwise_or.reduceat(shifted & np.uint64(0xFFFFFFFF), new)
    data = words.astype(">u4").tobytes()
    return [data[b : b + n] for b, n in zip(base.tolist(), whole.tolist(), strict=True)], [inner[f : f + n : STRIDE] for f, n in zip(first.tolist(), counts.tolist(), strict=True)]


def unpack(payload: bytes, counts: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All ids of a block; its checkpoints are read in step."""
    by_value, bits, top = tables
    raw = payload + bytes(8)
    words = np.ndarray(len(raw) - 3, ">u4", raw, strides=(1,))  # 32 bits from each byte on: 7 to skip and 25 to read at most
    mask = np.uint32((1 << top) - 1)
    at = offsets.astype(np.int64).copy()
    lanes = -(-counts // STRIDE)
    n = np.full(int(lanes.sum()), STRIDE, np.int64)
    n[np.cumsum(lanes) - 1] = counts - (lanes - 1) * STRIDE
    out = np.zeros((len(at), STRIDE), np.uint32)
    last = len(words) - 1
    for k in range(STRIDE):
        seen = words[np.minimum(at >> 3, last)].astype(np.uint32)
        value = seen >> (32 - top - (at & 7)).astype(np.uint32) & mask
        out[:, k] = by_value[value]
        at += bits[value]
    return out[np.arange(STRIDE)[None, :] < n[:, None]]


def _encode(path: str):
    """(doc_id, ids, null, null) for each document, and in the end the counts of the task's ids: (null, null, id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        alone(tool.known)
        counts = np.zeros(tool.size, np.int64)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, AT_ONCE)
                fits = int(np.searchsorted(np.cumsum(pc.binary_length(batch.column("text")).to_numpy()), TEXT_AT_ONCE, "right"))
                batch = batch.slice(0, max(1, fits))
                at += batch.num_rows
                ids = tool.encode(utf8(batch.column("text")))
                counts += np.bincount(np.frombuffer(ids.buffers()[2], tool.kind, ids.buffers()[2].size // tool.kind.itemsize), minlength=tool.size)
                none = pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, none.cast(pa.int32()), none], _IDS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array(counts[used])], _IDS)

    return run


_IDS = ["doc_id", "ids", "id", "n"]


def _pack(lengths: np.ndarray, kind: np.dtype, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                raw = batch.column("ids").to_pylist()
                counts = np.array([len(x) // kind.itemsize for x in raw])
                payload, offsets = pack(np.frombuffer(b"".join(raw), kind).astype(np.int64), counts, lengths, codes)
                did = [LAST if x is None else x for x in batch.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(did, pa.int64()), pa.array(counts, pa.int32()), pa.array([x.astype("<i8").tobytes() for x in offsets], pa.binary()), pa.array(payload, pa.binary()), pa.array(np.searchsorted(bounds, did, "right").astype(np.int32))], ["doc_id", "did", "n", "offsets", "payload", "part"])

    return run


_BLOCKS = "part int, seq int, start long, doc_ids array<long>, n_tokens array<int>, offsets array<long>, payload binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, start = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    ns: list[int] = []
    offsets: list[np.ndarray] = []
    data: list[bytes] = []
    size = held = 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ns], pa.list_(pa.int32())), pa.array([np.concatenate(offsets)], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())], ["part", "seq", "start", "doc_ids", "n_tokens", "offsets", "payload"])

    for batch in batches:
        for doc_id, n, offset, payload in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "offsets", "payload")), strict=True):
            ids.append(doc_id)
            ns.append(n)
            offsets.append(np.frombuffer(offset, "<i8") + 8 * size)
            data.append(payload)
            size += len(payload)
            held += n
            if held >= BLOCK_IDS:
                yield block()
                seq, start = seq + 1, start + held
                ids, ns, offsets, data, size, held = [], [], [], [], 0, 0
    if ids:
        yield block()


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encodes docs with the tokenizer file and writes the three datasets below path."""
    spark = docs.sparkSession
    tool = encoder(tokenizer)
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_encode(tokenizer), "doc_id long, ids binary, id int, n long")
    encoded, kept = keep(encoded, "ids", "zstd")
    counts = np.zeros(tool.size, np.int64)
    for r in encoded.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        counts[r.id] = r.n
    encoded = encoded.where("id is null").select("doc_id", "ids")
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    n = tasks(spark)
    did = F.coalesce("doc_id", F.lit(LAST))
    bounds = encoded.agg(F.percentile_approx(did, [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []  # one number a part
    pack_all = _pack(lengths, tool.kind, np.array(bounds or [], np.int64))
    packed = encoded.mapInArrow(pack_all, "doc_id long, did long, n int, offsets binary, payload binary, part int")
    packed.repartitionById(n, "part").sortWithinPartitions("did", "payload").mapInArrow(_blocks, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    drop(spark, kept)
    totals = {r.part: r.n for r in spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()}
    spark.createDataFrame(list(running(totals).items()), "part int, start long").coalesce(1).write.parquet(f"{path}/index")


def _decode(lengths: np.ndarray, starts: dict[int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decode_table(lengths)
        for batch in batches:
            for r in range(batch.num_rows):
                block = {c: batch.column(c)[r] for c in ("part", "start", "doc_ids", "n_tokens", "offsets", "payload")}
                counts = block["n_tokens"].values.to_numpy().astype(np.int64)
                ids = unpack(block["payload"].as_py(), counts, block["offsets"].values.to_numpy(), tables).astype("<u4")
                ends = np.cumsum(counts)
                start = starts[block["part"].as_py()] + block["start"].as_py() + ends - counts
                each = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([block["doc_ids"].values, pa.array(start), pa.array(counts), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each if with_ids else [None] * len(each), pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens, ids_crc32, ids (little-endian 32-bit, if with_ids)."""
    book = spark.read.schema("id int, length int").parquet(f"{path}/codebook").collect()  # the vocabulary at most
    lengths = np.zeros(max((r.id for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r.id] = r.length
    starts = {r.part: r.start for r in spark.read.schema("part int, start long").parquet(f"{path}/index").collect()}  # one row a part
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(_decode(lengths, starts, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{scratch(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, path).drop("ids")
