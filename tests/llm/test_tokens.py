import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import pieces, tokenids
from tests.llm import data

BPE, MODEL = public_tokenizers.path(tokenids.TOKENIZER), public_tokenizers.path(pieces.MODEL)
LETTERS = st.sampled_from(["a", "b", "the", " ", "  ", "\n", " \n", "\t", "'s", "1", "é", "漢", " ", "　", "<|endoftext|>", "<s>", "▁", "!", "\x00", "\x1c", "\r", "🙂"])


def encode(texts):
    return tokenids.encoder(BPE).encode(pa.array([x.encode() for x in texts], pa.binary())).to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=20).map("".join))
def test_byte_level_ids(text):
    ids = np.frombuffer(encode([text])[0], "<u2").tolist()
    assert ids == [*_library().encode(text, add_special_tokens=False).ids, 0]


RUNS = ["ab \u00a0 \u00a0 cd", "a\u00a0 \u00a0b", "a \u00a0 b", "a\u3000 ", "a\n ", " \u00a0", "\u00a0 \u00a0 \u00a0", "a\n \nb c", "a\u2003 \u2003 b", "x\x0b \x0b y", "x\x85 \x85 y"]


@pytest.mark.parametrize("text", RUNS)
def test_runs_of_white_space_go_whole(text):
    ids = np.frombuffer(encode([text])[0], "<u2").tolist()
    assert ids == [*_library().encode(text, add_special_tokens=False).ids, 0]


def test_random_runs_of_white_space():
    """Runs of white characters of up to a dozen, between words and at the ends."""
    r = random.Random(4)
    white = [" ", " ", "\u00a0", "\n", "\t", "\u3000", "\u2003", "\r\n", "\x0b", "\x85"]
    run = lambda: "".join(r.choice(white[: r.choice([2, 3, 10])]) for _ in range(r.randrange(13)))
    texts = ["".join(x for _ in range(r.randrange(4)) for x in (run(), r.choice(["a", "bc", "nbsp", "漢", "1.", "'s", ""]))) + run() for _ in range(60_000)]
    texts += ["".join(r.choice(["a", "bc", " ", " ", "\u00a0", "\n", "\t", "\u3000", "\u200b", "\x1c", "\x85", "."]) for _ in range(r.randrange(12))) for _ in range(40_000)]
    for at in range(0, len(texts), 1000):  # pieces of many texts are encoded together
        got = encode(texts[at : at + 1000])
        for text, ids in zip(texts[at : at + 1000], got, strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*_library().encode(text, add_special_tokens=False).ids, 0], repr(text)


_kept = []


def _library():
    if not _kept:
        _kept.append(Tokenizer.from_file(BPE))
    return _kept[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=20).map("".join))
def test_piece_ids(text):
    ids, decimals = pieces.model(MODEL).encode([text, "", text])
    wanted = pieces.model(MODEL).library.encode(text)
    assert [np.frombuffer(x, np.int32).tolist() for x in ids.to_pylist()] == [wanted, [], wanted]
    assert decimals.to_pylist()[0].decode() == "".join(f"{k}," for k in wanted)


def test_agendas_agree():
    m = pieces.model(MODEL)
    parts = ["▁" + "".join(random.Random(k).choice("abcdethéo漢") for _ in range(k % 70 + 1)) for k in range(500)]
    for p, ids in zip(parts, m._all_ids(parts)):
        assert np.frombuffer(ids, np.int32).tolist() == m.to_ids(p) == m.library.encode(p[1:])


def test_code_lengths():
    r = np.random.default_rng(1)
    for n, limit in ((1, 16), (2, 16), (50, 6), (3000, 12), (5000, 16)):
        counts = np.zeros(n + 10, np.int64)
        counts[10:] = (1e6 / (1 + r.permutation(n)) ** 1.3).astype(np.int64) + 1
        lengths = tokenids.code_lengths(counts, limit)
        used = lengths[lengths > 0].astype(float)
        assert lengths.max() <= limit and (n == 1 or (2.0**-used).sum() == 1.0)
        ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 3))
        r.shuffle(ids)
        at = np.array([0, 1, len(ids) // 2, len(ids)]) if len(ids) > 4 else np.array([0, len(ids)])
        payload, offsets = tokenids.pack(ids, np.diff(at), lengths, tokenids.canonical_codes(lengths))
        for p, o, s, e in zip(payload, offsets, at, at[1:]):
            assert (tokenids.unpack(p, np.array([e - s]), o, tokenids.decode_table(lengths)) == ids[s:e]).all()


def test_optimal_without_limit():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1])
    heap = list(counts)
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    assert (tokenids.code_lengths(counts) * counts).sum() == total


def test_files_round_trip(spark, tmp_path):
    rows = [r for r in data.texts() if r[0] != 13]
    tokenids.write_tokens(data.docs(spark, rows), str(tmp_path / "t"), BPE)
    out = sorted(tokenids.read_tokens(spark, str(tmp_path / "t"), True).collect(), key=lambda r: r.start)
    lib, start = _library(), 0
    ordered = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    assert [r.doc_id for r in out] == [r[0] for r in ordered] + [None] * (len(rows) - len(ordered))
    for got, (_, t, *_) in zip(out, ordered):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got.start, got.n_tokens, got.ids_crc32, bytes(got.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)


def test_empty_tables(spark, tmp_path):
    tokenids.write_tokens(data.empty(spark), str(tmp_path / "t"), BPE)
    assert tokenids.read_tokens(spark, str(tmp_path / "t")).count() == 0
    assert pieces.encode_decode(data.empty(spark), MODEL).count() == 0


def test_pieces_of_odd_rows(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = pieces.encode_decode(data.docs(spark), MODEL, True).collect()
    assert len(out) == len(data.texts())
    by = {}
    for i, t, *_ in data.texts():
        by.setdefault(i, []).append(lib.encode(t or ""))
    for r in out:
        assert r.ids in by[r.doc_id] and r.decoded == (lib.decode(r.ids) if r.ids else "")


def test_a_difference_stops_the_batch(monkeypatch):
    m = pieces.Pieces(MODEL)
    monkeypatch.setattr(m, "_all_ids", lambda parts: [b"\0\0\0\0"] * len(parts))
    for text in ("hello", "  two spaces before"):
        with pytest.raises(ValueError):
            m.encode([text])


def test_model_types():
    raw = open(MODEL, "rb").read()
    kind, types = pieces._model_types(raw)
    assert kind == pieces.BPE and pieces.USER_DEFINED not in types and 6 in types  # 6: bytes
