"""Windows from remembered pieces against a tokenizer's tokens of whole texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers, processors

from corpusloom.functions import text
from corpusloom.functions.tokens import Tokens
from corpusloom.operators import chunks
from corpusloom.plans import catalog, inputs, plugs

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Ab", "the", "x.", "y,", ";", "(b)", "it's", "don't.", "Z'", "'ll", "12", "!!", "\x00", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u2003"]
PARTS += ["\u2028", "\u3000", "\ufeff", "\u2060", "\u200d", "é", "ñ", "漢", "😀", "<|endoftext|>", "<|endof"]


def whole(tool, t, size, overlap):
    spans, out = tool.encode(t, add_special_tokens=False).offsets, []
    for k in range(1 + max(0, -((size - len(spans)) // (size - overlap))) if spans else 0):
        part = spans[k * (size - overlap) :][:size]
        out.append({"ordinal": k, "body": t[part[0][0] : part[-1][1]], "n_tokens": len(part)})
    return out


def texts_of(rnd):
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 3, 10, 60]))) for _ in range(rnd.choice([1, 4, 10]))]


def other(tmp_path, kind):
    """Tokenizers whose texts can't be cut, or whose spans are trimmed."""
    if kind == "words":
        tool = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "the": 2}, unk_token="[UNK]"))
        tool.pre_tokenizer = pre_tokenizers.Whitespace()
    else:
        tool = Tokenizer.from_file(PATH)
        if kind == "prefix":
            tool.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
        else:
            tool.post_processor = processors.ByteLevel(trim_offsets=True)
    tool.save(str(tmp_path / "t.json"))
    return str(tmp_path / "t.json")


@pytest.mark.parametrize("most", [192 << 20, 0])
def test_pieces_give_the_tokens_of_whole_texts(most):
    tool, library, rnd = Tokens(PATH, most), Tokenizer.from_file(PATH), random.Random(3)
    assert tool.cuts
    for _ in range(300):
        texts, size = texts_of(rnd), rnd.choice([1, 2, 3, 16])
        overlap = rnd.randrange(size)
        assert tool.windows(pa.array([*texts, None]).slice(1), size, overlap).to_pylist() == [*(whole(library, t, size, overlap) for t in texts[1:]), []]
    assert tool.windows(pa.array([], pa.string()), 2, 1).to_pylist() == []


@pytest.mark.parametrize("kind", ["words", "prefix", "trimmed"])
def test_other_tokenizers_read_whole_texts(tmp_path, kind):
    path, rnd = other(tmp_path, kind), random.Random(4)
    tool, library = Tokens(path), Tokenizer.from_file(path)
    assert not tool.cuts
    for _ in range(50):
        texts = texts_of(rnd)
        assert tool.windows(pa.array(texts), 3, 1).to_pylist() == [whole(library, t, 3, 1) for t in texts]


def test_a_piece_is_encoded_once():
    tool = Tokens(PATH)
    first = tool.windows(pa.array(["one two three. " * 1000]), 512, 64)
    seen = len(tool.known), tool.start.size
    assert seen[0] < 10
    assert tool.windows(pa.array(["one two three. " * 1000]), 512, 64).equals(first)
    assert (len(tool.known), tool.start.size) == seen


def test_chunks_are_those_of_the_spans(spark, data):
    docs = inputs.docs(spark, data)
    odd = docs.limit(1).withColumn("text", F.explode(F.array(*map(F.lit, ["", " \n ", "<|endoftext|> a  b", "\u2003one\u2003"]), F.lit(None))))
    for rows in (docs, odd):
        a = chunks.chunk(rows, 40, 8, plugs.tokenizer_spans(PATH))
        b = chunks.chunk(rows, 40, 8, cut=plugs.tokenizer_windows(PATH, 1000))
        assert a.dtypes == b.dtypes
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    with pytest.raises(ValueError, match="stride"):
        chunks.chunk(docs, 8, 8, cut=plugs.tokenizer_windows(PATH))


def test_tokens_are_made_once(spark, data):
    """A condition on the tokens was moved below where they are made, so that every text was encoded twice."""
    plans = [catalog.queries()["x4_token_chunks"](spark, data), chunks.chunk(inputs.docs(spark, data), 512, 64, plugs.tokenizer_spans(PATH))]
    assert [x._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") for x in plans] == [1, 1]


def test_stripped(spark):
    space = "".join(chr(k) for k in range(0x3001) if chr(k).isspace())
    values = [None, "", "a", space, f"{space}a{space}b\n{space}", "a\n", "\u200ba\u180e", " \x00 ", "a" + " " * 200_000 + "b"]  # the last took the square of its length
    got = spark.createDataFrame(list(enumerate(values)), "id int, t string").select("id", text.stripped(F.col("t")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == [None if v is None else v.strip() for v in values]
