import hashlib

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from corpusloom.llm import mixing, pieces
from tests.llm import data
from tests.llm.test_similar import edited, jaccard
from tests.llm.test_simhash import reach
from tests.llm.test_substring import brute, corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = corpus(3, 30)
    n = len(rows)
    rows += [(n + k, edited(rows[k][1], 1, k)) for k in range(8) if len(rows[k][1].split()) > 80] + [(n + 20, rows[2][1]), (n + 21, None), (n + 22, ""), (n + 23, "BUY!! NOW!! $$$ " * 20)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in rows]
    data.docs(spark, rows).select(*COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if t and "BUY" in t else 1, 0) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages_are_the_five():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "substring_dedup", "source_mix", "encode"]


def test_against_brute_force(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, d).collect()}
    assert {i for i, t, *_ in rows if t and "BUY" in t}.isdisjoint(good) and len(good) >= len(rows) - 3
    left = [r for r in rows if r[0] in good]
    root = reach(len(left), [(a, b) for a in range(len(left)) for b in range(a) if jaccard(left[a][1], left[b][1]) >= 0.8])
    left = [r for k, r in enumerate(left) if root[k] == k]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    wanted = {}
    for (i, t, *_), (_, _, gone, _, kept) in zip(left, brute([r[:2] for r in left])):
        wanted[i] = lib.encode(kept if gone else t or "")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == wanted
    for r in got.values():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


def test_stages_keep_the_columns(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.where("false"), d).count() == 0


def test_mixture_keeps_every_row(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert sorted(map(repr, corpus_pipeline.source_mix(spark, docs, d).collect())) == sorted(map(repr, docs.collect()))


def test_rows_tell_their_place_in_the_mixture(spark, tables, monkeypatch):
    d, _ = tables
    monkeypatch.setattr(mixing.place, "__defaults__", (None, 4, "source"))
    monkeypatch.setattr(mixing.mix, "__defaults__", (None, 4))  # small blocks, so that sources alternate
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    wanted = mixing.place(docs).select("row.doc_id", "place.*").orderBy("position").collect()
    mixed = corpus_pipeline.source_mix(spark, docs, d)
    assert [r.doc_id for r in mixed.collect()] == [r.doc_id for r in wanted] != sorted(r.doc_id for r in wanted)
    out = corpus_pipeline.encode(spark, mixed.repartition(7, "text"), d).orderBy("position").collect()
    assert [(r.doc_id, r.slot, r.position) for r in out] == [(r.doc_id, r.slot, r.position) for r in wanted]
