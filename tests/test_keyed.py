"""The keyed table: rows as by a dictionary, bytes that grow with the change, readers and writers side by side."""

import pathlib
import random

import pytest

from corpusloom.sources.keyed import Conflict, KeyedTable

SCHEMA = "k long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_a_dictionary(spark, tmp_path):
    table, want, r = KeyedTable(spark, str(tmp_path / "t"), "k", 8), {}, random.Random(1)
    assert table.read(SCHEMA).count() == 0 and table.upsert(frame(spark, [])) == 0
    for n in (300, 1, 40):
        new = {r.randrange(500) if r.random() < 0.98 else None: f"v{r.random()}" for _ in range(n)}
        table.upsert(frame(spark, list(new.items())))
        want |= new
        assert rows(table.read(SCHEMA)) == sorted(want.items(), key=repr)
    assert table.version() == 3 and table.read(SCHEMA, 1).count() <= len(want)
    before = rows(table.read(SCHEMA))
    table.vacuum()
    assert rows(table.read(SCHEMA)) == before and [x.name for x in (tmp_path / "t/versions").iterdir() if x.name[0].isdigit()] == ["3.parquet"]


def test_bytes_grow_with_the_change(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", 32)
    table.upsert(frame(spark, [(k, "x" * 50 + str(k)) for k in range(5000)]))
    size = lambda p: sum(x.stat().st_size for x in pathlib.Path(p).rglob("*.parquet"))
    whole = size(tmp_path / "t/data")
    table.upsert(frame(spark, [(7, "one")]))
    assert size(tmp_path / "t/data") - whole < whole / 10
    assert table.read(SCHEMA).count() == 5000 and table.read(SCHEMA).where("k = 7").first().v == "one"


def test_readers_and_writers(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    table.upsert(frame(spark, [(1, "a"), (2, "b")]))
    reading = table.read(SCHEMA)
    other = KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    other.upsert(frame(spark, [(1, "A")]))
    assert rows(reading) == [(1, "a"), (2, "b")] and rows(table.read(SCHEMA)) == [(1, "A"), (2, "b")]

    class Late(KeyedTable):
        def version(self):  # began from version 1, before the other was done
            return 1

    with pytest.raises(Conflict):
        Late(spark, str(tmp_path / "t"), "k", 4).upsert(frame(spark, [(2, "lost")]))
    assert rows(table.read(SCHEMA)) == [(1, "A"), (2, "b")]
