"""A small table with the odd cases: nulls, empty, wordless and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, did long, rid long, positions string, part int, host string, n int, component_id string, keep string, row string, place string, cell string, `from` string, __did string, __rid long, __before string, __cell string, __source string, __rank string, `a.b` string, p double, odds string, kept string, h string"


def prose(n, seed, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def texts():
    shared = prose(40, 1)
    base = prose(120, 2)
    return [
        (0, base, "en", "a"), (1, base, "en", "a"), (2, base + " tail", "en", "b"), (3, "x " + shared + " y", "en", "b"), (4, prose(30, 3) + "\n" + shared, "fr", None), (5, None, None, "a"),
        (6, "", "en", "a"), (7, " \t\n\x0b\x0c\r ", "en", ""), (8, "One", "en", "c"), (9, "one  two", "en", "c"), (10, "Été ÜBER　weiß 漢字 🙂", "fr", "c"), (11, "the " * 500, "en", "a"),
        (12, prose(60_000, 4, 10**9), "en", "a"), (13, "one two THREE", "en", "a"), (13, "one two THREE", "en", "a"), (13, "another text of the same id", "en", "a"), (None, "no id here", "en", "a"), (None, shared, "en", "d"),
        (14, "a\x1cb c d", "en", "d"), (15, "<|endoftext|> and <s> </s> twice  spaced", "en", "d"), (16, shared, "en", "d"), (17, "x" * 50_000, "de", "d"),
    ]


def docs(spark, rows=None):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, "p", 4, "h", 5, "c", "k", "r", "pl", "ce", "fr", f"did {k}", k, "be", "cl", "so", "ra", "ab", 0.5, "od", "kp", "hh") for k, r in enumerate(texts() if rows is None else rows)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
