"""Operator 13 against an enumeration of all edits, on planted and on given rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpusloom.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, key string, place long, sign string"
BLANK = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.strip(BLANK)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_edits(rows, bad):
    """Every edit of every row with up to two insertions at each place, the cheapest and ASCII-least that the grammar takes."""
    best = None
    inserts = [()] + [tuple(("I", 5, f"{r}:", r[0]) for r in x) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]

    def choices(row, fault):
        _, role, text = row
        more = 5 if fault == "truncated" else 0
        yield ("D", 2, None, "")
        if fault not in ("blank", "duplicate"):
            yield ("K", more, f"{role}:{text}", role[:1])
            for r in ("user", "assistant"):
                yield ("R", 1 + more, f"{r}:{text}", r[0])

    for picked in itertools.product(*(list(choices(r, b)) for r, b in zip(rows, bad, strict=True))):
        for around in itertools.product(inserts, repeat=len(rows) + 1):
            edits = [*around[0], *(e for p, a in zip(picked, around[1:], strict=True) for e in (p, *a))]
            cost, audit = sum(e[1] for e in edits), "".join(e[0] for e in edits)
            if (best is None or (cost, audit) < best[:2]) and re.fullmatch("(s?(ua)+)?", "".join(e[3] for e in edits)):
                best = (cost, audit, "\n".join(e[2] for e in edits if e[2] is not None))
    return best


def dijkstra(rows, bad):
    """The same by a search over places and what was written last, for longer conversations."""
    import heapq

    heap, done = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out[1:]
        if (i, last) in done:
            continue
        done.add((i, last))
        follow = {"": "us", "s": "u", "u": "a", "a": "u"}[last]
        for r in ("user", "assistant"):
            if r[0] in follow:
                heapq.heappush(heap, (cost + 5, audit + "I", i, r[0], out + f"\n{r}:"))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if bad[i] not in ("blank", "duplicate"):
                more = 5 if bad[i] == "truncated" else 0
                if role[:1] in tuple(follow):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], out + f"\n{role}:{text}"))
                for r in ("user", "assistant"):
                    if r[0] in follow:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, r[0], out + f"\n{r}:{text}"))


def expected(rows, solve=dijkstra):
    out = {}
    for conv in {r[0] for r in rows}:
        left = after_damage([r for r in rows if r[0] == conv])
        bad = faults(left)
        turns = [t for t, _, _ in left if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(left))
        cost, audit, text = solve(left, bad)
        out[conv] = (gaps, *(bad.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(n, most, seed, conv=lambda k: k):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "Yes.", "Été. ", "漢字。", "x" * 3000 + ".", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    return [(conv(k), r.choice([t, t, t, t + 3, None]), r.choice(roles[: r.choice((2, 3, 9))]), r.choice(texts)) for k in range(n) for t in range(r.randrange(1, most))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "s") for r in rows], SCHEMA)


def test_search_against_all_edits():
    for seed in range(60):
        rows = made(1, 4, seed)[:2]
        left = after_damage(rows)[:3]
        bad = faults(left)
        assert dijkstra(left, bad) == all_edits(left, bad)


def test_odd_rows(spark):
    rows = made(300, 9, 1) + [(None, 0, "user", "Hi."), (None, None, None, None), (None, None, None, None), (10**6, -(2**62), "user", "Hi."), (10**6, 5, "assistant", "Ho.")]
    assert found(c.repaired(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_segments(spark, size):
    """A conversation with most rows in segments of any size; more than the letters that fit one batch's row."""
    rows = made(40, 6, 2) + [(7_000, t, ("user", "assistant", "system")[t % 3 if t % 7 else t % 2], ("Yes.", "No.", f"t{t}.", "cut")[t % 4]) for t in range(600)]
    assert found(c.repaired(frame(spark, rows), size=size)) == expected(rows)


def test_distant_turns(spark):
    got = found(c.repaired(frame(spark, [(1, 2**63 - 1, "user", "a."), (1, -(2**63), "assistant", "b."), (1, 3, "user", "c.")])))
    assert got[1][0] is None or isinstance(got[1][0], int)


def test_empty(spark):
    assert c.repaired(frame(spark, [])).count() == 0


def test_given_rows(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    assert found(c.op13(spark, data)) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
