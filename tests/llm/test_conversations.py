import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from keysift.llm import conversations as V
from keysift.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest int, present string"
PATTERN = re.compile(r"(s?(ua)+)?\Z")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "p") for r in rows], SCHEMA).repartition(3)


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def forward(turns, faults):
    """Least (cost, audit, result) turn by turn over the pattern's states: no spans, no grammar."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def better(table, state, new):
        if state not in table or new < table[state]:
            table[state] = new

    def insertions(table):
        for _ in range(4):
            for state, (cost, audit, result) in list(table.items()):
                for x in steps[state]:
                    if x in names:
                        better(table, x, (cost + 5, audit + "I", result + ((names[x], ""),)))
        return table

    table = insertions({"": (0, "", ())})
    for (role, text), fault in zip(turns, faults):
        new = {}
        for state, (cost, audit, result) in table.items():
            better(new, state, (cost + 2, audit + "D", result))
            if fault not in ("b", "d"):
                more = 5 * (fault == "t")
                if role[:1] and role[:1] in steps[state]:
                    better(new, role[:1], (cost + more, audit + "K", result + ((role, text),)))
                for x in steps[state]:
                    if x in names:
                        better(new, x, (cost + more + 1, audit + "R", result + ((names[x], text),)))
        table = insertions(new)
    return min(table[s] for s in ("", "a") if s in table)


def brute(rows, by_damage=True):
    out = {}
    given = damaged_rows(rows) if by_damage else rows
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in given if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [(r[2], r[3]) for r in mine]
        faults, numbers = faults_of(turns), [r[1] for r in mine if r[1] is not None]
        cost, audit, result = forward(turns, faults)
        assert PATTERN.match("".join(r[:1] for r, _ in result))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("b"), faults.count("d"),
                     faults.count("t"), sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest())
    return out


def found(spark, rows, segment=V.SEGMENT):
    return {r.conv_id: tuple(r)[1:] for r in V.repair_summary(damaged(frame(spark, rows)), F.col("present"), segment).collect()}


def conversations(seed, n=150):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "why", "Why?", "", "  \n", "a.b", "é. \t", "A long answer. ", None, "😀"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]
    return [(c, None if draw.random() < 0.03 else t * draw.choice([1, 1, 1, 2]) + 10 * t, draw.choice(roles[:draw.randint(2, 9)]),
             draw.choice(texts)) for c in range(n) for t in range(draw.randint(1, 9))]


def test_pattern_and_costs_by_enumeration():
    """All edit strings of short conversations against the parser."""
    def run(turns, edits):
        at, state, cost = 0, "", 0
        for e in edits:
            if e == "I":
                state, cost = {"": "u", "s": "u", "u": "a", "a": "u"}[state], cost + 5
                continue
            if at == len(turns):
                return None
            initial, fault = turns[at]
            at += 1
            if e == "D":
                cost += 2
                continue
            if fault in ("b", "d"):
                return None
            if e == "K" and initial not in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                return None
            state, cost = initial if e == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state], cost + (e == "R") + 5 * (fault == "t")
        return (cost, "".join(edits)) if at == len(turns) and state in ("", "a") else None

    draw = random.Random(4)
    for _ in range(25):
        turns = tuple((draw.choice("suax"), draw.choice(["", "", "", "b", "t"])) for _ in range(draw.randint(0, 4)))
        options = (run(turns, e) for k in range(len(turns), len(turns) + 4) for e in itertools.product("DIKR", repeat=k))
        assert V.cheapest(V.parsed(turns)) == min(o for o in options if o)


def test_every_cut_gives_the_same_cells():
    draw = random.Random(5)
    turns = [(draw.choice("suax"), draw.choice(["", "", "b", "d", "t"])) for _ in range(12)]
    chart = {(i, i + 1): V.turn_cells(*t) for i, t in enumerate(turns)}
    for length in range(2, 13):
        for i in range(0, 13 - length):
            cuts = {V.joined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)}
            assert len(cuts) == 1
            chart[i, i + length] = cuts.pop()
    assert chart[0, 12] == V.parsed(tuple(turns))


@pytest.mark.parametrize("seed,segment", [(1, 4096), (2, 3), (3, 1)])
def test_against_brute_force(spark, seed, segment):
    rows = conversations(seed)
    want = brute(rows)
    assert found(spark, rows, segment) == want
    assert sum(w[5] for w in want.values()) > 300


def test_one_conversation_over_many_ranges(spark):
    rows = [(7, t, ("user", "assistant")[t % 2 if t % 11 else 0], f"turn {t}.") for t in range(3000)] + [(8, 0, "user", "x")]
    assert found(spark, rows) == brute(rows)


def test_nulls_repeated_rows_and_nothing(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, 5, "user", "Hi."), (1, 5, "user", "Hi."), (1, 5, "user", "Hi."),
            (2, None, "user", None), (3, 1, "assistant", "x" * 200_000 + ".")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {}


def test_conversations_without_turns(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(conv, 0, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns_have_the_summary_s_digest(spark):
    rows = conversations(9, 60)
    given = damaged(frame(spark, rows))
    turns = {}
    for r in sorted(V.repaired_turns(given, F.col("present")).collect(), key=lambda r: (str(r.conv_id), r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, want in brute(rows).items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == want[-1]
