import hashlib
import re

import pytest

from keysift.llm import content_sort as C

SCHEMA = "doc_id long, text string, content string, piece int, digest string"  # names that clash with the operator's own


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def brute(rows):
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i))
    return {(i, sorted(groups[squeeze(t)])[0][1], len(groups[squeeze(t)]), sorted(groups[squeeze(t)])[0][1] == i,
             hashlib.sha256(squeeze(t).encode()).hexdigest()) for i, t in rows}


def got(spark, rows):
    out = C.content_groups(frame(spark, rows))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return [tuple(r) for r in out.collect()]


ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \n "), (7, "é x"), (8, "éx "), (9, "z" * 50_000), (10, "z" * 50_000),
        (11, "AB"), (12, "a b"), (13, "😀 a"), (14, "\x0ba\x0c b\r")]


def test_groups(spark):
    assert set(got(spark, ROWS)) == brute(ROWS)


def test_a_text_in_a_third_of_all_rows(spark):
    rows = [(i, "hot " * 3 if i % 3 == 0 else f"text {i % 200}") for i in range(900)]
    assert set(got(spark, rows)) == brute(rows)
    assert C.content_groups(frame(spark, rows)).where("kept").count() == len({t for _, t in rows})


def test_common_beginnings_longer_than_a_splitter(spark):
    rows = [(i, "same beginning " * 20 + str(i % 7)) for i in range(60)]
    assert set(got(spark, rows)) == brute(rows)


def test_repeated_rows_keep_one(spark):
    rows = got(spark, [(1, "a"), (1, "a"), (2, "a")])
    assert sorted(r[3] for r in rows) == [False, False, True] and {r[1:3] for r in rows} == {(1, 3)}


def test_empty_table(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("rows,left", [(ROWS, [3, 6, 7, 9, 11, 12, 13]), ([], []), ([(None, "a"), (1, "a"), (None, "b"), (1, "a")], [None, None, 1])])
def test_drop_copies(spark, rows, left):
    out = C.drop_copies(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    kept = [r.doc_id for r in out.collect()]
    if rows is ROWS:
        left = sorted({r[1] for r in brute(ROWS)})
    assert sorted(kept, key=str) == sorted(left, key=str)
