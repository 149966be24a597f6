import hashlib
import random
import re

import numpy as np
import pytest

from keysift.llm import repeats as R
from keysift.llm.words import sequence_hashes, words_of

SCHEMA = "doc_id long, text string, phrases string, runs int, firsts string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "p", 1, "f") for i, t in rows], SCHEMA).repartition(3)


def brute(rows, n=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for at in range(len(words) - n + 1):
            window = tuple(words[at:at + n])
            if window in seen:
                gone[at:at + n] = [True] * n
            seen.add(window)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def found(spark, rows, n=20):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in R.remove_repeats(frame(spark, rows), n).collect()}


def texts(seed, n=120):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "😀", "The", "the"]
    passages = [draw.choices(vocabulary, k=draw.randint(10, 70)) for _ in range(8)]
    rows = []
    for i in range(n):
        words = draw.choices(vocabulary, k=draw.randint(0, 60))
        for p in draw.choices(passages, k=draw.randint(0, 3)):
            a, b = draw.randint(0, 5), draw.randint(0, 5)
            words += p[a:len(p) - b] + draw.choices(vocabulary, k=draw.randint(0, 30))
        rows.append((i * 7 % 1000, draw.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("n", [8, 12, 20])
def test_against_brute_force(spark, n):
    rows = texts(n)
    want = brute(rows, n)
    assert found(spark, rows, n) == want and sum(w[1] for w in want.values()) > 200


def test_repeats_inside_one_text_and_overlaps(spark):
    rows = [(1, " ".join(["a"] * 100)), (2, " ".join(f"x{i % 30}" for i in range(300))), (3, " ".join(["a"] * 19)), (4, " ".join(["a"] * 21)),
            (5, " ".join(f"x{i % 30}" for i in range(7, 40)))]
    assert found(spark, rows) == brute(rows)


def test_a_passage_in_a_third_of_all_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} " * 3 + (passage if i % 3 == 0 else "") + f" more{i}") for i in range(500)]
    assert found(spark, rows) == brute(rows)


def test_odd_texts(spark):
    long = " ".join(f"w{i % 20_011}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "short"), (5, long), (6, long), (7, " ".join(f"v{i}" for i in range(20))),
            (8, " ".join(f"v{i}" for i in range(20)))]
    want = brute(rows)
    assert found(spark, rows) == want and want[8][2] == ""
    assert found(spark, []) == {}
    digest = {r.doc_id: r.kept_sha256 for r in R.remove_repeats(frame(spark, rows), digest=True).collect()}
    assert digest == {i: hashlib.sha256(w[2].encode()).hexdigest() for i, w in want.items()}


def test_repeated_rows_and_rows_without_id(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = R.remove_repeats(frame(spark, [(1, text), (1, text), (2, text), (None, text)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("1", 0), ("1", 0), ("2", 30), ("None", 0)]


def test_equal_windows_have_equal_phrases():
    draw = random.Random(1)
    window = [f"w{draw.randrange(50)}" for _ in range(20)]
    found = set()
    for pad in range(30):
        text = " ".join([f"x{draw.random()}" for _ in range(pad)] + window + [f"y{draw.random()}" for _ in range(5)])
        words = words_of([text.encode()])
        runs = R.runs_of(words.hashes, words.first, 20)
        k = int(np.flatnonzero((runs.start <= pad) & (runs.last >= pad))[0])
        found.add((int(runs.phrase_hash[k]), int(runs.phrase[k]) - pad, int(R.Hashes(words.hashes).of(np.array([pad]), np.array([pad + 20]))[0])))
    assert len(found) == 1


def test_automaton_finds_every_occurrence():
    draw = random.Random(4)
    words = words_of([" ".join(draw.choices("abcd", k=3000)).encode()])
    letters, places = R.spelled(words.hashes), np.array([5, 100, 200])
    automaton = R.compiled(letters, places)
    phrases = sequence_hashes(words.hashes, R.PHRASE)
    assert set(R.located(automaton, letters)) == set(np.flatnonzero(np.isin(phrases, phrases[places])))
