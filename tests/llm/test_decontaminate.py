import hashlib
import random
import re

import pytest

from keysift.llm import decontaminate as D

DOCS = "doc_id long, text string, words string, bits int, row string, spans int, window string"
ITEMS = "item_id long, text string, window int, doc_id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for at in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[at:at + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for at in range(len(w) - size + 1):
                if (named := windows.get(tuple(w[at:at + size]))) is not None:
                    hit |= set(range(at, at + size))
                    held |= named - {None}
        ids = ",".join(sorted(map(str, held)))
        out.append((doc, len(w), len(hit), len(held), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "w", 1, "r", 2, "v") for d in docs], DOCS).repartition(3),
            spark.createDataFrame([(*i, 1, "d") for i in items], ITEMS))


def found(spark, docs, items, n=10):
    return sorted((tuple(r) for r in D.contamination(*frames(spark, docs, items), n).collect()), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "É", "x1", "2024", "łódź", "😀"] + [f"w{k}" for k in range(60)]
    sentence = lambda k: draw.choice([" ", ", ", "\n", "--"]).join(draw.choices(vocabulary, k=k))
    items = [(i * 7, sentence(draw.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(25)]
    items += [(300, items[3][1]), (301, None), (302, " ,. "), (None, sentence(14)), (0, sentence(12))]
    docs = []
    for i in range(150):
        text = sentence(draw.randint(0, 40))
        for _ in range(draw.randint(0, 2)):
            w = words(draw.choice(items)[1])
            a = draw.randint(0, 3)
            text += " " + " ".join(w[a:len(w) - draw.randint(0, 3)]).title() + "! " + sentence(draw.randint(0, 9))
        docs.append((i, text))
    return docs, items


@pytest.mark.parametrize("seed,n", [(1, 10), (2, 10), (3, 4)])
def test_against_brute_force(spark, seed, n):
    docs, items = corpus(seed)
    want = brute(docs, items, n)
    assert found(spark, docs, items, n) == want and sum(r[2] for r in want) > 300


def test_many_copies_and_a_shingle_of_every_window(spark):
    passage = " ".join(["same"] * 9 + [f"p{k}" for k in range(12)])
    docs = [(i, passage) for i in range(400)] + [(1000 + i, f"same same same {i}") for i in range(300)]
    items = [(1, passage), (2, "same " * 40), (3, "same same same"), (4, "same " * 10)]
    assert found(spark, docs, items) == brute(docs, items)


def test_borders_case_and_other_capitals(spark):
    item = "One two three four five six seven eight nine ten"
    docs = [(1, item.upper()), (2, "x " + item), (3, item + " x"), (4, item[4:]), (5, item[:-2]), (6, "ÉCOLE " + item), (7, "école"),
            (8, "İ" + item), (9, "x\x00y"), (10, "ÀB"), (11, "àb")]
    items = [(1, item), (2, "École"), (3, "Y"), (4, "àB")]
    assert found(spark, docs, items) == brute(docs, items)


def test_nulls_repeated_rows_long_texts_and_nothing(spark):
    docs = [(None, "a b c"), (1, None), (2, ""), (2, ""), (3, "a b c"), (3, "a b c"), (4, "z " * 60_000 + "a b c")]
    items = [(1, "a B"), (1, "b c"), (None, "c")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == brute(docs, [])


def test_spans_are_merged_stretches_of_words(spark):
    rows = D.overlaps(*frames(spark, [(1, "x a b c d y a b z")], [(1, "a b c"), (2, "b c d"), (3, "a b")]), 3).collect()
    assert [(s.start, s.end) for s in rows[0].spans] == [(1, 5), (6, 8)] and rows[0].item_ids == ["1", "2", "3"]


def test_only_places_with_a_window_around_them_are_written_down(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(D, "materialise", lambda df, name: written.setdefault(name, df.localCheckpoint()))
    item = " ".join(f"w{k}" for k in range(12))
    # The rarest shingle of the item, w0 w1 w2, stands alone in many texts, and with the others in few.
    others = " y ".join(f"w{k} w{k + 1} w{k + 2}" for k in range(1, 10))
    docs = [(i, f"x{i} w0 w1 w2 y{i} {others} y {others}") for i in range(50)] + [(99, f"z {item} z")]
    items = [(1, item), (2, "only three words"), (3, "q")]
    assert found(spark, docs, items) == brute(docs, items)
    assert [(r.doc_id, p.at) for r in written["places"].collect() for p in r.places if r.doc_id != 99] == []
    assert [len(r.places) > 0 for r in written["places"].where("doc_id = 99").collect()] == [True]
