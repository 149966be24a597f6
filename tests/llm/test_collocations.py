import random
import re
from collections import Counter

import numpy as np
import pytest

from keysift.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, key string, code int, f string, codes string, word int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 1, "f", "c", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, top, least):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    key = lang, tuple(words[i:i + m])
                    f[key] = f.get(key, 0) + 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, g), a in f.items():
        if len(g) < 2:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        inside = any(b == lang and len(h) > len(g) and 100 * c >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h)))
                     for (b, h), c in f.items())
        if not inside:
            out.append((lang, " ".join(g), a, l, r, n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, k, *o[1:]) for k, o in enumerate(mine, 1)]
    return sorted(ranked)


def found(spark, rows, top=50, least=3):
    return sorted(tuple(r) for r in C.collocations(frame(spark, rows), top, least).collect())


def test_elements_and_neighbours_stay_in_their_piece():
    words = C.words_of([b"a b c d e. f g h i", b"j k"], ["en", "en"])
    keys, fits = C._elements(words, 4)
    assert np.flatnonzero(fits).tolist() == [0, 1, 5] and len(keys) == len(words.codes) - 3
    every = np.full(C.MARK_BITS // 64, (1 << 64) - 1, np.uint64)
    for size, apart, want in ((1, 1, [0, 1, 2, 3, 5, 6, 7, 9]), (2, 1, [0, 1, 2, 5, 6]), (2, 2, [0, 1, 5]), (4, 1, [0]), (4, 2, [])):
        level = C.Level(size, every, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, size), np.uint64))
        codes = C._neighbours(words, level, apart)[2]
        assert codes.tolist() == [words.codes[i:i + size + apart].tolist() for i in want]


def texts(seed, n=150):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "É", "naïve", "😀", "don't", "x-1"] + [f"w{k}" for k in range(25)]
    phrases = ["in the end of the day", "New York City", "a priori", "of the", "the the the"]
    rows = []
    for _ in range(n):
        words = draw.choices(vocabulary, weights=[30, 10, 20] + [3] * (len(vocabulary) - 3), k=draw.randint(0, 40))
        for p in draw.choices(phrases, k=draw.randint(0, 4)):
            words.insert(draw.randint(0, len(words)), p)
        text = "".join(w + draw.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\x0b"]) for w in words)
        rows.append((text, draw.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("seed,least", [(1, 3), (2, 2), (3, 8)])
def test_against_brute_force(spark, seed, least):
    rows = texts(seed)
    want = brute(rows, 50, least)
    assert found(spark, rows, 50, least) == want and len(want) > 20 and any(r[2].count(" ") > 1 for r in want)


def test_ties_and_limit(spark):
    rows = [(f"x{k} y{k}", "en") for k in range(40) for _ in range(3)] + [("é ê", "en")] * 3
    want = brute(rows, 10, 3)
    assert found(spark, rows, 10) == want and len(want) == 10


def test_nulls_long_texts_and_nothing(spark):
    rows = [(None, "en"), ("", None), ("... ,,", "en"), ("alpha beta. " * 60_000, "en"), ("gamma delta " * 5000, None)]
    assert found(spark, rows) == brute(rows, 50, 3)
    assert found(spark, []) == [] and found(spark, [("a b", "en")]) == []


def test_texts_are_cut_only_between_pieces():
    import pyarrow as pa

    text = " ".join(f"w{i % 13}{'.' if i % 7 == 0 else ''}" for i in range(5000))
    batch = pa.record_batch([pa.array([text]), pa.array(["en"])], names=["text", "lang"])
    parts = [t for texts, _ in C._blocks(batch, 100) for t in texts]
    assert len(parts) > 100 and b"".join(parts).decode() == text
    assert all(p.endswith(b".") for p in parts[:-1])


def test_dense_tiles_and_sorted_lists_count_alike():
    draw = np.random.Generator(np.random.PCG64(3))
    keys = np.unique(draw.integers(1, 1 << 63, 900, np.uint64))
    n = len(keys)
    ranks = draw.permutation(n)
    codes = np.zeros((n, 1), np.uint64)
    codes[ranks, 0] = keys
    level = C.Level(1, np.zeros(C.MARK_BITS // 64, np.uint64), keys, ranks, codes)
    order = keys[np.argsort(ranks)]
    tiles, want, got = C.Tiles(level), Counter(), Counter()
    beyond = draw.integers(1, 1 << 63, 5, np.uint64)
    batches = []
    for _ in range(3):
        # Low ranks are far more frequent, as words are.
        pick = lambda: np.concatenate([order[np.minimum(draw.geometric(0.01, 40_000) - 1, n - 1)], draw.choice(beyond, 500)])
        left, right = pick(), pick()
        want.update(zip(left.tolist(), right.tolist()))
        batches.append(tiles.add(left, right, np.stack([left, right], axis=1)))
    assert tiles._dense and all(b is not None for b in batches)
    for b in [*batches, *tiles.dense()]:
        for key, a, c, count in zip(*(b[name].to_numpy().view(np.uint64).tolist() for name in ("key", "c1", "c2", "n"))):
            assert key == int(C.paired(np.array([a], np.uint64), np.array([c], np.uint64))[0])
            got[a, c] += count
    assert got == want


def test_saturated_marks_change_nothing():
    level = C.Level(1, np.full(C.MARK_BITS // 64, (1 << 64) - 1, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 1), np.uint64))
    words = C.words_of([b"a b. c d e"], ["en"])
    left, right, codes = C._neighbours(words, level, 1)
    assert left.tolist() == words.codes[[0, 2, 3]].tolist() and right.tolist() == words.codes[[1, 3, 4]].tolist()


def test_codes_of_words_and_keys_of_phrases_are_not_shuffled(spark, monkeypatch):
    plans, write = {}, C.materialise

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name=name)

    monkeypatch.setattr(C, "materialise", noted)
    C.frequent(frame(spark, [("a b c d e", "en")] * 5).select("lang", "text"), 2)
    dealt = [line for name in ("counts", "phrases2", "phrases4") for line in plans[name].splitlines() if "hashpartitioning(" in line]
    assert len(dealt) == 3 and not any("key#" in line or "code#" in line for line in dealt)


def test_rare_phrases_of_frequent_parts_are_not_sent(spark):
    # All pairs are frequent, and but one phrase of three words is rare.
    draw = random.Random(5)
    rows = [(" ".join(draw.choices("abcdefghijklmnopqrst", k=40)) + ". x y z", "en") for _ in range(400)]
    docs, sent = frame(spark, rows).select("lang", "text"), []
    count_pairs = C._count_pairs

    def watched(*given):
        counted = count_pairs(*given)
        sent.append(counted.count())
        return counted

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(C, "_count_pairs", watched)
        phrases = C.frequent(docs, 20)[2]
        assert phrases.where("size(codes) = 2").count() > 300 and phrases.where("size(codes) = 3").count() == 1
    assert sent[1] <= 3 * 10 and sent[0] >= 300  # once a task, and what shares a slot


@pytest.mark.parametrize("slots,least", [(64, 3), (1 << 14, 300)])
def test_full_slots_and_wide_counts(spark, monkeypatch, slots, least):
    monkeypatch.setattr(C, "SLOTS", slots)
    monkeypatch.setattr(C, "ROW_SLOTS", 64)
    rows = texts(4) + [("in the end of the day", None)] * 310
    want = brute(rows, 50, least)
    assert found(spark, rows, 50, least) == want and any(r[2].count(" ") > 1 for r in want)


def test_more_parts_of_the_input_send_a_phrase_no_more_often(spark, monkeypatch):
    # Each part of the input holds every phrase.
    draw = random.Random(7)
    rows = [(". ".join(draw.sample(["a b c d", "e f g", "h i j k", "l m n"], 4)), "en") for _ in range(960)]
    count_pairs, sent = C._count_pairs, []

    def watched(*given):
        counted = count_pairs(*given)
        sent.append(counted.count())
        return counted

    monkeypatch.setattr(C, "_count_pairs", watched)
    for parts in (32, 160):
        docs = frame(spark, rows).select("lang", "text").repartition(parts)
        longer = C.frequent(docs, 30)[2].where("size(codes) > 2").collect()
        assert sorted((len(r.codes), r.f) for r in longer) == [(3, 960)] * 6 + [(4, 960)] * 2
    assert max(sent[1], sent[3]) <= 8 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_sums_lose_nothing_and_stay_bounded(held):
    draw = np.random.Generator(np.random.PCG64(11))
    keys = np.unique(draw.integers(1, 1 << 63, 400, np.uint64))
    codes = np.stack([keys + np.uint64(1), keys + np.uint64(2)], axis=1)
    sums, want, got, sent = C.Sums(held, 2), Counter(), Counter(), []
    for _ in range(20):
        pick, n = np.unique(np.minimum(draw.geometric(0.02, 200) - 1, len(keys) - 1), return_counts=True)
        want.update(dict(zip(keys[pick].tolist(), n.tolist())))
        if (found := sums.add(keys[pick], codes[pick], n)) is not None:
            sent.append(found)
        assert len(sums._rows[0]) <= held
    sent.append(sums.rest())
    for k, c, n in sent:
        assert len(np.unique(k)) == len(k) and (c == np.stack([k + np.uint64(1), k + np.uint64(2)], axis=1)).all()
        got.update(dict(zip(k.tolist(), n.tolist())))
    assert got == want and len(sums.rest()[0]) == 0 and (len(sent) > 1) == (held < 1000)


@pytest.mark.parametrize("held", [1, 5])
def test_few_held_phrases_change_nothing(spark, monkeypatch, held):
    monkeypatch.setattr(C, "HELD", held)
    monkeypatch.setattr(C, "SUMMED_PAIRS", 16)
    monkeypatch.setattr(C, "BLOCK_BYTES", 256)
    rows = texts(6)
    want = brute(rows, 50, 3)
    assert found(spark, rows) == want and any(r[2].count(" ") > 1 for r in want)
