import random
import re

import numpy as np
import pytest

from keysift.llm import jaccard_regions as J
from keysift.llm.components import components
from keysift.plans import durable

SCHEMA = "doc_id long, text string, set string, region int, n_links string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "n") for i, t in rows], SCHEMA).repartition(3)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, percent, n):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [set() for _ in rows]
    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
                if a != b:
                    links[x].add(b)
                    links[y].add(a)
    smallest = {}
    for x, (i, _) in enumerate(sets):
        smallest[find(x)] = min(smallest.get(find(x), i), i)
    return sorted((i, len(s), smallest[find(x)], len(links[x])) for x, (i, s) in enumerate(sets))


def found(spark, rows, percent, n, **limits):
    return sorted(tuple(r) for r in J.near_duplicates(frame(spark, rows), percent, n, **limits).collect())


def families(seed, n=160, words=120, changes=9):
    """Texts of a few families, at many distances from each other, and strangers that share a passage."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage, roots = draw.choices(vocabulary, k=60), [draw.choices(vocabulary, k=words) for _ in range(4)]
    rows = []
    for i in range(n):
        if i % 4 == 3:
            text = draw.choices(vocabulary, k=draw.randint(1, 80)) + passage
        else:
            text = list(draw.choice(roots[:1 + i % 4]))
            for _ in range(draw.randint(0, changes)):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
        rows.append((i * 3 % 1000, " ".join(text).upper() if i % 5 == 0 else "  ".join(text)))
    return rows


@pytest.mark.parametrize("percent,n,limits", [(90, 3, {}), (80, 5, {"max_sets": 6}), (70, 3, {"max_sets": 10, "max_shingles": 1500})])
def test_against_brute_force(spark, percent, n, limits):
    rows = families(percent + n)
    want = brute(rows, percent, n)
    assert found(spark, rows, percent, n, **limits) == want
    assert sum(w[3] for w in want) > 20  # there is something to find


def test_short_texts(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices("abcdef", k=draw.randint(0, 14)))) for i in range(200)]
    assert found(spark, rows, 60, 2) == brute(rows, 60, 2)


def test_odd_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "one two three"),
            (9, long), (10, long + " end"), (11, long), (12, "É é"), (13, "é É"), (14, "one two three"), (14, "one two three")]
    assert found(spark, rows, 90, 3) == brute(rows, 90, 3)
    assert found(spark, [], 90, 3) == []


def test_copies_and_near_copies_in_a_third_of_all_rows(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(100)] + [(100 + i, " ".join([*base[:i], f"x{i}", *base[i + 1:]])) for i in range(60)]
    rows += [(200 + i, " ".join(f"y{i}z{k}" for k in range(50))) for i in range(150)]
    assert found(spark, rows, 80, 3, max_sets=20) == brute(rows, 80, 3)


@pytest.mark.parametrize("percent,step", [(90, 2), (80, 3)])
def test_a_chain_far_longer_than_a_region(spark, percent, step):
    rows = [(i, " ".join(f"w{k}" for k in range(i * step, i * step + 100))) for i in range(300)]
    want = brute(rows, percent, 1)
    assert found(spark, rows, percent, 1, max_sets=40) == want
    assert {c for _, _, c, _ in want} == {0} and min(w[3] for w in want) >= 2


def test_many_near_copies_leave_little_on_disk(spark, monkeypatch, tmp_path):
    draw = random.Random(4)
    rows = []
    for i in range(40):
        base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
        for k in range(8):
            text = list(base)
            text[draw.randrange(400)] = f"x{k}"
            rows.append((i * 10 + k, " ".join(text)))
    sizes, kept = [], J.materialise

    def written(df, *args, **named):
        out = kept(df, *args, **named)
        sizes.append(sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")))
        return out

    monkeypatch.setattr(J, "materialise", written)
    monkeypatch.setattr(J, "release_shuffles", lambda spark: None)
    monkeypatch.setattr(J, "PASS_HASHES", 20_000, raising=False)
    monkeypatch.setattr(durable, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert found(spark, rows, 80, 5) == brute(rows, 80, 5)
    # The listed cells come first; with members of all cells and all sets there were 2.6 times as many bytes.
    assert max(sizes) < 1.8 * sizes[0]


def test_one_of_each(spark):
    rows = families(7)
    want = {c for _, _, c, _ in brute(rows, 80, 5)}
    out = J.one_of_each(frame(spark, rows))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")] and sorted(r.doc_id for r in out.collect()) == sorted(want)
    without_ids = J.one_of_each(frame(spark, [(None, "a b c d e f g"), (None, "other words in here now too"), (1, "a b c d e f g")]))
    assert {r.doc_id for r in without_ids.collect()} == {1, None}


def test_linked_sets_share_the_stated_number_of_cells():
    draw = np.random.default_rng(1)
    cells = J.Cells(90)
    for size in (9, 10, 17, 18, 40, 100, 333, 2000):
        for _ in range(30):
            a = np.unique(draw.integers(1, 1 << 63, size).astype(np.uint64))
            differ = max(0, (len(a) * 10) // 95)
            b = np.unique(np.concatenate([a[draw.permutation(len(a))[differ // 2:]], draw.integers(1, 1 << 63, differ - differ // 2).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 90 * (len(a) + len(b) - common):
                (x, n), (y, m) = cells.of(a), cells.of(b)
                if len(x) and len(y):
                    assert len(np.intersect1d(x, y)) >= min(n, m) >= 1


def test_components(spark):
    draw = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + i) for i in range(1, 50)] + [(draw.randint(300, 400), draw.randint(300, 400)) for _ in range(70)]
    label = {}
    for a, b in links * 70:
        if a != b:
            low = min(label.get(a, a), label.get(b, b))
            label[a] = label[b] = low
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
