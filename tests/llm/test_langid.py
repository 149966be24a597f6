import math
import random
import zlib

import pytest

from keysift.llm import langid as L
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, held_out string, score string"
WORDS = {"aa": "alpha beta gamma delta rho sigma".split(), "bb": "zwölf straße größe über müssen".split(), "cc": "niño señor años mañana está".split()}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    return [(i, " ".join(draw.choices(WORDS[lang], k=draw.randint(5, 60))), lang) for i, lang in enumerate(draw.choices(list(WORDS), k=400))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "h", "s") for i, t, lang in rows], SCHEMA).repartition(3)


def test_held_out_accuracy(spark, rows):
    docs = frame(spark, rows)
    got = L.identify(docs, L.fit(docs)).collect()
    assert len(got) == 400 and {r.doc_id for r in got if r.held_out} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    label = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == label[r.doc_id] and 0 < r.score <= 1 and not r.rejected for r in got)


def test_supplied_documents(spark, corpus):
    docs = corpus.table("documents")
    label = {r.doc_id: r.lang for r in docs.collect()}
    held = L.identify(docs, L.fit(docs)).where("held_out").collect()
    assert sum(r.lang_pred == label[r.doc_id] for r in held) / len(held) > 0.95


def test_labels_of_held_out_rows_are_not_learned(spark, rows):
    held = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    assert L.fit(frame(spark, held)).languages == ["aa", "bb", "cc"]


def test_odd_texts(spark, rows):
    model = L.fit(frame(spark, rows))
    odd = [(1, None, "aa"), (2, "", None), (3, "123 !?", "aa"), (4, "Ж" * 80, None), (5, "ALPHA BETA!!! GAMMA%%%", None),
           (6, "größe über " * 600_000, "bb"), (None, "alpha beta", None), (8, "alpha", "aa"), (8, "alpha", "aa")]
    got = {r.doc_id: r for r in L.identify(frame(spark, odd), model).collect()}
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3))
    assert got[4].rejected and got[4].lang_pred in model.languages
    assert got[5].lang_pred == "aa" and got[6].lang_pred == "bb" and not got[6].rejected and got[None].held_out is False
    kept = L.accepted(frame(spark, odd), model)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [5, 6, 8, 8, None]


def test_nothing_to_learn_from_and_nothing_to_judge(spark):
    unlabelled = frame(spark, [(1, "alpha", None), (2, "", None)])
    got = {r.doc_id: r for r in L.identify(unlabelled, L.fit(unlabelled)).collect()}
    assert (got[1].lang_pred, got[1].score, got[1].rejected, got[2].rejected) == ("und", 0.0, False, True)
    assert L.identify(frame(spark, []), L.fit(frame(spark, []))).count() == 0


# ── In plain Python: dictionaries of trigrams, no arrays ─────────────────────────────────

def plain_counts(text):
    """Hashed byte trigrams around letters of one text, with a space on either side."""
    data = []
    for c in text:
        if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×"):
            c = c.lower()
        data += [b if b >= 128 or 97 <= b <= 122 else 32 for b in c.encode()]
    data = [32, *data, 32]
    counts = {}
    for a, b, c in zip(data, data[1:], data[2:]):
        if b != 32:
            place = ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20
            counts[place] = counts.get(place, 0) + 1
    return counts


def plain_unit(v):
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {k: x / norm for k, x in v.items()}


def plain_cosine(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def plain_mean(rows):
    out = {}
    for row in rows:
        for k, x in row.items():
            out[k] = out.get(k, 0.0) + x / len(rows)
    return plain_unit(out)


def plain_learn(labelled):
    counts = [plain_counts(t) for _, t in labelled]
    seen = {}
    for c in counts:
        for k in c:
            seen[k] = seen.get(k, 0) + 1
    idf = lambda k: math.log((1 + len(labelled)) / (1 + seen.get(k, 0))) + 1
    vector = lambda c: plain_unit({k: math.log1p(n) * idf(k) for k, n in c.items()})
    model = {}
    for language in sorted({x for x, _ in labelled}):
        rows = [vector(c) for (x, _), c in zip(labelled, counts) if x == language]
        centroids = [plain_mean(rows)]
        while len(centroids) < min(L.CENTROIDS, len(rows)):
            centroids.append(min(rows, key=lambda r: max(plain_cosine(r, c) for c in centroids)))
        for _ in range(10):
            own = [[] for _ in centroids]
            for r in rows:
                close = [plain_cosine(r, c) for c in centroids]
                own[close.index(max(close))].append(r)
            centroids = [plain_mean(o) if o else c for o, c in zip(own, centroids)]
        model[language] = centroids
    return vector, model


def test_learning_and_judging_against_plain_python(spark):
    table = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
             if r.lang and r.text and len(r.text) < 1500 and any(map(str.isalpha, r.text))]
    labelled, others = table[:60], [t for _, t in table[60:110]] + ["ÀÉÎ ñandú ÆØÅ × Þorn 42", "The THE the", "x"]
    counts = L.trigram_counts([t.encode() for _, t in labelled])
    assert [{int(k): int(n) for k, n in enumerate(row) if n} for row in counts] == [plain_counts(t) for _, t in labelled]
    model, (vector, plain) = L.learn([x for x, _ in labelled], counts), plain_learn(labelled)
    assert model.languages == sorted(plain)
    found, scores, _ = model.predict([t.encode() for t in others])
    for text, language, score in zip(others, found, scores):
        close = {x: max(plain_cosine(vector(plain_counts(text)), c) for c in cs) for x, cs in plain.items()}
        best = max(close.values())
        assert abs(score - best) < 1e-4 and close[language] > best - 1e-4
