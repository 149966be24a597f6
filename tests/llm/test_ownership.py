import hashlib
import re

from pyspark.sql import functions as F

from keysift.llm import ownership as O

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, kind string, value string"
HEX, KEY = "0123456789abcdef" * 2, "AK" + "IA" + "B" * 16
MIXED = "aB3" * 8


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0, "k", "v") for i, t, s in rows], SCHEMA).repartition(3)


def base(text):
    text, out = text or "", []
    for k, (pattern, group, least) in enumerate([(ASSIGN, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(out))


TEXTS = ["password = hunter2hunter2", "PassWord:short", f'api_key="{HEX}"', f"x{KEY}y {KEY}", None, "", "secret=token=abcdefgh",
         "password=token: abcdefgh", "token : 'abc' apikey=ABCDEFGH1", f"é😀 {HEX}{HEX} 😀 token={HEX}", "a" * 30, "AKIA" + "A" * 15,
         "AKIAAKIA" + "1" * 20, "Token=....../// passwd:\t no", f"{HEX}\n{HEX}", "x " * 20_000 + f"secret: {HEX}", "pässword = abcdefgh"]
ROWS = [(i, t, f"s{i % 4}") for i, t in enumerate(TEXTS)]


def test_base_spans(spark):
    for r in O.secret_spans(frame(spark, ROWS)).collect():
        expected = base(TEXTS[r.doc_id])
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("owned")) == expected
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [len(re.findall(k, expected)) for k in ("assign:", "access:", "hex:")], r


def test_corpus(spark, corpus):
    docs = corpus.table("documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = O.secret_spans(docs).collect()
    assert len(rows) == len(texts)
    assert all(r.base_sha256 == hashlib.sha256(base(texts[r.doc_id]).encode()).hexdigest() for r in rows)


def test_ownership_separates_examples_from_live_values(spark):
    rows = [(1, f"token={HEX}", "a"), (2, f"token={HEX}", "b"), (3, f"token={HEX}", "c"), (4, f"token=x{HEX}", "a"),
            (5, f"look {MIXED} here", "a"), (6, f"see {MIXED}Z", "a"), (7, f"see {MIXED}Z", "b"), (8, f"see {MIXED}Z", "c"),
            (9, f"token={MIXED}", None)]
    got = {r.doc_id: r for r in O.secret_spans(frame(spark, rows)).collect()}
    # In 4 the assigned value is its own, the run of hex digits in it is the copied one.
    assert [(got[i].n_example, got[i].n_live) for i in (1, 4)] == [(2, 0), (1, 1)]
    assert got[5].n_owned == 1 and got[5].spans == "owned:5:29" and got[6].n_owned == 0
    assert got[9].spans == "assign:0:30"  # the run inside a base span adds nothing


def test_a_value_in_a_third_of_all_rows(spark):
    rows = [(i, f"token={HEX}" if i % 3 == 0 else f"plain {i}", f"s{i % 9}") for i in range(600)]
    got = O.secret_spans(frame(spark, rows)).groupBy("n_example").count().collect()
    assert {(r.n_example, r["count"]) for r in got} == {(2, 200), (0, 400)}


def test_repeated_rows_and_empty_table(spark):
    rows = O.secret_spans(frame(spark, [(1, f"token={HEX}", "a")] * 3)).collect()
    assert len(rows) == 3 and {r.spans for r in rows} == {"assign:0:38,hex:6:38"}
    assert O.secret_spans(frame(spark, [])).count() == 0


def test_masking(spark):
    docs = frame(spark, [*ROWS, *[(50, f"a {MIXED} é token=0{HEX[::-1]} z", "q")] * 2, (None, f"token={HEX}x", "q")])
    out = O.mask_secrets(docs, repo=F.concat_ws("/", "source", "lang"))
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[50].text == "a [SECRET] é [SECRET] z" and rows[50].n_chars == 23
    assert rows[1].text == TEXTS[1] and rows[4].text is None and rows[15].text.endswith("x [EXAMPLE]")
    assert HEX not in " ".join(r.text or "" for r in rows.values())


def test_masking_nothing(spark):
    assert O.mask_secrets(frame(spark, [])).count() == 0


def test_repositories_tell_reused_values(spark):
    once, twice, example = "token=a1b2c3d4", "token=z9y8x7w6", "token=eeeeffff"
    rows = [(1, once, "a", "r1"), (2, once, "a", "r1"), (3, twice, "a", "r1"), (4, twice, "a", "r2"), (5, "plain", "a", "r1"),
            (6, example, "a", "r1"), (7, example, "b", "r1"), (8, example, "c", "r1"), (9, twice + " " + once, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: (r.n_live, r.n_reused, r.most_repos) for r in O.secret_spans(docs, repo="repo").collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (1, 1, 3), 4: (1, 1, 3), 5: (0, 0, 0), 6: (0, 0, 3), 7: (0, 0, 3), 8: (0, 0, 3),
                   9: (2, 2, 3)}
    alone = O.secret_spans(docs.where("doc_id in (1, 2)"), repo="repo").collect()
    assert {(r.n_live, r.n_reused, r.most_repos) for r in alone} == {(1, 0, 1)}
