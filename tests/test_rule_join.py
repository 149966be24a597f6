"""The contains join against testing every phrase on every text."""

import random

from keysift.catalog import RULES
from keysift.operators.candidates import candidate_visits, requested_searches
from keysift.operators.rule_join import SLICE, rule_matches

SCHEMA = "rule_id string, phrases array<string>"


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _expected(texts, rules):
    out = set()
    for rule_id, phrases in rules:
        wanted = [p.lower() for p in phrases or [] if p]
        out |= {(rule_id, k) for k, t in texts if wanted and t is not None and all(p in t.lower() for p in wanted)}
    return sorted(out)


def _both(spark, texts, rules):
    files = spark.createDataFrame(texts, "file_id long, content string").selectExpr("*", "'x' AS key", "'y' AS text", "'z' AS gram")
    table = spark.createDataFrame(rules, SCHEMA).selectExpr("*", "1 AS n")
    found = rule_matches(files, table)
    assert found.columns == ["rule_id", "file_id"]
    assert _rows(found) == _expected(texts, rules)
    return found


def test_random_texts_and_rules(spark):
    rng = random.Random(5)

    def text(n):
        return "".join(rng.choice("abAB é\U0001f600") for _ in range(n))

    texts = [(i, text(rng.randrange(60))) for i in range(150)] + [(200, None), (201, ""), (202, text(50)), (203, "aaaaaaaaaaaa"), (204, texts_end := "the end of a longer text"), (205, texts_end[3:])]
    rules = [(f"r{i}", [text(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 17])) for _ in range(rng.randrange(1, 3))]) for i in range(120)]
    _both(spark, texts, [*rules, ("null", None), ("empty", []), ("blank", ["", None]), ("some", ["", "a"]), ("r0", ["ab"]), ("r0", ["ab"]),
                        ("long", ["end of a longer t"]), ("longer", [texts_end])])


def test_phrases_across_slices_of_a_long_text(spark):
    long = "x" * (SLICE - 5) + "boundaries" + "y" * SLICE + "tail"
    _both(spark, [(1, long), (2, long[:SLICE]), (3, "boundaries")], [("a", ["boundaries"]), ("b", ["tail"]), ("c", ["xbou"]), ("d", ["yt", "xb"])])


def test_a_hot_gram(spark):
    texts = [(i, "common passage here" if i % 3 else f"other {i}") for i in range(600)]
    _both(spark, texts, [("hot", ["common passage"]), ("rare", ["other 3"]), *[(f"c{i}", ["common"]) for i in range(40)]])


def test_empty_tables(spark):
    _both(spark, [], [("a", ["abc"])])
    _both(spark, [(1, "abc")], [])


def test_the_built_in_searches_and_thousands_of_rules(spark, corpus):
    built_in = [(r.secret_id, r.phrases) for _, r in requested_searches(("ALL",), RULES)]
    more = [(f"rule {i}", [f"made up {i:05}"]) for i in range(3000)]
    found = rule_matches(corpus.files, spark.createDataFrame(built_in + more, SCHEMA))
    assert _rows(found) == _rows(candidate_visits(corpus.files).select("secret_id", "file_id"))
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
