"""Searches through the phrase index against the scan of all texts."""

import re

import pytest

from keysift.catalog import RULES, Rule
from keysift.operators.candidates import candidate_visits, requested_searches
from keysift.sources.phrase_index import PhraseIndex, build_phrase_index, pieces

TEXTS = ["AKIA here", "xxakiayy", "a_akia_b", "no such", "", None, "BEGIN RSA PRIVATE KEY", "begin rsa  private key", "beginrsa private key",
         "xbegin rsa private keys", "type service_account", "type: my_service_accounts", "!?", "a!?b", "word " * 60_000 + "glpat-x",
         "İ ghp_K", "AKIA here"]


def _rule(name, *phrases):
    return Rule(name, "api_key", name, "low", "x", "", 1, None, " ".join(f'"{p}"' for p in phrases))


OWN = [*RULES, _rule("PUNCTUATION", "!?"), _rule("INNER", "SA private"), _rule("NOWHERE", "zzzzzz")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "file_id long, content string").selectExpr("*", "1 AS key", "2 AS block", "3 AS token")


@pytest.fixture(scope="module")
def path(files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "phrases")
    build_phrase_index(files, path, n_buckets=4, n_blocks=8)
    return path


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_pieces():
    assert pieces("BEGIN RSA PRIVATE KEY") == [("begin", False, True), ("rsa", True, True), ("private", True, True), ("key", True, False)]
    assert pieces("postgres://") == [("postgres", False, True)] and pieces("!?") == []


def test_same_rows_as_the_scan(spark, files, path):
    index = PhraseIndex(spark, path)
    assert _rows(index.search(rules=OWN)) == _rows(candidate_visits(files, rules=OWN))
    for _, rule in requested_searches(("ALL",), OWN):
        assert _rows(index.search([rule.secret_id], OWN)) == _rows(candidate_visits(files, [rule.secret_id], OWN))


def test_a_search_reads_the_blocks_of_its_postings_alone(spark, path):
    index = PhraseIndex(spark, path)
    found = index.search(["GITLAB_TOKEN"])
    assert [r["file_id"] for r in found.collect()] == [14]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*block#\d+[^\]]*)\]", plan)
    assert filters and all(re.search(r"\(block#\d+ = \d+\)|block#\d+ IN \(\d+\)", f) for f in filters), plan  # one of eight blocks


def test_no_files(spark, files, tmp_path):
    index = build_phrase_index(files.where("false"), str(tmp_path / "none"))
    assert _rows(index.search()) == []


def test_keys_of_text(spark, tmp_path):
    rows = spark.createDataFrame([("a", "AKIA1"), ("b", "none")], "path string, body string")
    index = build_phrase_index(rows, str(tmp_path / "text"), key="path", content="body")
    assert _rows(index.search(["AWS_ACCESS_KEY_ID"])) == [(1, "AWS_ACCESS_KEY_ID", "a")]
