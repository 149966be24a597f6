from dataclasses import replace

import pytest

from keysift.catalog import RULES
from keysift.operators import listing as L
from keysift.operators import scope as S
from tests.test_findings import biggest_task, plainly

# raw, type, name, qualifier
TARGETS = [
    ("acme", "org", "acme", "org:acme"), ("some-company_1", "org", "some-company_1", "org:some-company_1"),
    ("acme/tool.x", "repo", "acme/tool.x", "repo:acme/tool.x"),
    ("https://github.com/acme", "org", "acme", "org:acme"), ("https://github.com/acme/", "org", "acme", "org:acme"),
    ("http://www.github.com/Acme", "org", "Acme", "org:Acme"), ("https://GITHUB.COM/acme", "org", "acme", "org:acme"),
    ("github.com/acme/tool", "repo", "acme/tool", "repo:acme/tool"),
    ("https://github.com/acme/tool/tree/main/src", "repo", "acme/tool", "repo:acme/tool"),
    ("https://github.com/some.org.name", "org", "some.org.name", "org:some.org.name"),
    ("https://github.com//acme//tool//", "repo", "acme/tool", "repo:acme/tool"),
    ("https://github.com/acme?tab=x", "org", "acme", "org:acme"), ("https://github.com/acme#top", "org", "acme", "org:acme"),
    ("https://github.com/acme;v=1", "org", "acme", "org:acme"), ("https://github.com/ac\tme", "org", "acme", "org:acme"),
    ("  acme  ", "org", "acme", "org:acme"), ("https:///acme", "org", "acme", "org:acme"),
    ("", "global", "", ""), ("   ", "global", "", ""), ("https://github.com", "global", "", ""),
    ("https://github.com/", "global", "", ""), ("github.com", "global", "", ""), (None, "global", "", ""),
    ("https://gitlab.com/acme", "invalid", "", ""), ("some.org.name", "invalid", "", ""),
    ("https://github.com:443/acme", "invalid", "", ""), ("HTTPS://github.com/acme", "invalid", "", ""),
    ("https://github.com/bad name", "invalid", "", ""), ("https://github.com/acme/bad name", "invalid", "", ""),
    # Names are not checked once a path is cut to its first two parts.
    ("https://github.com/a b/c d/tree", "repo", "a b/c d", "repo:a b/c d"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TARGETS)], "target_id int, raw string")
    return {r.target_id: r for r in S.parse_targets(df).collect()}


@pytest.mark.parametrize("i", range(len(TARGETS)))
def test_parse(parsed, i):
    r = parsed[i]
    assert (r.scope_type, r.name, r.search_qualifier) == TARGETS[i][1:]
    assert (r.error is not None) == (r.scope_type == "invalid")
    assert (r.display_label != "") == (r.scope_type != "invalid")
    assert r.raw_input == (TARGETS[i][0] or "").strip()


def test_labels(parsed):
    by_raw = {r.raw: r.display_label for r in parsed.values()}
    assert by_raw["acme"] == "Organisation / user: acme" and by_raw[""] == "Global scan (all of GitHub)"
    assert by_raw["acme/tool.x"] == "Single repository: acme/tool.x"
    assert by_raw["https://github.com/acme/tool/tree/main/src"].endswith("(truncated from longer URL)")


@pytest.fixture(scope="module")
def known(spark):
    owners = spark.createDataFrame([(1, "Acme", "Organization", 12), (2, "bob", "User", 3)],
                                   "owner_id long, owner_login string, owner_type string, owner_public_repos int")
    repos = spark.createDataFrame([(10, 1, "Acme/tool"), (11, 2, "bob/site"), (12, 2, "bob/blog"), (13, None, "gone/x")],
                                  "repo_id long, owner_id long, repo_name string")
    return owners, repos


def resolve(spark, known, raws):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raws)], "target_id int, raw string")
    return S.resolve_targets(S.parse_targets(df), *known)


def test_resolve(spark, known):
    raws = ["acme", "bob", "nobody", "acme/TOOL", "acme/none", "", "https://gitlab.com/x"]
    got = {r.raw: r for r in resolve(spark, known, raws).collect()}
    assert got["acme"].scope_type == "org" and got["acme"].display_label == "Organisation: acme (12 public repos)"
    assert got["bob"].scope_type == "user" and got["bob"].search_qualifier == "user:bob"
    assert got["nobody"].scope_type == "invalid" and not got["nobody"].verified and "nobody" in got["nobody"].error
    assert got["acme/TOOL"].scope_type == "repo" and got["acme/TOOL"].verified
    assert got["acme/none"].scope_type == "invalid" and got[""].verified and got["https://gitlab.com/x"].error
    assert len(got) == len(raws)


def test_resolve_with_unknown_counts_and_names_twice(spark):
    owners = spark.createDataFrame([(2, "ACME", "User", 4), (1, "Acme", "Organization", None)],
                                   "owner_id long, owner_login string, owner_type string, owner_public_repos int")
    repos = spark.createDataFrame([(1, 1, "acme/x"), (2, 2, "ACME/X")], "repo_id long, owner_id long, repo_name string")
    got = resolve(spark, (owners, repos), ["acme", "acme/x"]).collect()
    assert len(got) == 2 and got[0].display_label == "Organisation: acme (? public repos)" and got[0].scope_type == "org"


def test_only_repository_targets_have_no_hot_key(spark, known):
    owners, repos = known
    raws = spark.range(20_000).selectExpr("id AS target_id", "concat('acme/r', id) AS raw")
    with plainly(spark):
        joined = S.resolve_targets(S.parse_targets(raws), owners, repos)
        assert joined.count() == 20_000 and biggest_task(joined) < 4_000


def test_restrict(spark, known):
    owners, repos = known
    files = spark.createDataFrame([(1, 10), (2, 11), (3, 12), (4, 13), (5, 99), (6, None)], "file_id long, repo_id long")

    def kept(*raws):
        return sorted(r.file_id for r in S.restrict(files, resolve(spark, known, list(raws)), repos, owners).collect())

    assert kept("bob") == [2, 3] and kept("acme/tool") == [1] and kept("bob/site", "BOB", "acme") == [1, 2, 3]
    assert kept("nobody") == []
    assert kept("https://github.com") == [1, 2, 3, 4, 5, 6] == kept("", "bob")


def test_query_list(spark):
    rows = [("a", ["ALL"], "org:acme"), ("b", ["rsa_private_key", "NOPE", "RSA_PRIVATE_KEY"], " "), ("c", ["NOPE"], ""),
            ("d", ["ALL", "EC_PRIVATE_KEY"], "repo:o/r")]
    got = {}
    for r in L.query_list(spark.createDataFrame(rows, "request_id string, secret_ids array<string>, search_qualifier string")
                          ).orderBy("request_id", "query_ord").collect():
        got.setdefault(r.request_id, []).append(r.query)
    assert len(got["a"]) == 30 and all(q.endswith(" org:acme") for q in got["a"])
    assert got["b"] == ['"BEGIN RSA PRIVATE KEY"'] and "c" not in got
    assert got["d"] == ['"BEGIN EC PRIVATE KEY" repo:o/r']
    assert '"mailgun" "key-" org:acme' in got["a"]


def test_rules_without_a_search_are_skipped(spark):
    silent = replace(RULES[0], secret_id="SILENT", search_query="")
    requests = spark.createDataFrame([("a", ["SILENT", "EC_PRIVATE_KEY"], "org:x")],
                                     "request_id string, secret_ids array<string>, search_qualifier string")
    assert [r.query for r in L.query_list(requests, [*RULES, silent]).collect()] == ['"BEGIN EC PRIVATE KEY" org:x']
    assert L.query_list(requests, [silent]).count() == 0


def test_rules_listing(spark):
    rows = L.rules_listing(spark).collect()
    assert len(rows) == 30 and [r.category for r in rows][0] == "private_key" and rows[-1].secret_id == "DATABASE_URL"
    assert [r.category_ord for r in rows] == sorted(r.category_ord for r in rows)
