from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import functions as F

from keysift.catalog import RULES
from keysift.operators import candidates as Q
from keysift.operators import detect as D
from keysift.operators import findings as P
from keysift.operators import hydrate as H
from keysift.operators import scope as S
from keysift.operators.skew import hot_keys, key_counts, n_shares, spread_left_join
from keysift.plans.durable import materialise
from tests import brute
from tests.test_detect import POSITIVE, block

A, B, C = POSITIVE["NPM_TOKEN"], POSITIVE["GITLAB_TOKEN"], POSITIVE["STRIPE_SECRET_KEY"]
FILES = [(1, A + " " + B), (2, B), (3, C + " " + A), (4, "nothing"), (5, C), (6, None)]


def files(spark, rows=FILES):
    return spark.createDataFrame(rows, "file_id long, content string").repartition(3)


def ids(rows):
    return {r.file_id: [s["sample"] for s in r.secrets] for r in rows}


def sequential(rows, skip):
    """The run as a loop over files in order."""
    seen, out = set(), {}
    for file_id, text in sorted(rows):
        found = brute.detect(text)
        if not found:
            continue
        new = [f for f in found if f[1] not in seen]
        seen |= {f[1] for f in new}
        if new or not skip:
            out[file_id] = ([f[1] for f in (new or found)], len(new))
    return out, seen


def as_dict(df):
    return {r.file_id: ([s.sha for s in r.secrets], r.n_new) for r in df.collect()}


def test_skip_duplicates(spark):
    got = P.findings(D.detect(files(spark)))
    assert as_dict(got) == sequential(FILES, True)[0]
    assert sorted(as_dict(got)) == [1, 3]


def test_keep_duplicates(spark):
    got = P.findings(materialise(D.detect(files(spark))), skip_duplicates=False)
    assert as_dict(got) == sequential(FILES, False)[0]
    assert sorted(as_dict(got)) == [1, 2, 3, 5]


def test_corpus_matches_sequential_run(spark, corpus):
    rows = [(r.file_id, r.content) for r in corpus.files.select("file_id", "content").collect()]
    detected = materialise(D.detect(corpus.files))
    for skip in (True, False):
        expected, seen = sequential(rows, skip)
        got = as_dict(P.findings(detected, skip))
        assert got == expected
        assert sum(n for _, n in got.values()) == len(seen)


def test_copies_in_a_third_of_all_files(spark):
    # One value in every third file: the aggregation keeps one row per task for it.
    rows = [(i, A if i % 3 == 0 else "np" + "m_" + f"{i:036d}") for i in range(3000)]
    got = as_dict(P.findings(D.detect(files(spark, rows))))
    assert len(got) == 2001 and got[0][1] == 1 and 3 not in got
    plan = P.first_seen(D.explode_secrets(D.detect(files(spark, rows))))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Join" not in plan and "Window" not in plan


def test_first_seen_carries_any_column(spark):
    rows = files(spark, [(1, A), (2, A)]).withColumn("labels", F.expr("map('k', file_id)"))
    assert [r.labels for r in P.first_seen(D.explode_secrets(D.detect(rows))).collect()] == [{"k": 1}]


def test_one_file_with_most_detections(spark):
    big = "\n".join(block("RSA", f"{i:064d}") for i in range(5000))
    got = as_dict(P.findings(D.detect(files(spark, [(1, big), (2, A)]))))
    assert got[1][1] == 5000 and got[2][1] == 1


def test_search_phrases(spark):
    rows = [(1, "MailGun and KEY-x"), (2, "key-only"), (3, A), (4, '{"Type": "service_account"}')]
    got = {(r.secret_id, r.file_id) for r in Q.candidate_visits(files(spark, rows)).collect()}
    assert got == {("MAILGUN_API_KEY", 1), ("NPM_TOKEN", 3), ("GCP_SERVICE_ACCOUNT_KEY", 4)}


def test_requested_searches():
    ids = ["rsa_private_key", "NO_SUCH", "EC_PRIVATE_KEY", "RSA_PRIVATE_KEY"]
    assert [(i, r.secret_id) for i, r in Q.requested_searches(ids)] == [(1, "RSA_PRIVATE_KEY"), (2, "EC_PRIVATE_KEY")]
    assert len(Q.requested_searches(["all"])) == 30 and Q.requested_searches([]) == []
    silent = replace(RULES[0], secret_id="SILENT", search_query="")
    assert [r.secret_id for _, r in Q.requested_searches(["SILENT", "EC_PRIVATE_KEY"], [*RULES, silent])] == ["EC_PRIVATE_KEY"]


def test_cap_is_exact_for_a_busy_search(spark):
    visits = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7 + 2).cast("int").alias("query_ord"),
        F.col("id").alias("file_id"))
    got = {}
    for r in Q.cap_visits(visits, 100).collect():
        got.setdefault(r.query_ord, []).append(r.file_id)
    expected = {}
    for r in visits.collect():
        expected.setdefault(r.query_ord, []).append(r.file_id)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:100] for k, v in expected.items()}


def test_findings_follow_search_order(spark):
    # File 2 is reached by an earlier search than file 1, so it owns the shared value.
    rows = [(1, A + " " + B), (2, A + " " + POSITIVE["RSA_PRIVATE_KEY"])]
    fs = files(spark, rows)
    got = {r.file_id: (r.query_ord, r.n_new) for r in
           P.findings(D.detect(fs), visits=Q.candidate_visits(fs)).collect()}
    assert got == {2: (2, 2), 1: (16, 1)}


def test_every_visit_counts_when_duplicates_are_kept(spark):
    rows = [(1, A + " " + B), (2, B)]
    fs = files(spark, rows)
    got = sorted((r.query_ord, r.file_id, r.n_new, r.key_count) for r in
                 P.findings(materialise(D.detect(fs)), False, Q.candidate_visits(fs)).collect())
    assert got == [(16, 1, 2, 2), (16, 2, 0, 1), (17, 1, 0, 2)]


def test_latest_commit_and_ties(spark):
    rows = [(1, "2024-01-01 00:00:00", "a", 1), (1, "2024-02-01 00:00:00", "b", 1), (1, "2024-02-01 00:00:00", "c", 2)]
    commits = spark.createDataFrame(rows, "repo_id long, ts string, commit_sha string, n int").selectExpr(
        "repo_id", "timestamp(ts) ts", "commit_sha", "cast(null as string) author_name",
        "cast(null as string) author_email", "n")
    row = H.latest_commit(commits, ["ts", "n"]).first()
    assert row.latest_commit_sha == "c" and row.latest_commit_author_name is None


def hydrated(spark, rows, repos, commits=None, keys=("repo_id",)):
    if commits is None:
        commits = spark.createDataFrame([], "repo_id long, ts timestamp, commit_sha string, author_name string, author_email string")
    owners = spark.createDataFrame([(7, "alice")], "owner_id long, owner_login string")
    return H.hydrate(rows, repos, owners, H.latest_commit(commits, keys=keys))


def test_hydration_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 11, "b"), (3, None, "c")], "file_id long, repo_id long, file_path string")
    repos = spark.createDataFrame([(10, 7, "alice/x", "u", ""), (12, 8, "z/z", "v", "dev")],
                                  "repo_id long, owner_id long, repo_name string, repo_url string, default_branch string")
    got = {r.file_id: r for r in hydrated(spark, rows, repos).collect()}
    assert len(got) == 3 and got[1].owner_login == "alice" and got[2].repo_name is None
    assert got[1].default_branch == "main" and got[1].repo_topics == [] and got[1].repo_languages == {}
    assert got[1].repo_pushed_at is None


def test_latest_commit_of_a_path(spark):
    commits = spark.createDataFrame([(10, "a", "2024-01-01", "old"), (10, "a", "2024-02-01", "new"), (10, "b", "2024-03-01", "other")],
                                    "repo_id long, file_path string, ts string, commit_sha string").selectExpr(
        "repo_id", "file_path", "timestamp(ts) ts", "commit_sha", "'n' author_name", "'e' author_email")
    rows = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 10, "c"), (4, None, "a")], "file_id long, repo_id long, file_path string")
    repos = spark.createDataFrame([(10, 7, "alice/x", "u", "")],
                                  "repo_id long, owner_id long, repo_name string, repo_url string, default_branch string")
    got = {r.file_id: r.latest_commit_sha for r in hydrated(spark, rows, repos, commits, ("repo_id", "file_path")).collect()}
    assert got == {1: "new", 2: "other", 3: None, 4: None}


def skewed(spark):
    """A third of all rows in one repository, a tenth in another, a third without any."""
    rows = spark.range(30_000).selectExpr(
        "id AS file_id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN null WHEN id % 10 = 2 THEN 2 ELSE id % 700 + 3 END "
        "AS repo_id", "concat('path', id) AS file_path")
    repos = spark.range(1, 600).selectExpr("id AS repo_id", "7L AS owner_id", "concat('alice/', id) AS repo_name",
                                           "'u' AS repo_url", "'main' AS default_branch")
    return rows, repos


def test_hot_keys(spark):
    rows, _ = skewed(spark)
    counts = key_counts(rows, ["repo_id"])
    share = rows.where("repo_id IS NOT NULL").count() / n_shares(rows)
    assert {r.repo_id: r.n_parts for r in hot_keys(counts, ["repo_id"]).collect()} == {
        r.repo_id: -int(-r.n_rows // share) for r in counts.collect() if r.n_rows > share}


@contextmanager
def plainly(spark, partitions=16):
    """Without adaptive execution or broadcasts by size."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions),
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def biggest_task(joined):
    return joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_hot_and_missing_repositories_are_spread_and_nothing_is_lost(spark):
    rows, repos = skewed(spark)
    columns = ["file_id", "repo_id", "repo_name", "owner_login"]
    plain = sorted(map(tuple, rows.join(repos, "repo_id", "left").selectExpr(
        "file_id", "repo_id", "repo_name", "if(owner_id = 7, 'alice', null)").collect()), key=str)
    spread = sorted(map(tuple, hydrated(spark, rows, repos).select(*columns).collect()), key=str)
    assert plain == spread and len(spread) == 30_000
    with plainly(spark):
        assert biggest_task(rows.join(repos, "repo_id", "left")) > 10_000
        assert biggest_task(spread_left_join(rows, repos, "repo_id", "file_id")) < 4_000


def test_missing_keys_are_spread_without_hot_ones(spark):
    rows = spark.range(20_000).selectExpr("id AS file_id", "if(id % 3 = 0, null, id) AS repo_id")
    repos = spark.range(0, 20_000, 2).selectExpr("id AS repo_id", "'x' AS repo_name")
    with plainly(spark):
        joined = spread_left_join(rows, repos, "repo_id", "file_id")
        assert joined.count() == 20_000 and biggest_task(joined) < 3_000


def test_hot_owner_is_spread_and_nothing_is_lost(spark):
    rows, repos = skewed(spark)
    repos = repos.withColumn("owner_id", F.expr("CASE WHEN repo_id < 300 THEN 7 WHEN repo_id < 400 THEN null ELSE repo_id END"))
    got = hydrated(spark, rows, repos).select("file_id", "owner_id", "owner_login").collect()
    assert len(got) == 30_000 and sum(r.owner_login == "alice" for r in got) == rows.where("repo_id < 300").count()


def test_a_hot_repository_in_scope_is_spread(spark):
    rows, repos = skewed(spark)
    owners = spark.createDataFrame([(7, "alice", "User", 1)], "owner_id long, owner_login string, owner_type string, owner_public_repos int")
    scopes = spark.createDataFrame([("user", "Alice"), ("repo", "alice/1")], "scope_type string, name string")
    with plainly(spark):
        kept = S.restrict(rows, scopes, repos, owners)
        assert kept.count() == rows.where("repo_id BETWEEN 1 AND 599").count() and biggest_task(kept) < 3_000
