import random
from datetime import datetime, timedelta

import pytest

from keysift.operators import hydrate as H

START = datetime(2024, 1, 1)
COMMITS = "repo_id long, ts timestamp, seq long, commit_sha string, author_name string, author_email string"


def commits(spark, rows):
    return spark.createDataFrame([(r, t, k, f"c{k}", f"a{k}", None) for k, (r, t) in enumerate(rows)], COMMITS).repartition(3)


def asked(spark, rows):
    return spark.createDataFrame(rows, "repo_id long, seen_at timestamp").repartition(3)


def answers(frame):
    return {(r.repo_id, r.seen_at): r.latest_commit_sha for r in frame.collect()}


@pytest.mark.parametrize("step", ["HOUR", "DAY", "YEAR"])
def test_as_of_against_a_search(spark, step):
    draw = random.Random(8)
    at = lambda: START + timedelta(minutes=draw.randint(0, 600) * 30)
    made = [(draw.randint(0, 5), at()) for _ in range(200)] + [(None, at()), (2, None)]
    rows = [(draw.randint(0, 7), at()) for _ in range(150)]
    want = {}
    for repo, t in rows:
        before = [(ts, k) for k, (r, ts) in enumerate(made) if r == repo and ts is not None and ts <= t]
        want[repo, t] = f"c{max(before)[1]}" if before else None
    got = answers(H.latest_commit_as_of(asked(spark, rows + [(None, at()), (3, None)]), commits(spark, made), "seen_at", ["ts", "seq"], step))
    assert got == want and None in want.values()


def test_the_same_moment_counts_and_a_later_one_does_not(spark):
    made = commits(spark, [(1, START), (1, START), (1, START + timedelta(microseconds=1))])
    got = H.latest_commit_as_of(asked(spark, [(1, START), (1, START - timedelta(seconds=1))]), made, "seen_at", ["ts", "seq"])
    assert answers(got) == {(1, START): "c1", (1, START - timedelta(seconds=1)): None}


def test_no_join_by_range(spark, corpus):
    rows = asked(spark, [(1, START)])
    plan = H.latest_commit_as_of(rows, corpus.commits, "seen_at")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_context_is_made_for_the_rows_repositories_only(spark, corpus):
    few = corpus.files.where("file_id < 6").select("file_id", "repo_id", "file_path")
    counts = H.repository_counts(few)
    latest = H.latest_commit(H.of_repositories(corpus.commits, counts))
    hits = H.hydrate(few, corpus.repos, corpus.owners, latest, corpus.languages, corpus.topics, counts=counts)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 4  # repositories, commits, languages, topics
    lines = plan.splitlines()
    aggregate = next(i for i, x in enumerate(lines) if "Aggregate" in x and "max(struct(ts" in x)
    assert any("Join LeftSemi" in x for x in lines[aggregate + 1:aggregate + 3])  # before commits are aggregated
    everything = H.hydrate(corpus.files.drop("content"), corpus.repos, corpus.owners, H.latest_commit(corpus.commits), corpus.languages, corpus.topics)
    assert sorted(map(str, everything.where("file_id < 6").select(*hits.columns).collect())) == sorted(map(str, hits.collect()))


def test_commits_of_other_repositories_are_turned_away_before_the_shuffle(spark):
    made = commits(spark, [(r, START) for r in range(3000)])
    counts = H.repository_counts(asked(spark, [(r, START) for r in range(50)] + [(None, START)]))
    near = {r.repo_id for r in H._mostly_of_repositories(made, counts).collect()}
    assert set(range(50)) <= near and len(near) < 300
    assert sorted(r.repo_id for r in H.of_repositories(made, counts).collect()) == list(range(50))


def test_commits_are_dealt_by_step_once(spark):
    made = commits(spark, [(1, START + timedelta(hours=k)) for k in range(100)])
    found = H.latest_commit_as_of(asked(spark, [(1, START + timedelta(days=9)), (1, START)]), made, "seen_at", ["ts", "seq"])
    assert answers(found) == {(1, START + timedelta(days=9)): "c99", (1, START): "c0"}
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("ReusedExchange" in line and "REPARTITION_BY_COL" in line for line in lines)
