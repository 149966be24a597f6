import random
from datetime import timedelta

import pytest

from keysift import wordlists as w
from keysift.operators import trends as T
from tests import hits
from tests.hits import AS_OF, days_ago, frame, hit


def sections(spark, rows):
    return T.trend_report(T.leaked(frame(spark, rows)), AS_OF)


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_empty_report(spark):
    s = sections(spark, [hit(classification="ACCIDENTAL")])
    assert tuple(s["totals"].first()) == (0, 0, 0, 0, 0.0, 0.0, 0, 0, 0, 0)
    assert [r.n_commits for r in s["hour_heatmap"].collect()] == [0] * 24
    assert pairs(s["weekday_heatmap"]) == [(d, 0) for d in w.WEEKDAYS]
    assert [r.n_findings for r in s["volume_buckets"].collect()] == [0] * 4
    assert s["batch_suspected"].first()[0] is False
    for name in ("account_profiles", "top_accounts", "automation_suspects", "keyword_frequency", "top_name_tokens",
                 "language_share", "sophistication_tiers", "batch_evidence", "artifact_frequency"):
        assert s[name].count() == 0, name


def test_only_leaked_counts(spark):
    s = sections(spark, [hit(0, keys=4), hit(1, classification="ACCIDENTAL"), hit(2, classification="UNCERTAIN")])
    assert s["totals"].first()[:4] == (1, 1, 1, 4)


@pytest.mark.parametrize("counts, expected", [([2, 4, 6, 8, 10], 6.0), ([7], 7.0), ([1, 2], 1.5), ([1, 5, 50, 200], 27.5)])
def test_median(spark, counts, expected):
    rows = [hit(i, keys=k) for i, k in enumerate(counts)]
    assert sections(spark, rows)["totals"].first().median_keys_per_repo == expected


def test_volume_buckets(spark):
    rows = [hit(i, keys=k) for i, k in enumerate([1, 5, 50, 200, 0])]
    assert [r.n_findings for r in sections(spark, rows)["volume_buckets"].collect()] == [1, 2, 1, 1]


def test_automation(spark):
    rows = [hit(i, keys=20, owner_login="bot", owner_created_at=days_ago(15)) for i in range(6)]
    rows += [hit(10 + i, owner_login="calm", owner_created_at=days_ago(2000)) for i in range(5)]
    s = sections(spark, rows)
    suspects = s["automation_suspects"].collect()
    assert [r.owner_login for r in suspects] == ["bot"]
    assert suspects[0].automation_signals == ["6 leak repos from one account", "account only 15 days old",
                                              "120 keys across repos"]


@pytest.mark.parametrize("age, text", [(6, "< 1 week"), (7, "< 1 month"), (29, "< 1 month"), (89, "< 3 months"), (364, "< 1 year"),
                                       (365, "≥ 1 year"), (9998, "≥ 1 year"), (9999, "unknown"), (None, "unknown")])
def test_age_bands(spark, age, text):
    rows = [hit(owner_created_at=None if age is None else days_ago(age))]
    assert sections(spark, rows)["account_profiles"].first().age_label.startswith(text)


def test_profile_takes_first_finding(spark):
    rows = [hit(3, owner_followers=9, owner_location="Oslo"), hit(1, owner_followers=2, owner_location=None),
            hit(2, owner_login="bob", owner_location="Rome")]
    got = {r.owner_login: r for r in sections(spark, rows)["account_profiles"].collect()}
    assert got["alice"].followers == 2 and got["alice"].locations == [None] and got["alice"].repo_count == 2
    assert got["bob"].locations == ["Rome"]


def test_top_accounts_limit_and_ties(spark):
    rows = [hit(i, owner_login=f"u{i:02d}", keys=3 if i != 15 else 9) for i in range(20)]
    got = [r.owner_login for r in sections(spark, rows)["top_accounts"].collect()]
    assert got == ["u15"] + [f"u{i:02d}" for i in range(9)]


def test_keywords_overlap_and_keep_order_of_appearance(spark):
    rows = [hit(0, repo_name="x/botnet"), hit(1, repo_name="x/leak-Logs")]
    assert pairs(sections(spark, rows)["keyword_frequency"]) == [("botnet", 1), ("bot", 1), ("logs", 1), ("leak", 1)]


def test_name_tokens(spark):
    rows = [hit(0, repo_name="own/The-Dump_of-dump2 a b/c-x1"), hit(1, repo_name="noslash-dump")]
    assert pairs(sections(spark, rows)["top_name_tokens"]) == [("dump", 2), ("dump2", 1), ("x1", 1), ("noslash", 1)]


def test_language_share_rounds_half_even(spark):
    rows = [hit(i, repo_language=None if i == 0 else "" if i == 1 else "Go") for i in range(16)]
    assert pairs(sections(spark, rows)["language_share"]) == [("Go", 14, 87.5), ("Unknown", 2, 12.5)]
    rows = [hit(i, repo_language="C" if i == 0 else "Go") for i in range(16)]
    assert [r.pct for r in sections(spark, rows)["language_share"].collect()] == [93.8, 6.2]


def test_sophistication(spark):
    rows = [
        hit(0, repo_language="Rust", repo_languages={"a": 1, "b": 1, "c": 1}, repo_size_kb=501, repo_stargazers=10,
            repo_description="d"),
        hit(1, repo_language="Text", repo_size_kb=50, repo_description=""),
        hit(2, repo_language="Brainf", repo_languages={}, repo_size_kb=51),
        hit(3, repo_language=None, repo_languages=None, repo_size_kb=None, repo_stargazers=None),
        hit(4, repo_languages={"a": 1, "b": 1}, repo_size_kb=51),
    ]
    df = frame(spark, rows)
    assert [r.score for r in T.sophistication_scores(df).orderBy("file_id").collect()] == [10, 0, 2, 1, 5]
    assert [r.n_findings for r in T.sophistication_tiers(df).collect()] == [3, 1, 1]


def test_heatmaps_and_batches(spark):
    base = days_ago(3)  # a Wednesday at noon
    rows = [hit(i, repo_name=f"a/r{i}", latest_commit_date=base) for i in range(4)]
    rows += [hit(9, latest_commit_date=None), hit(10, repo_name="a/r0", latest_commit_date=base)]
    s = sections(spark, rows)
    assert {r.hour: r.n_commits for r in s["hour_heatmap"].collect() if r.n_commits} == {"12": 5}
    assert {r.weekday: r.n_commits for r in s["weekday_heatmap"].collect() if r.n_commits} == {"Wed": 5}
    assert s["batch_suspected"].first()[0] is True
    assert pairs(s["batch_evidence"]) == [("2024-06-12T12Z: 4 repos committed in same hour",)]


def test_batch_needs_three_distinct_repositories(spark):
    rows = [hit(i, repo_name=f"a/r{i % 2}", latest_commit_date=days_ago(3)) for i in range(6)]
    assert sections(spark, rows)["batch_suspected"].first()[0] is False


def test_artifacts(spark):
    rows = [hit(0, file_path="Logs/PASSWORDS.txt"), hit(1, file_path="wallet/metamask/cookies.txt"), hit(2)]
    s = sections(spark, rows)
    assert s["totals"].first().repos_with_stealer_artifacts == 2
    assert pairs(s["artifact_frequency"]) == [("passwords.txt", 1), ("cookies.txt", 1), ("metamask", 1)]


def test_freshness_limits_are_strict(spark):
    rows = [hit(0, repo_pushed_at=days_ago(5)), hit(1, repo_pushed_at=days_ago(30)), hit(2, repo_pushed_at=days_ago(180)),
            hit(3, repo_pushed_at=days_ago(200)), hit(4, repo_pushed_at=None)]
    assert tuple(sections(spark, rows)["freshness"].first()) == (1, 2, 2)


def test_long_form_agrees_with_sections(spark):
    rows = [hit(i, repo_name=f"o{i % 3}/stealer-logs-{i}", owner_login=f"o{i % 3}", keys=i % 12 + 1,
                file_path="a/cookies.txt") for i in range(60)]
    df = frame(spark, rows)
    long = {(r.section, r.label): r.value for r in T.trend_long(df, AS_OF).collect()}
    s = T.trend_report(df, AS_OF)
    assert {k[1]: v for k, v in long.items() if k[0] == "token"} == {
        r.token: str(r.n) for r in s["top_name_tokens"].collect()}
    assert {k[1]: v for k, v in long.items() if k[0] == "hour"} == {
        r.hour: str(r.n_commits) for r in s["hour_heatmap"].collect()}
    assert long["totals", "total_keys_observed"] == str(s["totals"].first().total_keys_observed)
    assert len([k for k in long if k[0] == "token"]) == 20


def test_no_email_in_trends(spark):
    for df in sections(spark, [hit()]).values():
        assert not any("email" in c for c in df.columns)


def test_sessions_do_not_stop_at_the_full_hour(spark):
    at = lambda minutes: hits.NOW + timedelta(minutes=minutes)
    found = hits.frame(spark, [hits.hit(k, owner_login=o, repo_name=f"{o}/r{r}", latest_commit_date=None if m is None else at(m))
                               for k, (o, r, m) in enumerate([("a", 1, 50), ("a", 2, 59), ("a", 3, 70), ("a", 3, 70), ("a", 4, 130), ("a", 5, 189),
                                                              ("b", 1, 0), (None, 1, 0), ("c", 1, None), ("b", 2, 59), ("b", 2, -60)])])
    rows = sorted((r.owner_login, r.session_start.minute, r.n_findings, r.n_repos) for r in T.upload_sessions(found).collect())
    assert rows == [("a", 10, 2, 2), ("a", 50, 4, 3), ("b", 0, 1, 1), ("b", 0, 2, 2)]
    assert [r.n_repos for r in T.upload_bursts(T.upload_sessions(found)).collect()] == [3] and T.batch_hours(found).count() == 0


def test_sessions_against_a_walk_over_sorted_times(spark):
    draw = random.Random(3)
    rows = [(f"o{draw.randint(0, 3)}", f"r{draw.randint(0, 9)}", draw.randint(0, 60 * 24 * 3)) for _ in range(300)]
    found = hits.frame(spark, [hits.hit(k, owner_login=o, repo_name=r, latest_commit_date=hits.NOW + timedelta(minutes=m)) for k, (o, r, m) in enumerate(rows)])
    want = []
    for o in {r[0] for r in rows}:
        last = None
        for m, r in sorted((m, r) for x, r, m in rows if x == o):
            if last is None or m - last >= 45:
                want.append([o, m, m, 0, set()])
            want[-1][2], want[-1][3], last = m, want[-1][3] + 1, m
            want[-1][4].add(r)
    minutes = lambda t: round((t - hits.NOW.replace(tzinfo=None)).total_seconds() / 60)
    got = [(r.owner_login, minutes(r.session_start), minutes(r.session_end), r.n_findings, r.n_repos) for r in T.upload_sessions(found, 45).collect()]
    assert sorted(got) == sorted((*w[:4], len(w[4])) for w in want)
