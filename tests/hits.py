"""Small hydrated findings for tests; every field has a harmless default."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

AS_OF = "2024-06-15 12:00:00"
NOW = datetime(2024, 6, 15, 12, tzinfo=timezone.utc)

SCHEMA = """file_id long, key_count int, pem_headers int, n_new int, repo_name string, repo_url string, repo_description string,
    file_path string, repo_created_at timestamp, repo_pushed_at timestamp, repo_language string,
    repo_languages map<string,bigint>, repo_topics array<string>, repo_stargazers int, repo_size_kb bigint,
    owner_login string, owner_type string, owner_created_at timestamp, owner_public_repos int, owner_followers int,
    owner_location string, latest_commit_sha string, latest_commit_author_name string,
    latest_commit_author_email string, latest_commit_date timestamp,
    secrets array<struct<ord:int,pos:int,sha:string,sample:string>>, classification string"""


def days_ago(n, hours=0):
    return NOW - timedelta(days=n, hours=hours)


def hit(file_id=0, **changes):
    keys = changes.pop("keys", 1)
    name = changes.get("repo_name", "alice/my-project")
    row = {
        "file_id": file_id, "key_count": keys, "pem_headers": 0, "n_new": keys, "repo_name": name,
        "repo_url": f"https://github.com/{name}", "repo_description": None, "file_path": "collected/keys.txt",
        "repo_created_at": days_ago(900), "repo_pushed_at": days_ago(10), "repo_language": "Python",
        "repo_languages": {"Python": 1000}, "repo_topics": [], "repo_stargazers": 0, "repo_size_kb": 50,
        "owner_login": "alice", "owner_type": "User", "owner_created_at": None, "owner_public_repos": 10,
        "owner_followers": 5, "owner_location": None, "latest_commit_sha": "abc",
        "latest_commit_author_name": "Alice Smith", "latest_commit_author_email": "alice@example.com",
        "latest_commit_date": days_ago(5),
        "secrets": [(2, i, f"{file_id:032d}{i:032d}", "MIIE****") for i in range(keys)],
        "classification": "LEAKED",
    }
    row.update(changes)
    return tuple(row.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def unlabelled(spark, rows):
    return frame(spark, rows).drop("classification")
