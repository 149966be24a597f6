import pytest
from pyspark.sql import functions as F

from keysift.operators import classify as C
from tests.hits import AS_OF, days_ago, frame, hit, unlabelled


def label(spark, **changes):
    return C.classify(unlabelled(spark, [hit(**changes)]), AS_OF).first()


CASES = [
    # changes, score, label, part of the signals (None: no signal expected)
    (dict(), 0.0, "ACCIDENTAL", None),
    (dict(repo_name="threatactor/ssh-dump-2024"), 0.45, "LEAKED", "'dump'"),
    # List order decides: 'dump' stands before 'logs', wherever they occur.
    (dict(repo_name="x/logs-dump"), 0.45, "LEAKED", "'dump'"),
    (dict(repo_name="x/y", latest_commit_author_name="Stranger", latest_commit_author_email="stranger@dark.io",
          owner_login="repoowner"), 0.4, "LEAKED", "commit author 'Stranger' ≠ repo owner 'repoowner'"),
    (dict(owner_login="repo-owner", latest_commit_author_name="X", latest_commit_author_email="REPO-OWNER@a.b"), 0.0,
     "ACCIDENTAL", None),
    (dict(latest_commit_author_name=None, latest_commit_author_email=None, owner_created_at=None), 0.0, "ACCIDENTAL", None),
    (dict(pem_headers=150), 0.4, "LEAKED", "mass key dump: 150 keys in file"),
    (dict(pem_headers=100), 0.4, "LEAKED", "mass key dump"), (dict(keys=99), 0.25, "UNCERTAIN", "bulk keys: 99"),
    (dict(keys=10), 0.25, "UNCERTAIN", "bulk keys: 10"), (dict(keys=9), 0.0, "ACCIDENTAL", None),
    (dict(repo_url="https://gist.github.com/abc"), 0.2, "UNCERTAIN", "hosted as a GitHub Gist"),
    (dict(repo_name="gist:abc"), 0.2, "UNCERTAIN", "Gist"),
    (dict(owner_login="abcd1234", latest_commit_author_name="abcd1234"), 0.15, "ACCIDENTAL", "suspicious username"),
    (dict(owner_login="Bob-123456", latest_commit_author_name="bob"), 0.15, "ACCIDENTAL", "suspicious username"),
    (dict(owner_login="The.Ghost", latest_commit_author_name="ghost"), 0.15, "ACCIDENTAL", "suspicious username"),
    (dict(owner_created_at=days_ago(29, 23)), 0.2, "UNCERTAIN", "account only 29 days old"),
    (dict(owner_created_at=days_ago(30)), 0.0, "ACCIDENTAL", None),
    # Created after the moment of analysis: days are rounded down.
    (dict(owner_created_at=days_ago(0, -1)), 0.2, "UNCERTAIN", "account only -1 days old"),
    (dict(file_path=".ssh/id_rsa"), 0.0, "ACCIDENTAL", "single key in personal .ssh/"),
    (dict(file_path=".ssh/id_rsa", keys=2), 0.0, "ACCIDENTAL", "file path matches normal dev pattern: '.ssh/id_rsa'"),
    (dict(file_path="Tests/My_Key"), 0.0, "ACCIDENTAL", "key in test/fixture/example folder: 'Tests/My_Key'"),
    (dict(file_path="a/terraform/prod_key", repo_name="a/dump"), 0.15, "ACCIDENTAL", "normal dev pattern"),
    (dict(file_path="server.PEM"), 0.0, "ACCIDENTAL", "weak accidental signal"),
    # The running score 0.40 - 0.30 is just above 0.10, so the weak signal does not fire.
    (dict(file_path="a/terraform/key.pem", pem_headers=100), 0.1, "ACCIDENTAL", "normal dev pattern"),
    (dict(file_path="x/key.pem", owner_login="abcd1234", latest_commit_author_name="abcd1234"), 0.15, "ACCIDENTAL",
     "suspicious username"),
    (dict(repo_topics=["python", "pentest", "ctf"], repo_name="a/dump"), 0.35, "UNCERTAIN", "repo topic 'ctf'"),
    (dict(repo_topics=["ctf-writeups"], repo_name="a/dump"), 0.45, "LEAKED", "'dump'"),
    (dict(repo_name="ghost99/leak", owner_login="ghost99", keys=120, owner_created_at=days_ago(1),
          repo_url="https://gist.github.com/ghost99/leak", latest_commit_author_email="x@y.z"), 1.0, "LEAKED", "mass"),
    (dict(keys=0), 0.0, "ACCIDENTAL", None),
]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [hit(i, **dict(c[0])) for i, c in enumerate(CASES)]
    return {r.file_id: r for r in C.classify(unlabelled(spark, rows), AS_OF).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(labelled, i):
    changes, score, expected, signal = CASES[i]
    row = labelled[i]
    assert (row.confidence_score, row.classification) == (score, expected), row.signals
    if signal is None:
        assert row.signals == []
    else:
        assert any(signal in s for s in row.signals), row.signals


def test_pem_signal_needs_low_score(labelled):
    i = next(i for i, c in enumerate(CASES) if c[0].get("pem_headers") == 100 and "file_path" in c[0])
    assert not labelled[i].sig_pem and not any(".pem" in s and "weak" in s for s in labelled[i].signals)


def test_copied_fields(spark):
    row = label(spark, latest_commit_date=None)
    assert row.commit_date == "unknown" and row.key_count == 1
    assert label(spark).commit_date == "2024-06-10T12:00:00+00:00"


def test_missing_context_is_tolerated(spark):
    row = C.classify(unlabelled(spark, [hit(repo_name=None, repo_url=None, owner_login=None, repo_topics=None)]), AS_OF).first()
    assert row.classification in ("ACCIDENTAL", "UNCERTAIN", "LEAKED")


def test_scores_stay_within_bounds(labelled):
    assert all(0.0 <= r.confidence_score <= 1.0 for r in labelled.values())


def test_run_summary(spark):
    rows = frame(spark, [hit(0, keys=3), hit(1, classification="ACCIDENTAL"), hit(2, classification="UNCERTAIN", n_new=0)])
    assert tuple(C.run_summary(rows).first()) == (3, 1, 1, 1, 4)
    assert tuple(C.run_summary(rows.where(F.lit(False))).first()) == (0, 0, 0, 0, 0)
