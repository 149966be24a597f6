import csv
import glob
import json

import pytest

from keysift.operators import classify as C
from keysift.operators import reports as R
from keysift.operators import scope as S
from keysift.plans.scan import Inputs, classified_findings, run
from keysift.sources.corpus import AS_OF as CORPUS_AS_OF
from keysift.sources.corpus import COMMIT_ORDER
from tests.hits import AS_OF, hit, unlabelled


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [hit(0, repo_name="bad/leak-dump", keys=3), hit(1, file_path='a "quoted", path\nwith break.txt'),
            hit(2, latest_commit_author_email=None), hit(3, latest_commit_author_email=""),
            hit(4, keys=12, latest_commit_author_name=None, latest_commit_sha=None, latest_commit_date=None),
            hit(5, secrets=[(21, 0, "s1", "AC12****"), (2, 0, "s2", "MIIE****"), (3, 0, "s3", "MIIE****")], keys=3)]
    return C.classify(unlabelled(spark, rows), AS_OF)


def test_disclosure(labelled):
    got = {r.secret_count: r for r in R.disclosure_targets(labelled).collect()}
    assert len(got) == 3 and all(r.classification != "LEAKED" for r in got.values())
    assert got[12].author_name == "" and got[12].commit_sha == "" and got[12].commit_date == "unknown"
    assert got[3].secret_types == "TWILIO_ACCOUNT_SID;RSA_PRIVATE_KEY;EC_PRIVATE_KEY"
    assert got[3].secret_categories == "api_key;private_key" and got[3].secret_sha256_fingerprints == "s1;s2;s3"
    assert R.disclosure_targets(labelled).columns == [
        "author_email", "author_name", "repo_url", "file_path", "commit_sha", "commit_date", "classification",
        "secret_types", "secret_categories", "secret_count", "secret_sha256_fingerprints"]


def test_records(labelled):
    records = R.finding_records(labelled)
    assert "author_email" not in records.columns and "author_email" in R.finding_records(labelled, with_email=True).columns
    row = next(r for r in records.collect() if r.file_id == 5)
    assert row.secrets[0].secret_id == "TWILIO_ACCOUNT_SID" and row.secrets[0].redacted_sample == "AC12****"
    assert row.repo_created_at.endswith("+00:00")


def test_metadata(labelled):
    row = R.findings_metadata(labelled, "now").first()
    assert (row.total_findings, row.leaked_count, row.accidental_count, row.uncertain_count) == (6, 1, 4, 1)
    assert row.secrets_by_category == {"private_key": 3 + 1 + 1 + 1 + 12 + 2, "api_key": 1}


def inputs(c):
    return Inputs(c.files, c.repos, c.owners, c.commits, c.languages, c.topics, COMMIT_ORDER)


def test_whole_run_writes_reports(spark, corpus, tmp_path):
    result = run(inputs(corpus), CORPUS_AS_OF, str(tmp_path))
    total = result.summary.first().total_findings
    records = [json.loads(x) for p in glob.glob(result.paths["findings"] + "/*.json") for x in open(p, encoding="utf-8")]
    assert len(records) == total == 95
    assert all(len(s["redacted_sample"]) <= 8 for r in records for s in r["secrets"])
    meta = [json.loads(x) for p in glob.glob(result.paths["metadata"] + "/*.json") for x in open(p)]
    assert len(meta) == 1 and meta[0]["total_findings"] == total
    with_header = [list(csv.reader(open(p))) for p in glob.glob(result.paths["disclosure"] + "/*.csv")]
    assert all(rows[0][0] == "author_email" and all(len(r) == 11 for r in rows) for rows in with_header)
    assert sum(len(rows) - 1 for rows in with_header) == R.disclosure_targets(result.findings).count()
    assert set(result.paths["trends"]) == set(result.trends)
    for p in [f for kind in ("json", "csv") for f in glob.glob(f"{tmp_path}/**/part-*.{kind}", recursive=True)]:
        text = open(p, encoding="utf-8").read()
        assert "-----BEGIN" not in text
        assert "/trend_analysis_" not in p or "@example.com" not in text


def test_csv_survives_quotes_and_line_breaks(spark, labelled, tmp_path):
    from keysift.sources.tables import write_disclosure_csv
    path = write_disclosure_csv(R.disclosure_targets(labelled), str(tmp_path), "x")
    rows = [r for p in glob.glob(path + "/*.csv") for r in csv.DictReader(open(p, newline="", encoding="utf-8"))]
    assert 'a "quoted", path\nwith break.txt' in [r["file_path"] for r in rows]


def test_run_within_a_scope(spark, corpus):
    login = corpus.owners.where("owner_id = 1").first().owner_login
    scopes = S.resolve_targets(S.parse_targets(spark.createDataFrame([(login,)], "raw string")), corpus.owners, corpus.repos)
    got = classified_findings(inputs(corpus), CORPUS_AS_OF, scopes=scopes)
    assert {r.owner_login for r in got.collect()} == {login}


def test_rerun_gives_the_same(spark, corpus):
    def once():
        return sorted(map(str, classified_findings(inputs(corpus), CORPUS_AS_OF).select(
            "file_id", "classification", "confidence_score", "signals", "secrets").collect()))
    assert once() == once()
