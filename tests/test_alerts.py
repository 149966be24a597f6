import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keysift.operators import detect as D
from keysift.operators import trends as T
from keysift.sources.tables import arriving_files
from keysift.streaming.alerts import batch_alerts, first_seen_events, write_events
from tests import hits
from tests.test_detect import POSITIVE

START = datetime(2024, 1, 1)
FILES = "file_id long, at timestamp, content string"
FOUND = "repo_url string, latest_commit_date timestamp"


class Land:
    """A folder in which files arrive one by one; every micro-batch is one file."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return arriving_files(self.spark, self.path, self.schema, maxFilesPerTrigger=1)


def at(hours):
    return START + timedelta(hours=hours)


@pytest.fixture
def land(spark, tmp_path):
    return lambda schema: Land(spark, tmp_path / "land", schema)


def run(events, tmp_path):
    out = str(tmp_path / "out")
    write_events(events, out, str(tmp_path / "state")).awaitTermination()
    return events.sparkSession.read.parquet(out).collect()


def test_first_seen_equals_the_batch_answer_inside_the_watermark(spark, corpus, land, tmp_path):
    place = land(FILES)
    rows = [(r.file_id, at(r.file_id % 48), r.content) for r in corpus.files.collect()]
    random.Random(1).shuffle(rows)  # repeated and out of order, all within the delay
    for k in range(0, len(rows), 50):
        place(rows[k:k + 50] + rows[:10])
    got = [r.sha256_fingerprint for r in run(first_seen_events(place.stream(), "at", "72 hours"), tmp_path)]
    want = {r.sha256_fingerprint for r in D.detections(corpus.files).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_first_seen_after_the_delay_and_late_rows(spark, land, tmp_path):
    place, (a, b, c) = land(FILES), (POSITIVE[k] for k in ("NPM_TOKEN", "GITLAB_TOKEN", "STRIPE_SECRET_KEY"))
    place([(1, at(0), a)])
    place([(2, at(1), a), (3, None, c)])      # a again within the delay; no time
    place([(4, at(30), b)])
    place([(8, at(30), b)])                   # the watermark is at 20 from here on
    place([(5, at(0), c)])                    # late
    place([(6, at(31), a), (7, at(31), b)])   # a has expired and is new again, b has not
    got = sorted((r.secret_id, r.file_id) for r in run(first_seen_events(place.stream(), "at", "10 hours"), tmp_path))
    assert got == [("GITLAB_TOKEN", 4), ("NPM_TOKEN", 1), ("NPM_TOKEN", 6)]


def test_a_restarted_stream_goes_on(spark, land, tmp_path):
    place, token = land(FILES), POSITIVE["NPM_TOKEN"]
    place([(1, at(0), token)])
    assert len(run(first_seen_events(place.stream(), "at", "10 hours"), tmp_path)) == 1
    place([(2, at(1), token), (3, at(1), POSITIVE["GITLAB_TOKEN"])])
    assert len(run(first_seen_events(place.stream(), "at", "10 hours"), tmp_path)) == 2


def test_alerts_come_with_the_third_repository(spark, land, tmp_path):
    place = land(FOUND)
    place([("r1", at(0.1)), ("r1", at(0.2)), ("r2", at(0.9)), ("x", at(1.5))])
    place([("r2", at(0.3)), (None, at(0.3)), ("r9", None)])
    assert run(batch_alerts(place.stream(), "5 hours"), tmp_path) == []
    place([("r3", at(0.5)), ("r4", at(0.5)), ("y", at(1.6))])
    place([("r5", at(0.5)), ("z", at(1.0))])  # an hour is reported once
    got = {r.hour: r.repos for r in run(batch_alerts(place.stream(), "5 hours"), tmp_path)}
    assert set(got) == {"2024-01-01T00", "2024-01-01T01"} and got["2024-01-01T01"] == ["x", "y", "z"]
    assert set(got["2024-01-01T00"]) > {"r1", "r2"} and len(got["2024-01-01T00"]) == 3


def test_late_rows_raise_no_alert(spark, land, tmp_path):
    place = land(FOUND)
    place([("r1", at(0)), ("r2", at(0))])
    place([("r9", at(50))])
    place([("r9", at(50))])
    place([("r3", at(0)), ("r4", at(0)), ("r5", at(0)), ("r6", at(0))])
    assert run(batch_alerts(place.stream(), "2 hours"), tmp_path) == []


def test_alerts_equal_batch_hours(spark, land, tmp_path):
    draw = random.Random(5)
    rows = [(f"r{draw.randint(0, 15)}", at(draw.randint(0, 40) + draw.random())) for _ in range(300)] + [(f"hot{k % 90}", at(7.5)) for k in range(900)]
    draw.shuffle(rows)
    place = land(FOUND)
    for k in range(0, len(rows), 300):
        place(rows[k:k + 300])
    got = [r.hour for r in run(batch_alerts(place.stream(), "72 hours"), tmp_path)]
    want = [r.hour for r in T.batch_hours(spark.createDataFrame(rows, FOUND)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10


def test_the_widest_rows_of_findings_fit(spark, tmp_path):
    found = hits.frame(spark, [hits.hit(k, repo_name=f"a/r{k}", latest_commit_date=hits.days_ago(3)) for k in range(4)])
    found.coalesce(1).write.parquet(str(tmp_path / "land"))
    stream = arriving_files(spark, str(tmp_path / "land"), found.schema)
    assert [r.hour for r in run(batch_alerts(stream).where(F.size("repos") == 3), tmp_path)] == ["2024-06-12T12"]
