import hashlib

import pytest
from pyspark.sql import functions as F

from keysift.functions import bloom as B
from keysift.operators import detect as D
from keysift.operators import findings as P
from keysift.plans.durable import materialise
from keysift.sources.fingerprints import FingerprintStore


def sha(k):
    return hashlib.sha256(str(k).encode()).hexdigest()


def rows(spark, keys):
    return spark.createDataFrame([(sha(k), k) for k in keys], "sha string, file_id long")


def ids(frame):
    return sorted(r.file_id for r in frame.collect())


def kept(store):
    return {r.sha: r.label for r in store.fingerprints().collect()}


def test_batches_see_what_others_brought(spark, tmp_path):
    store = FingerprintStore(spark, str(tmp_path / "s"), n_buckets=8)
    assert ids(store.take(rows(spark, range(10)), "a")) == list(range(10))
    assert ids(store.take(rows(spark, range(5, 15)), "b")) == list(range(10, 15))
    assert ids(store.take(rows(spark, range(15)), "c")) == []
    assert kept(store) == {sha(k): "a" if k < 10 else "b" for k in range(15)}


def test_a_repeated_batch_replaces_its_own(spark, tmp_path):
    store = FingerprintStore(spark, str(tmp_path / "s"))
    store.take(rows(spark, range(10)), "a")
    store.take(rows(spark, range(8, 20)), "b")
    again = FingerprintStore(spark, str(tmp_path / "s"))  # by another driver
    assert ids(again.take(rows(spark, range(8, 20)), "b")) == list(range(10, 20))
    assert ids(again.take(rows(spark, range(3)), "a")) == [0, 1, 2]
    assert set(kept(again)) == {sha(k) for k in [*range(3), *range(10, 20)]}


def test_compaction_and_vacuum_keep_every_fingerprint(spark, tmp_path):
    path = str(tmp_path / "s")
    store = FingerprintStore(spark, path, n_buckets=4)
    for k in range(5):
        store.take(rows(spark, range(k * 10, k * 10 + 12)), f"batch-{k}")
    before = set(kept(store))
    store.compact(keep=2)
    labels = list(kept(store).values())
    assert set(kept(store)) == before and labels.count(None) == 32 and set(labels) == {None, "batch-3", "batch-4"}
    store.vacuum()
    fresh = FingerprintStore(spark, path, n_buckets=999)
    assert set(kept(fresh)) == before and fresh.n_buckets == 4
    assert ids(fresh.take(rows(spark, range(60)), "later")) == list(range(52, 60))
    assert len(list((tmp_path / "s" / "segments").iterdir())) == 4 and len(list((tmp_path / "s" / "snapshots").iterdir())) == 1


def test_half_written_work_is_not_read(spark, tmp_path):
    path = tmp_path / "s"
    store = FingerprintStore(spark, str(path))
    store.take(rows(spark, range(4)), "a")
    store._segment(rows(spark, range(100, 110)).select(F.unhex("sha").alias("fp")), "lost", 9)  # no snapshot names it
    (path / "snapshots" / "99" / "_temporary").mkdir(parents=True)
    assert set(kept(FingerprintStore(spark, str(path)))) == {sha(k) for k in range(4)}


def test_nothing_at_all(spark, tmp_path):
    store = FingerprintStore(spark, str(tmp_path / "s"))
    assert ids(store.take(rows(spark, []), "a")) == [] and kept(store) == {}
    assert ids(store.take(rows(spark, [1]), "b")) == [1] and ids(store.take(rows(spark, []), "c")) == []


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_only_touched_buckets_are_read(spark, tmp_path):
    store = FingerprintStore(spark, str(tmp_path / "s"), n_buckets=32)
    store.take(rows(spark, range(500)), "a")
    few = materialise(rows(spark, [3, 1000]))
    plan = plan_of(store.unseen(few, "b"))
    buckets = {r.b for r in few.select(store._bucket(F.unhex("sha")).alias("b")).collect()}
    line = next(x for x in plan.splitlines() if "PartitionFilters" in x and "bucket" in x)
    assert len(buckets) <= 2 and all(str(b) in line for b in buckets) and "Subquery" in plan
    assert ids(store.unseen(few, "b")) == [1000]


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_a_bloom_filter_never_loses_a_key(spark, n):
    bits = B.bits_for(n)
    keys, others = materialise(rows(spark, range(n))), rows(spark, range(10**6, 10**6 + 2000))
    held = B.may_hold(B.bloom_filter(keys, "sha", bits), F.col("sha"), bits)
    assert keys.where(held).count() == n and others.where(held).count() < 300
    assert B.bits_for(B.MOST_BITS) is None


def test_batches_of_a_corpus_equal_one_run(spark, corpus, tmp_path):
    files = materialise(corpus.files.select("file_id", "repo_id", "content"))
    store = FingerprintStore(spark, str(tmp_path / "s"))
    found = {}
    for k, part in enumerate((files.where("file_id < 90"), files.where("file_id >= 90"))):
        for r in P.findings(D.detect(part), only_new=lambda firsts: store.take(firsts, str(k))).collect():
            found[r.file_id] = [s.sha for s in r.secrets]
    assert found == {r.file_id: [s.sha for s in r.secrets] for r in P.findings(D.detect(files)).collect()}
