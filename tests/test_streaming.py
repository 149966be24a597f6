from keysift.operators import detect as D
from keysift.operators import findings as P
from keysift.sources.fingerprints import FingerprintStore
from keysift.sources.tables import arriving_files
from keysift.streaming.arrivals import scan_arrivals
from tests.test_detect import POSITIVE

SCHEMA = "file_id long, repo_id long, file_path string, content string"


def found(spark, out):
    return {r.file_id: [s.sha for s in r.secrets] for r in spark.read.parquet(f"{out}/findings").collect()}


def test_arrivals_equal_one_batch_run(spark, corpus, tmp_path):
    files = corpus.files.select("file_id", "repo_id", "file_path", "content")
    land, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    for low, high in ((0, 70), (70, 140), (140, 200)):
        files.where(f"file_id >= {low} AND file_id < {high}").coalesce(1).write.mode("append").parquet(land)
        scan_arrivals(arriving_files(spark, land, SCHEMA), out, state).awaitTermination()
    expected = {r.file_id: [s.sha for s in r.secrets] for r in P.findings(D.detect(files)).collect()}
    assert found(spark, out) == expected
    assert FingerprintStore(spark, f"{out}/seen").fingerprints().count() == sum(map(len, expected.values()))


def test_a_repeated_batch_changes_nothing(spark, corpus, tmp_path):
    files = corpus.files.select("file_id", "repo_id", "file_path", "content")
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    files.coalesce(1).write.parquet(land)
    scan_arrivals(arriving_files(spark, land, SCHEMA), out, str(tmp_path / "s1")).awaitTermination()
    before = found(spark, out)
    # A lost stream state makes the same batch run again.
    scan_arrivals(arriving_files(spark, land, SCHEMA), out, str(tmp_path / "s2")).awaitTermination()
    assert found(spark, out) == before


def test_three_batches_scanned_again_after_a_lost_state(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    for i, text in enumerate((POSITIVE["NPM_TOKEN"], POSITIVE["GITLAB_TOKEN"], POSITIVE["STRIPE_SECRET_KEY"])):
        spark.createDataFrame([(i, 1, "p", text)], SCHEMA).coalesce(1).write.mode("append").parquet(land)
        scan_arrivals(arriving_files(spark, land, SCHEMA), out, str(tmp_path / "s1")).awaitTermination()
    assert len(found(spark, out)) == 3
    scan_arrivals(arriving_files(spark, land, SCHEMA), out, str(tmp_path / "s2")).awaitTermination()
    assert len(spark.read.parquet(f"{out}/findings").collect()) == 3
    assert FingerprintStore(spark, f"{out}/seen").fingerprints().count() == 3
