import random

import pytest
from pyspark.sql import functions as F

from keysift.operators import trends as T
from keysift.operators.trend_parts import Parts, write_part
from tests import hits


def leaked(spark, seed, n=120):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        owner = f"o{draw.randint(0, 12)}"
        rows.append(hits.hit(
            k, keys=draw.choice([1, 1, 2, 15, 120]), repo_name=f"{owner}/leak-{draw.choice(['dump', 'creds', 'x'])}-{draw.randint(0, 20)}",
            owner_login=owner, owner_created_at=hits.days_ago(draw.randint(1, 900)), owner_location=draw.choice([None, "", "Oslo"]),
            repo_pushed_at=draw.choice([None, hits.days_ago(draw.randint(0, 500))]), repo_language=draw.choice(["Python", "", None, "Go"]),
            repo_size_kb=draw.choice([10, 100, 900]), file_path=draw.choice(["a/passwords.txt", "x.env", None]),
            latest_commit_date=draw.choice([None, hits.days_ago(draw.randint(0, 6), draw.randint(0, 3))])))
    return hits.frame(spark, rows)


def same(a, b):
    assert {k: [tuple(r) for r in v.collect()] for k, v in a.items()} == {k: [tuple(r) for r in v.collect()] for k, v in b.items()}


@pytest.mark.parametrize("seed,cuts", [(1, [40, 80]), (2, [1, 119]), (3, [])])
def test_merged_parts_equal_one_report(spark, tmp_path, seed, cuts):
    found, path = leaked(spark, seed).cache(), str(tmp_path / "parts")
    edges = [0, *cuts, 120]
    for low, high in zip(edges, edges[1:]):
        write_part(found.where(f"file_id >= {low} AND file_id < {high}"), path, f"2024-{low:03d}")
    parts = Parts(spark, path)
    for as_of in (hits.AS_OF, "2024-09-01 00:00:00"):  # parts do not depend on the clock
        mine, want = parts.report(as_of), T.trend_report(found, as_of)
        profiles = [sorted(map(str, r.pop("account_profiles").drop("first").collect())) for r in (mine, want)]
        suspects = [sorted(map(str, r.pop("automation_suspects").drop("first").collect())) for r in (mine, want)]
        top = [[tuple(x) for x in r.pop("top_accounts").drop("first").collect()] for r in (mine, want)]
        assert profiles[0] == profiles[1] and suspects[0] == suspects[1] and top[0] == top[1]
        same(mine, want)


def test_a_repeated_batch_replaces_its_part_and_parts_fold(spark, tmp_path):
    found, path, folded = leaked(spark, 4), str(tmp_path / "parts"), str(tmp_path / "folded")
    write_part(found.where("file_id < 50"), path, "a")
    for _ in range(2):
        write_part(found.where("file_id >= 50"), path, "b")
    Parts(spark, path).write(folded, "all")
    want = T.totals(found, hits.AS_OF).first()
    assert Parts(spark, path).totals(hits.AS_OF).first() == want == Parts(spark, folded).totals(hits.AS_OF).first()
    only = Parts(spark, path, batches=["a"]).totals(hits.AS_OF).first()
    assert only == T.totals(found.where("file_id < 50"), hits.AS_OF).first() and only != want


def test_parts_of_nothing(spark, tmp_path):
    none, path = hits.frame(spark, [hits.hit()]).limit(0), str(tmp_path / "parts")
    write_part(none, path, "a")
    assert Parts(spark, path).totals(hits.AS_OF).first() == T.totals(none, hits.AS_OF).first()
    same({"x": Parts(spark, path).report(hits.AS_OF)["sophistication_tiers"]}, {"x": T.sophistication_tiers(none)})


def test_no_finding_and_no_address_is_kept(spark, tmp_path):
    path = str(tmp_path / "parts")
    write_part(leaked(spark, 5), path, "a")
    for name in ("labels", "accounts", "hours"):
        columns = spark.read.parquet(f"{path}/{name}").columns
        assert not {"latest_commit_author_email", "secrets", "file_path"} & set(columns)
    assert spark.read.parquet(f"{path}/hours").where(F.col("repo_url").contains("@")).count() == 0
