import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import corpus_pipeline as P
from keysift.llm import langid
from tests.compare import connect, differences
from tests.conftest import SF
from tests.llm.test_jaccard_regions import brute as near_groups
from tests.llm.test_packing import check as check_packing

OPERATORS = [f"op{n}_" for n in range(1, 14)]
# Names that the stages use for columns of their own, now or formerly.
CLASHING = ["kept_id", "KEY", "marked", "places", "changed", "__kept_id", "__key", "__found", "__masked", "doc", "found", "n_rows", "label"]
HEX = "0123456789abcdef" * 2


def test_every_operator_is_registered_once():
    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(n[:n.index("_") + 1] for n in names) == sorted(OPERATORS) and "pipeline" in entry.queries()
    assert [name for name, _ in P.STAGES] == ["language", "exact_dedup", "near_dedup", "secrets", "pack"]


@pytest.mark.parametrize("name", [q for q in entry.queries() if re.match(r"op\d+_", q)])
def test_query(spark, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql:
        assert differences(spark, connect(SF), query, sql, SF) == ""
    else:
        table = spark.read.parquet(f"{SF}/documents.parquet")
        assert query(spark, SF).select("doc_id").distinct().count() == table.count()


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"set": F.lit("x"), "__kept": F.lit(1), "content": F.lit(2)})
    table = table.withColumns({c: F.lit(c) for c in CLASHING})
    extra = [(9001, f"one two three token={HEX} four five six seven eight nine ten", "en", "src1", 10, "x", 1, 2),
             (9002, "12345 !!", "en", "src1", 8, "x", 1, 2), (9003, None, None, None, None, None, None, None), (9004, "", "en", None, 0, "x", 1, 2),
             (9005, "Ж" * 60, None, "src1", 60, "x", 1, 2)]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in table.schema])
    extra = [(*r, *CLASHING) for r in extra]
    return table.unionByName(spark.createDataFrame(extra, schema)).cache()


def test_stages_against_brute_force(spark, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    judged = {r.doc_id: r.rejected for r in langid.identify(docs, langid.fit(docs)).collect()}
    want, now = {i for i in rows if not judged[i]}, P.language(spark, docs, SF)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == want
    assert {9002, 9003, 9004, 9005}.isdisjoint(want) and 9001 in want

    best = {}
    for i in want:
        key = re.sub(r"[\x20\x09-\x0D]", "", rows[i].text)
        best[key] = min(best.get(key, (0, float("inf"))), (-len(rows[i].text), i))
    want, now = {i for _, i in best.values()}, P.exact_dedup(spark, now, SF)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == want

    want = {c for _, _, c, _ in near_groups([(i, rows[i].text) for i in sorted(want)], 80, 5)}
    now = P.near_dedup(spark, now, SF)
    assert now.columns == docs.columns and {r.doc_id for r in now.collect()} == want

    now = P.secrets(spark, now, SF).cache()
    masked = {r.doc_id: r for r in now.collect()}
    assert now.columns == docs.columns and set(masked) == want
    assert masked[9001].text == "one two three [SECRET] four five six seven eight nine ten" and masked[9001].n_chars == len(masked[9001].text)
    for i, r in masked.items():
        if r.text != rows[i].text:
            assert "[SECRET]" in r.text or "[EXAMPLE]" in r.text

    out = [r.asDict() for r in P.pack(spark, now, SF).collect()]
    check_packing([(i, r.text) for i, r in masked.items()], out, 8192, 65_536)


def test_stages_take_empty_tables(spark, docs):
    now = docs.limit(0)
    for _, stage in P.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_whole_run(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = P.run(spark, SF)
    assert 0 < out.select("doc_id").distinct().count() <= table.count()
