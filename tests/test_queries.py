"""Every registered query against its SQL, on the smallest data set."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from keysift.plans.durable import materialise
from tests.compare import connect, differences
from tests.conftest import SF

# Nothing in the smallest data set qualifies; compared with results at the next scale.
EMPTY_AT_THIS_SCALE = {"batch_hours", "batch_evidence", "custom_rule_documents", "custom_rule_run", "stream_batch_alerts"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_missing_library_of_the_subpackage_leaves_the_rest():
    code = ("import sys, warnings; warnings.simplefilter('ignore'); sys.modules['ahocorasick'] = None; sys.modules['public_tokenizers'] = None\n"
            "import __spark_entry__ as e; assert set(e.queries()) == set(e._QUERIES) and e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_entry(spark):
    assert entry.entry(spark).count() == 95


# Run as registered, from the tables; the others start from findings computed once here.
FROM_SCRATCH = {"classified", "classified_nodedup", "run_summary", "trend_totals", "findings_by_search", "findings_in_scope",
                "custom_rule_run", "run_trends", "run_by_search_nodedup"}


@pytest.fixture(scope="module")
def labelled_once(spark):
    build, done = entry._found, {}

    def found(c, skip_duplicates=True):
        if skip_duplicates not in done:
            done[skip_duplicates] = materialise(build(c, skip_duplicates))
        return done[skip_duplicates]

    return found


@pytest.mark.parametrize("name", sorted(entry._QUERIES))
def test_query(spark, con, name, labelled_once, monkeypatch):
    if name not in FROM_SCRATCH:
        monkeypatch.setattr(entry, "_found", labelled_once)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, SF).count() >= 0
        return
    expected = "EMPTY" if name in EMPTY_AT_THIS_SCALE else ""
    assert differences(spark, con, entry.queries()[name], sql, SF) == expected
