"""Scoring and labelling of hydrated findings, row by row.

The score is a double, and its terms are added in a fixed order: some thresholds are
compared with the running sum, so the order is part of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift import wordlists as w
from keysift.catalog import jvm_pattern
from keysift.functions.bind import computed_once
from keysift.functions.text import sql_contains_any, sql_text
from keysift.functions.time import as_column, iso_text, whole_days


def _first_listed(words: Sequence[str], condition: str) -> str:
    """SQL for the first word of the list that meets the condition (with the word as {0}).

    List order decides, not the position of the word in the text.
    """
    return "CASE " + " ".join(f"WHEN {condition.format(sql_text(x))} THEN {sql_text(x)}" for x in words) + " END"


def _matches_any(text: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(f"{text} RLIKE {sql_text(p if p.startswith('(?') else jvm_pattern(p))}"
                             for p in patterns) + ")"


# Signals as SQL over the columns of a hydrated finding.  ``_name``, ``_owner`` and
# ``_path`` are lower-cased; key_volume is the number of listed keys or of private-key
# headers, whichever is more.
SIGNALS = {
    # First listed dump word in the repository name.
    "sig_dump_keyword": _first_listed(w.DUMP_KEYWORDS, "contains(_name, {0})"),
    # The latest author resembles the owner neither by name nor by e-mail.
    "sig_non_owner": """(coalesce(latest_commit_author_name, '') <> ''
        AND NOT contains(_owner, lower(latest_commit_author_name))
        AND coalesce(latest_commit_author_email, '') <> ''
        AND NOT contains(substring_index(lower(latest_commit_author_email), '@', 1), _owner))""",
    "sig_bulk": f"CASE WHEN key_volume >= {w.MASS_KEYS} THEN 'mass' WHEN key_volume >= {w.BULK_KEYS} THEN 'bulk' END",
    "sig_gist": """(contains(coalesce(repo_url, ''), '/gist.github.com/')
        OR startswith(coalesce(repo_name, ''), 'gist:'))""",
    "sig_username": _matches_any("coalesce(owner_login, '')", w.SUSPICIOUS_LOGINS),
    "sig_new_account": f"if(_age < {w.NEW_ACCOUNT_DAYS}, _age, null)",
    # How a path marks an ordinary project: personal .ssh, test material, or other.
    "sig_dev_path": f"""CASE WHEN NOT {_matches_any('_path', w.DEV_PATHS)} THEN null
        WHEN key_volume = 1 AND contains(_path, '.ssh') THEN 'ssh'
        WHEN {sql_contains_any('_path', ['test', 'fixture', 'example'])} THEN 'test' ELSE 'other' END""",
    "sig_topic": _first_listed(w.RESEARCH_TOPICS, "array_contains(repo_topics, {0})"),
}


def _term(condition: str, name: str) -> str:
    return f"if({condition}, {w.WEIGHTS[name]}D, 0D)"


_RUNNING = " ".join([
    "0D +", _term("sig_dump_keyword IS NOT NULL", "dump_keyword"), "+", _term("sig_non_owner", "non_owner"),
    f"+ CASE sig_bulk WHEN 'mass' THEN {w.WEIGHTS['mass']}D WHEN 'bulk' THEN {w.WEIGHTS['bulk']}D ELSE 0D END",
    "+", _term("sig_gist", "gist"), "+", _term("sig_username", "username"),
    "+", _term("sig_new_account IS NOT NULL", "new_account"),
    f"- CASE sig_dev_path WHEN 'ssh' THEN {w.WEIGHTS['ssh_single']}D WHEN 'test' THEN {w.WEIGHTS['test_path']}D "
    f"WHEN 'other' THEN {w.WEIGHTS['dev_path']}D ELSE 0D END"])

# The texts of the signals in scoring order; null where one did not fire.
_TEXTS = """array_compact(array(
    concat('repo name contains dump keyword \\'', sig_dump_keyword, '\\''),
    if(sig_non_owner, concat('commit author \\'', latest_commit_author_name, '\\' ≠ repo owner \\'',
                             coalesce(owner_login, ''), '\\''), null),
    CASE sig_bulk WHEN 'mass' THEN concat('mass key dump: ', key_volume, ' keys in file')
                  WHEN 'bulk' THEN concat('bulk keys: ', key_volume, ' keys in file') END,
    if(sig_gist, 'hosted as a GitHub Gist', null),
    if(sig_username, concat('suspicious username pattern: \\'', owner_login, '\\''), null),
    concat('account only ', sig_new_account, ' days old'),
    CASE sig_dev_path WHEN 'ssh' THEN 'single key in personal .ssh/ directory (likely accidental)'
        WHEN 'test' THEN concat('key in test/fixture/example folder: \\'', file_path, '\\'')
        WHEN 'other' THEN concat('file path matches normal dev pattern: \\'', file_path, '\\'') END,
    if(sig_pem, 'file has .pem extension (weak accidental signal)', null),
    concat('repo topic \\'', sig_topic, '\\' suggests research/CTF context')))"""


def with_signals(findings: DataFrame, as_of) -> DataFrame:
    """Add ``key_volume`` and one column per signal: ``sig_*``."""
    prepared = findings.withColumn("_age", whole_days(as_column(as_of), F.col("owner_created_at"))).selectExpr(
        "*", "greatest(key_count, pem_headers) AS key_volume", "lower(coalesce(repo_name, '')) AS _name",
        "lower(coalesce(owner_login, '')) AS _owner", "lower(coalesce(file_path, '')) AS _path")
    return computed_once(prepared, SIGNALS).drop("_age", "_name", "_owner")


def classify(findings: DataFrame, as_of) -> DataFrame:
    """Add ``sig_*``, ``confidence_score``, ``classification``, ``signals`` and ``commit_date``.

    ``findings`` is hydrated and has ``key_count`` and ``pem_headers``.
    """
    running = with_signals(findings, as_of).selectExpr("*", f"{_RUNNING} AS _running")
    pem = running.selectExpr("*", f"endswith(_path, '.pem') AND _running <= {w.PEM_SCORE_MAX}D AS sig_pem")
    total = f"_running - {_term('sig_pem', 'pem')} - {_term('sig_topic IS NOT NULL', 'topic')}"
    scored = computed_once(pem, {"confidence_score": f"round(greatest(0D, least(1D, {total})), 3)"})
    label = (f"CASE WHEN confidence_score >= {w.LEAKED_MIN}D THEN 'LEAKED' "
             f"WHEN confidence_score <= {w.ACCIDENTAL_MAX}D THEN 'ACCIDENTAL' ELSE 'UNCERTAIN' END")
    return (scored.selectExpr("*", f"{label} AS classification", f"{_TEXTS} AS signals").drop("_running", "_path")
            .withColumn("commit_date", F.coalesce(iso_text(F.col("latest_commit_date")), F.lit("unknown"))))


def summary_columns() -> list[Column]:
    label = F.col("classification")
    return [F.count("*").alias("total_findings"),
            F.count_if(label == "LEAKED").alias("leaked_count"),
            F.count_if(label == "ACCIDENTAL").alias("accidental_count"),
            F.count_if(label == "UNCERTAIN").alias("uncertain_count")]


def run_summary(classified: DataFrame) -> DataFrame:
    """Totals of one run.  Every fingerprint is new exactly once, so the new ones add up
    to the number of distinct fingerprints without a distinct count."""
    return classified.agg(*summary_columns(), F.coalesce(F.sum("n_new"), F.lit(0)).alias("unique_hashes"))
