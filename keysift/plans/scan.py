"""A whole run: files → detections → findings → labels → reports.

Shape of the job.  The content column is read once, in one narrow stage, and is gone
after it.  Detections (fingerprint, sample, file columns) shuffle by fingerprint with
partial aggregation, the survivors shuffle by file, and only those are joined with
repositories, owners and commits.  Text never shuffles and never reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.catalog import Rule
from keysift.operators import classify as C
from keysift.operators import trends as T
from keysift.operators.detect import detect, with_secrets
from keysift.operators.findings import findings
from keysift.operators.hydrate import hydrate, latest_commit, of_repositories, repository_counts
from keysift.operators.reports import disclosure_targets, finding_records, findings_metadata
from keysift.operators.scope import restrict
from keysift.plans.durable import materialise
from keysift.sources.fingerprints import FingerprintStore
from keysift.sources.tables import run_stamp, write_disclosure_csv, write_findings_json, write_trends


@dataclass(frozen=True)
class Inputs:
    """The tables of a run.  ``commit_order`` lists the columns that order commits."""

    files: DataFrame
    repos: DataFrame
    owners: DataFrame
    commits: DataFrame
    languages: DataFrame | None = None
    topics: DataFrame | None = None
    commit_order: Sequence[str] = ("ts",)
    #: Columns of ``commits`` that name what a commit belongs to: a repository, or a file path in it.
    commit_keys: Sequence[str] = ("repo_id",)
    #: Whether a repository without ``repo_pushed_at`` counts as pushed with its latest commit.
    pushed_with_commit: bool = False


def detected_files(inputs: Inputs, scopes: DataFrame | None = None, visits: DataFrame | None = None,
                   rules: Sequence[Rule] | None = None) -> DataFrame:
    """Files in which something was found, within ``scopes`` and ``visits`` when given.

    Both restrict detections, not texts: the join moves fingerprints and samples, and
    the text stays in its scan whatever the size of either list.
    """
    files = inputs.files.where(F.col("content").isNotNull())
    detected = with_secrets(detect(files, rules=rules))
    if scopes is not None:
        # Read twice, for its repositories and in full; the text is scanned once.
        detected = restrict(materialise(detected, name="detected"), scopes, inputs.repos, inputs.owners)
    if visits is not None:
        detected = detected.join(visits.select("file_id").distinct(), "file_id", "left_semi")
    return detected


def classified_findings(inputs: Inputs, as_of, skip_duplicates: bool = True, scopes: DataFrame | None = None,
                        visits: DataFrame | None = None, rules: Sequence[Rule] | None = None,
                        store: FingerprintStore | None = None, batch: str = "") -> DataFrame:
    """Labelled findings with all context columns.

    Findings are written down before they meet their context: they are few, and their
    repositories are counted to spread the hot ones.  With a ``store`` fingerprints of
    other batches are not new, and those of this ``batch`` are added to it.
    """
    if visits is not None:
        # Finding the visits reads the text once; they are used several times.
        visits = materialise(visits, name="visits")
    detected = detected_files(inputs, scopes, visits, rules)
    if not skip_duplicates:
        detected = materialise(detected, name="detected")
    only_new = None if store is None else lambda firsts: store.take(firsts, batch)
    found = materialise(findings(detected, skip_duplicates, visits, only_new), name="findings")
    counts = repository_counts(found)
    latest = latest_commit(of_repositories(inputs.commits, counts), inputs.commit_order, inputs.commit_keys)
    context = hydrate(found, inputs.repos, inputs.owners, latest, inputs.languages, inputs.topics, inputs.pushed_with_commit, counts)
    return C.classify(context, as_of)


@dataclass(frozen=True)
class RunResult:
    findings: DataFrame
    summary: DataFrame
    trends: dict[str, DataFrame]
    paths: dict[str, object]


def run(inputs: Inputs, as_of, out_dir: str, skip_duplicates: bool = True, scopes: DataFrame | None = None,
        visits: DataFrame | None = None, rules: Sequence[Rule] | None = None, with_email: bool = False,
        store: FingerprintStore | None = None, batch: str = "") -> RunResult:
    """Scan, label, analyse and write the findings, the disclosure list and the trend tables.

    A scheduled scan passes the ``store`` of its earlier runs and a ``batch`` label of its
    own; run again under that label it gives the same findings.  The labelled findings are kept in ``out_dir`` as a table of their own.  With
    ``visits`` the order of processing is that of the searches, then of the files.
    """
    stamp = run_stamp()
    found = materialise(classified_findings(inputs, as_of, skip_duplicates, scopes, visits, rules, store, batch),
                        f"{out_dir}/labelled_{stamp}")
    order = T.ORDER if visits is None else ("query_ord", *T.ORDER)
    sections = T.trend_report(T.leaked(found), as_of, order)
    paths = dict(write_findings_json(finding_records(found, rules, with_email),
                                     findings_metadata(found, stamp, rules), out_dir, stamp))
    paths["disclosure"] = write_disclosure_csv(disclosure_targets(found, rules), out_dir, stamp)
    paths["trends"] = write_trends(sections, out_dir, stamp)
    return RunResult(found, C.run_summary(found), sections, paths)
