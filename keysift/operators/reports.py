"""The tables behind the findings file and the disclosure list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.catalog import CATEGORIES, RULES, Rule
from keysift.functions.text import sql_text
from keysift.functions.time import iso_text
from keysift.operators.classify import summary_columns
from keysift.operators.detect import rule_field


def secrets_by_category(findings: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Listed secrets per category over all findings.

    One row per listed secret reaches the aggregation, which counts them before its
    shuffle; the result has a row per category.
    """
    category = F.expr(f"transform(secrets, s -> {rule_field('s.ord', 'category', rules)})")
    return (findings.select(F.explode_outer(category).alias("category")).where("category IS NOT NULL")
            .groupBy("category").agg(F.count("*").alias("n_secrets")))


def described_secrets(rules: Sequence[Rule] | None = None) -> Column:
    """The nested list of a finding's secrets as reported (never the value itself)."""
    fields = ", ".join(f"'{f}', {rule_field('s.ord', f, rules)}"
                       for f in ("secret_id", "category", "label", "confidence"))
    return F.expr(f"transform(secrets, s -> named_struct({fields}, "
                  "'redacted_sample', s.sample, 'sha256_fingerprint', s.sha))")


def finding_records(classified: DataFrame, rules: Sequence[Rule] | None = None,
                    with_email: bool = False) -> DataFrame:
    """One nested record per finding.  E-mail addresses only on request."""
    email = [F.col("latest_commit_author_email").alias("author_email")] if with_email else []
    return classified.select(
        "file_id", "classification", "confidence_score", "signals", "repo_url", "file_path",
        F.col("latest_commit_sha").alias("commit_sha"), F.col("latest_commit_author_name").alias("author_name"),
        *email, "commit_date", F.col("key_count").alias("secret_count"),
        described_secrets(rules).alias("secrets"), "owner_login", "owner_type", "repo_language", "repo_topics",
        iso_text(F.col("repo_created_at")).alias("repo_created_at"))


def findings_metadata(classified: DataFrame, generated_at: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row: when, totals per class, secrets per category (a map of the categories that occur).

    Each finding counts its own secrets per category, so one aggregation does it all.
    """
    category = rule_field("s.ord", "category", rules)
    names = list(dict.fromkeys([*CATEGORIES, *(r.category for r in rules or RULES)]))
    sums = {c: F.coalesce(F.sum(F.expr(f"size(filter(secrets, s -> {category} = {sql_text(c)}))")), F.lit(0))
            for c in names}
    by_category = F.create_map(*(x for c in names for x in (F.lit(c), F.col(f"_{c}"))))
    return classified.agg(*summary_columns(), *(n.alias(f"_{c}") for c, n in sums.items())).select(
        F.lit(generated_at).alias("generated_at"), "total_findings", "leaked_count", "accidental_count",
        "uncertain_count", F.map_filter(by_category, lambda _, n: n > 0).alias("secrets_by_category"))


def disclosure_targets(classified: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Developers to notify: findings that are not LEAKED and have an author e-mail."""
    email = F.col("latest_commit_author_email")
    chosen = classified.where(F.col("classification").isin("ACCIDENTAL", "UNCERTAIN") & (email != ""))

    def field(name: str) -> Column:
        return F.expr(f"transform(secrets, s -> {rule_field('s.ord', name, rules)})")

    return chosen.select(
        email.alias("author_email"),
        F.coalesce("latest_commit_author_name", F.lit("")).alias("author_name"), "repo_url", "file_path",
        F.coalesce("latest_commit_sha", F.lit("")).alias("commit_sha"), "commit_date", "classification",
        F.array_join(field("secret_id"), ";").alias("secret_types"),
        F.array_join(F.array_sort(F.array_distinct(field("category"))), ";").alias("secret_categories"),
        F.col("key_count").alias("secret_count"),
        F.array_join(F.transform("secrets", lambda s: s["sha"]), ";").alias("secret_sha256_fingerprints"))
