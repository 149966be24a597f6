"""Trend reports over findings that come batch by batch.

A batch leaves a *part*: sums and minima that merge with those of any other batch, in three tables that no
longer hold findings.

* ``labels``: per section and label how often it occurs and where first, as the report counts them; and what the
  scalars are made of: key counts (their histogram gives sum and median), effort scores, days of the last push.
* ``accounts``: the sums of each owner and its first finding.
* ``hours``: the distinct (hour of commit, repository) pairs, from which distinct repositories are exact.

Nothing in a part depends on the clock, so a report can be made of the same parts for any moment.  Merged
parts of any split of the findings give what all findings give at once; a batch that is repeated replaces its part.
Parts grow with distinct labels, owners, repositories and push times, not with findings; ``Parts.write`` folds many into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift import wordlists as w
from keysift.functions.text import contains_any
from keysift.functions.time import as_column
from keysift.operators import trends as T
from keysift.plans.durable import materialise

# Sections that only the scalars are made of; a label is a number, or a time in microseconds.
_FIGURES = {
    "=keys": lambda: F.col("key_count").cast("string"),
    "=score": lambda: T.sophistication_score().cast("string"),
    "=pushed": lambda: F.coalesce(F.unix_micros("repo_pushed_at").cast("string"), F.lit("never")),
    "=artifacts": lambda: contains_any(F.lower(F.coalesce("file_path", F.lit(""))), w.STEALER_ARTIFACTS).cast("string"),
}


def write_part(leaked: DataFrame, path: str, batch: str, order: Sequence[str] = T.ORDER) -> None:
    """Keep what the LEAKED findings of ``batch`` add to the report; ``leaked`` is read three times."""
    figures = F.array(*(F.struct(F.lit(k).alias("section"), label().alias("label")) for k, label in _FIGURES.items()))
    place = F.struct(*(F.col(c) for c in order), F.lit(0).alias("pos"))
    counted = leaked.select(place.alias("first"), F.explode(figures).alias("f")).groupBy("f.section", "f.label").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    named = T.fact_counts(leaked, *T.SECTIONS, order=order).select(
        "section", "label", "n", F.struct(*(F.col(f"first.{c}") for c in (*order, "pos"))).alias("first"))
    parts = {"labels": named.unionByName(counted), "accounts": T.account_sums(leaked, order),
             "hours": leaked.select(T.commit_hour(), "repo_url").distinct()}
    for name, frame in parts.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


class Parts:
    """The merged parts of all batches under ``path``, or of ``batches``."""

    def __init__(self, spark: SparkSession, path: str, batches: Sequence[str] | None = None, order: Sequence[str] = T.ORDER):
        def read(name: str) -> DataFrame:
            rows = spark.read.parquet(f"{path}/{name}")
            return (rows if batches is None else rows.where(F.col("batch").cast("string").isin(*batches))).drop("batch")

        self.order = order
        self.labels = materialise(read("labels").groupBy("section", "label").agg(F.sum("n").alias("n"), F.min("first").alias("first")),
                                  name="labels")
        self.accounts = read("accounts").groupBy("owner_login").agg(
            F.sum("repo_count").alias("repo_count"), F.sum("total_keys").alias("total_keys"), F.min("f").alias("f"),
            F.max("located").alias("located"))
        self.hours = read("hours").distinct()

    def write(self, path: str, batch: str) -> None:
        """The merged parts as one part of another folder."""
        for name in ("labels", "accounts", "hours"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")

    def _figure(self, section: str, value: Column) -> DataFrame:
        return self.labels.where(F.col("section") == section).select(value.alias("v"), "n")

    def totals(self, as_of) -> DataFrame:
        """The scalars as ``trends.totals`` gives them; every section of figures has a row per distinct value."""
        at, number = as_column(as_of), F.col("label").cast("long")
        keys = self._figure("=keys", number).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_leaked_findings"),
            F.coalesce(F.sum(F.col("v") * F.col("n")), F.lit(0)).alias("total_keys_observed"),
            F.coalesce(F.expr("percentile(v, 0.5, n)"), F.lit(0.0)).alias("median_keys_per_repo"))
        score = self._figure("=score", number).agg(
            F.coalesce(F.bround(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 2), F.lit(0.0)).alias("mean_sophistication_score"))
        artifacts = self._figure("=artifacts", F.col("label") == "true").agg(
            F.coalesce(F.sum(F.when(F.col("v"), F.col("n"))), F.lit(0)).alias("repos_with_stealer_artifacts"))
        pushed = self._figure("=pushed", F.timestamp_micros(F.when(F.col("label") != "never", number)))
        counted = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
        fresh = pushed.agg(counted(T.recent(F.col("v"), at, 30)).alias("active_last_30_days"),
                           counted(T.recent(F.col("v"), at, 90)).alias("active_last_90_days"),
                           counted(T.is_abandoned(F.col("v"), at)).alias("abandoned"))
        repos = self.hours.agg(F.count_distinct("repo_url").alias("total_unique_repos"))
        accounts = self.accounts.agg(F.count("owner_login").alias("total_unique_accounts"))
        # One row each.
        wide = keys
        for one in (score, artifacts, fresh, repos, accounts):
            wide = wide.crossJoin(F.broadcast(one))
        return wide.select(*T.TOTALS)

    def _named(self) -> DataFrame:
        return self.labels.where(~F.col("section").startswith("="))

    def report(self, as_of) -> dict[str, DataFrame]:
        """Every section, as ``trends.trend_report`` gives it."""
        return T.report_of(self._named(), materialise(self.totals(as_of), name="totals"),
                           materialise(T.profiles_of(self.accounts, as_of, self.order), name="accounts"),
                           materialise(T.busy_hours(self.hours), name="hours"))

    def long(self, as_of) -> DataFrame:
        """The whole report as (section, label, value), as ``trends.trend_long`` gives it."""
        return T.long_report(self._named(), self.totals(as_of), T.profiles_of(self.accounts, as_of, self.order), T.busy_hours(self.hours))
