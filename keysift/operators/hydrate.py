"""Adding repository, owner and latest-commit context to files or findings.

Every join is a left join: a missing repository, owner, commit, language or topic
never drops a row.  Detections are few compared with files, so a run hydrates its
findings, not its files.  The tables keyed by repository are joined with each other
first (one row per key on every side) and then meet the rows in a single join.  Hot
repositories and owners, and rows without one, are spread (``skew``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysift.functions.bloom import MOST_BITS, bits_for, bloom_filter, may_hold
from keysift.operators.skew import key_counts, spread_left_join
from keysift.plans.durable import materialise


def latest_commit(commits: DataFrame, order: Sequence[str] = ("ts",), keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """The newest commit per key; ``order`` lists the columns that decide, the last ones break ties.

    One aggregation with map-side partial results, so a busy repository is no hot spot.
    """
    fields = ["commit_sha", "author_name", "author_email", "ts"]
    rest = [f for f in fields if f not in order]
    newest = commits.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("c"))
    return newest.select(*keys, F.col("c.commit_sha").alias("latest_commit_sha"),
                         F.col("c.author_name").alias("latest_commit_author_name"),
                         F.col("c.author_email").alias("latest_commit_author_email"),
                         F.col("c.ts").alias("latest_commit_date"))


def latest_commit_as_of(rows: DataFrame, commits: DataFrame, at: str, order: Sequence[str] = ("ts",),
                        step: str = "DAY", counts: DataFrame | None = None) -> DataFrame:
    """The newest commit of a repository that is not later than a row's time ``at``, by repo_id and ``at``.

    No range join: commits and the distinct times asked for are one sequence per repository and ``step``, along which
    the last commit is carried; the last commit of every step is carried over the steps without any.  So a
    busy repository is as many groups as it has days, and its rows count once per distinct time.  Rows
    without repository or time have no commit, nor have those before the first one.  Commits of repositories
    that no row asks for stay where they are (``counts`` as for ``hydrate``); the others are dealt by step once.
    """
    commits = _mostly_of_repositories(commits, counts if counts is not None else repository_counts(rows))
    fields = ["commit_sha", "author_name", "author_email", "ts"]
    rest = [f for f in fields if f not in order]
    key, commit = ["repo_id", "_step"], F.struct(*order, *rest)
    made = commits.where("repo_id IS NOT NULL AND ts IS NOT NULL").select("repo_id", F.col("ts").alias("_t"), commit.alias("c"))
    asked = rows.where(F.col("repo_id").isNotNull() & F.col(at).isNotNull()).select("repo_id", F.col(at).alias("_t")).distinct()
    both = made.withColumn("_asks", F.lit(False)).unionByName(
        asked.withColumns({"c": F.lit(None).cast(made.schema["c"].dataType), "_asks": F.lit(True)}))
    both = both.withColumn("_step", F.date_trunc(step, "_t")).repartition(*key)

    # All columns are used, so both readers of the dealt rows share one shuffle.
    ends = both.groupBy(*key).agg(F.max("c").alias("last"), F.max(F.when(F.col("_asks"), F.col("_t"))).alias("asked"))
    earlier = W.partitionBy("repo_id").orderBy("_step").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*key, "asked", F.last("last", ignorenulls=True).over(earlier).alias("carried")).where(
        F.col("asked").isNotNull()).drop("asked")
    # Commits of the same moment come first, and of those the one that the order puts last stays.
    so_far = W.partitionBy(*key).orderBy("_t", "_asks", "c").rowsBetween(W.unboundedPreceding, W.currentRow)
    answered = both.withColumn("own", F.last("c", ignorenulls=True).over(so_far)).where("_asks")
    found = answered.join(carried, key, "left").select("repo_id", F.col("_t").alias(at), F.coalesce("own", "carried").alias("c"))
    return found.select("repo_id", at, F.col("c.commit_sha").alias("latest_commit_sha"),
                        F.col("c.author_name").alias("latest_commit_author_name"),
                        F.col("c.author_email").alias("latest_commit_author_email"), F.col("c.ts").alias("latest_commit_date"))


def language_map(languages: DataFrame, key: str = "repo_id") -> DataFrame:
    """name → bytes per repository.  Entries are merged by language first, so a list is
    never longer than the vocabulary of language names."""
    merged = languages.groupBy(key, "language").agg(F.sum("bytes").alias("bytes"))
    return merged.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("language", "bytes")))).alias("repo_languages"))


def topic_list(topics: DataFrame, key: str = "repo_id") -> DataFrame:
    return topics.groupBy(key).agg(F.array_sort(F.collect_set("topic")).alias("repo_topics"))


def repository_context(repos: DataFrame, latest: DataFrame | None = None, languages: DataFrame | None = None,
                       topics: DataFrame | None = None) -> DataFrame:
    """One row per repository with everything known by repository."""
    out = repos
    if latest is not None:
        out = out.join(latest, "repo_id", "left")
    out = (out.join(language_map(languages), "repo_id", "left") if languages is not None
           else out.withColumn("repo_languages", F.lit(None).cast("map<string,bigint>")))
    return (out.join(topic_list(topics), "repo_id", "left") if topics is not None
            else out.withColumn("repo_topics", F.lit(None).cast("array<string>")))


def repository_counts(rows: DataFrame) -> DataFrame:
    """(repo_id, n_rows) of the repositories that occur, written down because several tables are restricted to them."""
    return materialise(key_counts(rows, ["repo_id"]), name="repositories")


def _mostly_of_repositories(table: DataFrame, counts: DataFrame) -> DataFrame:
    """All rows of the counted repositories, and few others, by a Bloom filter in the scan."""
    n = counts.count()
    if n > MOST_BITS // 2:  # the filter would let half of the others through
        return table
    bits = bits_for(n) or MOST_BITS
    return table.where(may_hold(bloom_filter(counts, "repo_id", bits), F.col("repo_id"), bits))


def of_repositories(table: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of the counted repositories.  A Bloom filter turns most others away before the shuffle.  Both sides are
    shuffled as they are, so Spark can split a repository with very many rows."""
    return _mostly_of_repositories(table, counts).join(counts.select("repo_id"), "repo_id", "left_semi")


def hydrate(rows: DataFrame, repos: DataFrame, owners: DataFrame, latest: DataFrame,
            languages: DataFrame | None = None, topics: DataFrame | None = None,
            pushed_with_commit: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Add all context columns.  ``rows`` needs file_id, repo_id and file_path, and is read
    twice: for its repositories (unless their ``counts`` are given), and in full.  Context is made for these
    repositories alone; give ``latest`` of such commits too (``of_repositories``).

    ``latest`` comes from ``latest_commit``, keyed by repo_id or by repo_id and file_path, or from
    ``latest_commit_as_of``, keyed by repo_id and a time of the rows;
    a path without a commit has none.  Owners are joined last, on a key of their own.
    ``pushed_with_commit`` takes the date of the latest commit as the date of the last push
    where ``repos`` has no ``repo_pushed_at``; otherwise that is unknown.
    """
    keyed = [c for c in latest.columns if c in rows.columns and c != "repo_id"]
    in_repo = counts if counts is not None else repository_counts(rows)
    repos, languages, topics = (t if t is None else of_repositories(t, in_repo) for t in (repos, languages, topics))
    context = repository_context(repos, None if keyed else latest, languages, topics)
    of_owner = (in_repo.join(repos.select("repo_id", "owner_id"), "repo_id").dropna(subset=["owner_id"])
                .groupBy("owner_id").agg(F.sum("n_rows").alias("n_rows")))
    out = spread_left_join(rows, context, "repo_id", "file_id", in_repo)
    if keyed:
        out = spread_left_join(out, latest, ["repo_id", *keyed], "file_id", key_counts(rows, ["repo_id", *keyed]))
    out = spread_left_join(out, owners, "owner_id", "file_id", of_owner)
    pushed = F.col("latest_commit_date") if pushed_with_commit else F.lit(None).cast("timestamp")
    branch = F.coalesce(F.nullif("default_branch", F.lit("")), F.lit("main"))
    return (out.withColumns({
        "default_branch": branch,
        "repo_pushed_at": F.col("repo_pushed_at") if "repo_pushed_at" in out.columns else pushed,
        "repo_languages": F.expr("coalesce(repo_languages, cast(map() AS map<string,bigint>))"),
        "repo_topics": F.expr("coalesce(repo_topics, cast(array() AS array<string>))"),
        "file_url": F.concat("repo_url", F.lit("/blob/"), branch, F.lit("/"), F.col("file_path")),
        "raw_content_url": F.coalesce(
            F.col("raw_content_url") if "raw_content_url" in out.columns else F.lit(None).cast("string"), F.lit("")),
    }))
