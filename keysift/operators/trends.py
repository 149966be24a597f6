"""Trend analysis over LEAKED findings.

Most of a report are counts of some label per finding.  Each finding therefore emits
its labels as (section, label) facts; any set of sections is then one aggregation
with map-side partial counts, whatever the number of sections.  ``file_id`` (or the
columns in ``order``) gives the processing order that breaks ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysift import wordlists as w
from keysift.functions.literals import literal_table
from keysift.functions.text import contains_any, non_empty, sql_text
from keysift.functions.time import as_column, whole_days
from keysift.operators.skew import n_shares
from keysift.plans.durable import materialise

ORDER = ("file_id",)


def leaked(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("classification") == "LEAKED")


# ── Facts ────────────────────────────────────────────────────────────────────────────────

def _words_in(text: str, words: Sequence[str]) -> Column:
    listed = ", ".join(sql_text(x) for x in words)
    return F.expr(f"filter(array({listed}), x -> contains(lower(coalesce({text}, '')), x))")


def _name_tokens() -> Column:
    noise = ", ".join(sql_text(x) for x in w.NOISE_TOKENS)
    name = "coalesce(repo_name, '')"
    after_owner = f"if(contains({name}, '/'), substr({name}, instr({name}, '/') + 1), {name})"
    return F.expr(f"""filter(split(lower({after_owner}), '[^a-z0-9]+'),
                             x -> length(x) > 1 AND x NOT IN ({noise}))""")


def _one(label: Column) -> Column:
    return F.array(label)


def sophistication_score() -> Column:
    """0–10: language, number of languages, size, stars, description."""
    scores = F.create_map(*(F.lit(x) for pair in w.LANGUAGE_SCORES.items() for x in pair))
    n_languages = F.greatest(F.size("repo_languages"), F.lit(0))
    return F.least(F.lit(10), (
        F.coalesce(F.element_at(scores, F.coalesce("repo_language", F.lit(""))), F.lit(1))
        + F.when(n_languages >= 3, 2).when(n_languages >= 2, 1).otherwise(0)
        + F.when(F.col("repo_size_kb") > 500, 2).when(F.col("repo_size_kb") > 50, 1).otherwise(0)
        + F.when(F.col("repo_stargazers") >= 10, 1).otherwise(0)
        + F.when(non_empty(F.col("repo_description")), 1).otherwise(0)))


def _tier() -> Column:
    s = sophistication_score()
    return F.when(s <= 3, w.TIERS[0]).when(s <= 6, w.TIERS[1]).otherwise(w.TIERS[2])


def _volume() -> Column:
    k, names = F.col("key_count"), list(w.VOLUME_BUCKETS)
    return F.when(k == 1, names[0]).when(k < 10, names[1]).when(k < 100, names[2]).otherwise(names[3])


def _weekday() -> Column:
    return F.element_at(F.array(*(F.lit(d) for d in w.WEEKDAYS)), F.weekday("latest_commit_date") + 1)


def _language() -> Column:
    return F.when(non_empty(F.col("repo_language")), F.col("repo_language")).otherwise("Unknown")


_FACTS = {
    "keyword": lambda: _words_in("repo_name", w.TAXONOMY_KEYWORDS),
    "token": _name_tokens,
    "language": lambda: _one(_language()),
    "tier": lambda: _one(_tier()),
    "hour": lambda: F.array_compact(_one(F.date_format("latest_commit_date", "HH"))),
    "weekday": lambda: F.array_compact(_one(_weekday())),
    "volume": lambda: _one(_volume()),
    "artifact": lambda: _words_in("file_path", w.STEALER_ARTIFACTS),
}

SECTIONS = tuple(_FACTS)


def fact_counts(rows: DataFrame, *sections: str, order: Sequence[str] = ORDER) -> DataFrame:
    """(section, label, n, first): how often each label occurs and where it came first."""
    def facts_of(section: str) -> Column:
        return F.transform(_FACTS[section](), lambda x, i: F.struct(
            F.lit(section).alias("section"), x.alias("label"), i.alias("pos")))

    facts = F.flatten(F.array(*map(facts_of, sections)))
    emitted = rows.select(*order, F.explode_outer(facts).alias("f")).where("f IS NOT NULL")
    return emitted.groupBy("f.section", "f.label").agg(
        F.count("*").alias("n"), F.min(F.struct(*order, "f.pos")).alias("first"))


def _section(counts: DataFrame, section: str) -> DataFrame:
    return counts.where(F.col("section") == section)


def _ranked(counts: DataFrame, section: str, name: str, limit: int | None = None) -> DataFrame:
    """Labels by falling count, then by first appearance."""
    ordered = _section(counts, section).orderBy(F.desc("n"), "first")
    return (ordered.limit(limit) if limit else ordered).select(F.col("label").alias(name), "n")


def _filled(counts: DataFrame, section: str, labels: Sequence[str], name: str, n: str) -> DataFrame:
    """Counts for a fixed list of labels, zero where nothing was counted."""
    counts = _section(counts, section)
    slots = literal_table(counts.sparkSession, "pos, label", list(enumerate(labels)))
    return (slots.join(counts.select("label", "n"), "label", "left")
            .select("pos", F.col("label").alias(name), F.coalesce("n", F.lit(0)).alias(n)).orderBy("pos").drop("pos"))


# ── Totals ───────────────────────────────────────────────────────────────────────────────

def recent(pushed: Column, as_of: Column, days: int) -> Column:
    return pushed > as_of - F.expr(f"INTERVAL '{days}' DAY")


def is_abandoned(pushed: Column, as_of: Column) -> Column:
    return pushed.isNull() | (pushed < as_of - F.expr(f"INTERVAL '{w.ABANDONED_DAYS}' DAY"))


TOTALS = ("total_leaked_findings", "total_unique_repos", "total_unique_accounts", "total_keys_observed", "mean_sophistication_score",
          "median_keys_per_repo", "repos_with_stealer_artifacts", "active_last_30_days", "active_last_90_days", "abandoned")


def freshness(rows: DataFrame, as_of) -> DataFrame:
    at, pushed = as_column(as_of), F.col("repo_pushed_at")
    return rows.agg(F.count_if(recent(pushed, at, 30)).alias("active_last_30_days"),
                    F.count_if(recent(pushed, at, 90)).alias("active_last_90_days"),
                    F.count_if(is_abandoned(pushed, at)).alias("abandoned"))


def totals(rows: DataFrame, as_of) -> DataFrame:
    """All scalar figures of the report in one aggregation; zeros when nothing leaked.

    Counts are exact.  The median keeps one counter per distinct key count.  The mean is
    rounded half-even as decimals, which differs from rounding the binary value only
    where a mean lies on a tie.
    """
    at, pushed = as_column(as_of), F.col("repo_pushed_at")
    return rows.agg(
        F.count("*").alias("total_leaked_findings"),
        F.count_distinct("repo_url").alias("total_unique_repos"),
        F.count_distinct("owner_login").alias("total_unique_accounts"),
        F.coalesce(F.sum("key_count"), F.lit(0)).alias("total_keys_observed"),
        F.coalesce(F.bround(F.avg(sophistication_score()), 2), F.lit(0.0)).alias("mean_sophistication_score"),
        F.coalesce(F.median("key_count"), F.lit(0.0)).alias("median_keys_per_repo"),
        F.count_if(contains_any(F.lower(F.coalesce("file_path", F.lit(""))), w.STEALER_ARTIFACTS))
        .alias("repos_with_stealer_artifacts"),
        F.count_if(recent(pushed, at, 30)).alias("active_last_30_days"),
        F.count_if(recent(pushed, at, 90)).alias("active_last_90_days"),
        F.count_if(is_abandoned(pushed, at)).alias("abandoned"))


# ── Accounts ─────────────────────────────────────────────────────────────────────────────

def age_label(age: Column) -> Column:
    label = F.when(age.isNull(), "unknown")
    for limit, text in w.AGE_BANDS:
        label = label.when(age < limit, text)
    return label.otherwise("unknown")


def account_profiles(rows: DataFrame, as_of, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per owner; owner attributes come from the first finding.

    ``repo_count`` counts findings.  ``first`` keeps the order of first appearance.
    """
    return profiles_of(account_sums(rows, order), as_of, order)


def account_sums(rows: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Per owner what its profile needs and what adds up over batches: no figure depends on the clock."""
    attributes = ["owner_created_at", "owner_followers", "owner_public_repos", "owner_location"]
    return rows.groupBy("owner_login").agg(
        F.count("*").alias("repo_count"),
        F.sum("key_count").alias("total_keys"),
        F.min(F.struct(*order, *attributes)).alias("f"),
        F.max(non_empty(F.col("owner_location"))).alias("located"))


def profiles_of(grouped: DataFrame, as_of, order: Sequence[str] = ORDER) -> DataFrame:
    """Profiles from the sums per owner."""
    age = F.col("account_age_days")
    # The texts of the signals.
    signals = F.array_compact(F.array(
        F.when(F.col("repo_count") >= w.AUTO_FINDINGS_MIN,
               F.concat(F.col("repo_count").cast("string"), F.lit(" leak repos from one account"))),
        F.when(age <= w.AUTO_AGE_MAX, F.concat(F.lit("account only "), age.cast("string"), F.lit(" days old"))),
        F.when(F.col("total_keys") >= w.AUTO_KEYS_MIN,
               F.concat(F.col("total_keys").cast("string"), F.lit(" keys across repos")))))
    aged = grouped.withColumn("account_age_days", whole_days(as_column(as_of), F.col("f.owner_created_at")))
    return (aged.withColumn("automation_signals", signals)
            .select("owner_login", "repo_count", "total_keys", "account_age_days", age_label(age).alias("age_label"),
                    F.col("f.owner_followers").alias("followers"), F.col("f.owner_public_repos").alias("public_repos"),
                    F.when(F.col("located"), F.array("f.owner_location"))
                    .otherwise(F.array().cast("array<string>")).alias("locations"),
                    (F.size("automation_signals") >= 2).alias("is_suspected_automation"), "automation_signals",
                    F.struct(*(F.col(f"f.{c}") for c in order)).alias("first")))


def top_accounts(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.desc("total_keys"), "first").limit(w.TOP_ACCOUNTS)


def automation_suspects(profiles: DataFrame) -> DataFrame:
    return profiles.where("is_suspected_automation")


def account_age_bands(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("age_label").agg(F.count("*").alias("n_accounts"))


# ── Names, languages, effort ─────────────────────────────────────────────────────────────

def keyword_frequency(rows: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    return _ranked(fact_counts(rows, "keyword", order=order), "keyword", "keyword")


def top_name_tokens(rows: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    return _ranked(fact_counts(rows, "token", order=order), "token", "token", w.TOP_TOKENS)


def language_share(rows: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    return _share(fact_counts(rows, "language", order=order))


def _share(counts: DataFrame) -> DataFrame:
    """Percentages of one row per language name; every finding has exactly one language."""
    # The window spans already counted names, a short list, not findings.
    total = F.sum("n").over(W.partitionBy("section"))
    return (_section(counts, "language").withColumn("pct", F.bround(F.col("n") / total * 100, 1))
            .orderBy(F.desc("n"), "first").select(F.col("label").alias("language"), "n", "pct"))


def sophistication_scores(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", sophistication_score().alias("score"))


def sophistication_tiers(rows: DataFrame) -> DataFrame:
    """All three tiers, or no row at all when nothing leaked."""
    return _tiers(fact_counts(rows, "tier"))


def _tiers(counts: DataFrame) -> DataFrame:
    tiers = _filled(counts, "tier", w.TIERS, "tier", "n_findings")
    return (tiers.withColumn("_all", F.sum("n_findings").over(W.partitionBy(F.lit(1))))
            .where("_all > 0").drop("_all"))


# ── Time ─────────────────────────────────────────────────────────────────────────────────

HOURS = [f"{h:02d}" for h in range(24)]


def hour_heatmap(rows: DataFrame) -> DataFrame:
    return _filled(fact_counts(rows, "hour"), "hour", HOURS, "hour", "n_commits")


def weekday_heatmap(rows: DataFrame) -> DataFrame:
    return _filled(fact_counts(rows, "weekday"), "weekday", w.WEEKDAYS, "weekday", "n_commits")


def batch_hours(rows: DataFrame) -> DataFrame:
    """Distinct repositories per hour of commit, where there are enough to suspect a batch.

    The distinct count first groups by (hour, repository), so one busy hour is spread
    over all tasks.
    """
    return busy_hours(rows.select(commit_hour(), "repo_url"))


def commit_hour() -> Column:
    return F.date_format("latest_commit_date", "yyyy-MM-dd'T'HH").alias("hour")


def busy_hours(hours: DataFrame) -> DataFrame:
    """From (hour, repo_url) rows, repeated or not; rows without an hour are left out."""
    return (hours.where(F.col("hour").isNotNull()).groupBy("hour")
            .agg(F.count_distinct("repo_url").alias("n_repos")).where(F.col("n_repos") >= w.BATCH_REPOS_MIN))


def batch_evidence(hours: DataFrame) -> DataFrame:
    # Fixed value: the text of the evidence.
    text = F.concat("hour", F.lit("Z: "), F.col("n_repos").cast("string"), F.lit(" repos committed in same hour"))
    return hours.select(text.alias("evidence")).orderBy(F.desc("evidence")).limit(w.BATCH_EVIDENCE_MAX)


def batch_suspected(hours: DataFrame) -> DataFrame:
    return hours.agg((F.count("*") > 0).alias("batch_upload_suspected"))


def upload_sessions(rows: DataFrame, gap_minutes: int = 60) -> DataFrame:
    """Bursts of an account: commits of which each follows the one before within less than ``gap_minutes``.

    Unlike whole hours, sessions do not cut a burst at the full hour.  (owner_login, session_start, session_end,
    n_findings, n_repos): first and last commit, findings, distinct repositories; rows without owner or date are left
    out.  Times of an account that fall into one step as long as the gap belong together, so each step is reduced to
    its first and last time before the shuffle, and an account with a third of all rows is a row per step and task.
    """
    step = F.floor(F.unix_micros("latest_commit_date") / F.lit(gap_minutes * 60_000_000)).alias("step")
    timed = rows.where(F.col("latest_commit_date").isNotNull() & F.col("owner_login").isNotNull()).select(
        "owner_login", step, F.col("latest_commit_date").alias("t"), "repo_url")
    steps = timed.groupBy("owner_login", "step").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count(F.lit(1)).alias("n"))
    by_time = W.partitionBy("owner_login").orderBy("step")
    far = F.unix_micros("low") - F.unix_micros(F.lag("high").over(by_time)) >= gap_minutes * 60_000_000
    dealt = steps.withColumn("new", F.when(F.coalesce(far, F.lit(True)), 1).otherwise(0)).withColumn(
        "session", F.sum("new").over(by_time))
    spans = dealt.groupBy("owner_login", "session").agg(
        F.min("low").alias("session_start"), F.max("high").alias("session_end"), F.sum("n").alias("n_findings"))
    repos = timed.select("owner_login", "step", "repo_url").distinct().join(
        dealt.select("owner_login", "step", "session"), ["owner_login", "step"]).groupBy("owner_login", "session").agg(
        F.count_distinct("repo_url").alias("n_repos"))
    return spans.join(repos, ["owner_login", "session"]).drop("session")


def upload_bursts(sessions: DataFrame) -> DataFrame:
    """Sessions with enough repositories to suspect a batch."""
    return sessions.where(F.col("n_repos") >= w.BATCH_REPOS_MIN)


# ── Volume and artifacts ─────────────────────────────────────────────────────────────────

def volume_buckets(rows: DataFrame) -> DataFrame:
    """Findings per key-count bucket with the report's reading of each bucket."""
    return _volumes(fact_counts(rows, "volume"))


def _volumes(counts: DataFrame) -> DataFrame:
    counted = _filled(counts, "volume", list(w.VOLUME_BUCKETS), "bucket", "n_findings")
    reading = F.create_map(*(F.lit(x) for pair in w.VOLUME_BUCKETS.items() for x in pair))
    return counted.withColumn("interpretation", F.element_at(reading, F.col("bucket")))


def artifact_frequency(rows: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    return _ranked(fact_counts(rows, "artifact", order=order), "artifact", "artifact", w.TOP_ARTIFACTS)


# ── The whole report ─────────────────────────────────────────────────────────────────────

def trend_report(rows: DataFrame, as_of, order: Sequence[str] = ORDER) -> dict[str, DataFrame]:
    """Every section of the report in four passes over ``rows``, the LEAKED findings.

    The labels of all sections are counted together; that table and those of scalars,
    accounts and hours are written down, and the sections are read from them.
    """
    return report_of(materialise(fact_counts(rows, *_FACTS, order=order), name="label-counts"),
                     materialise(totals(rows, as_of), name="totals"),
                     materialise(account_profiles(rows, as_of, order), name="accounts"),
                     materialise(batch_hours(rows), name="hours"))


def report_of(counts: DataFrame, scalars: DataFrame, profiles: DataFrame, hours: DataFrame) -> dict[str, DataFrame]:
    """The sections from label counts, scalars, profiles and busy hours."""
    return {
        "totals": scalars,
        "freshness": scalars.select("active_last_30_days", "active_last_90_days", "abandoned"),
        "account_profiles": profiles, "top_accounts": top_accounts(profiles),
        "automation_suspects": automation_suspects(profiles),
        "keyword_frequency": _ranked(counts, "keyword", "keyword"),
        "top_name_tokens": _ranked(counts, "token", "token", w.TOP_TOKENS),
        "language_share": _share(counts), "sophistication_tiers": _tiers(counts),
        "hour_heatmap": _filled(counts, "hour", HOURS, "hour", "n_commits"),
        "weekday_heatmap": _filled(counts, "weekday", w.WEEKDAYS, "weekday", "n_commits"),
        "batch_evidence": batch_evidence(hours), "batch_suspected": batch_suspected(hours),
        "volume_buckets": _volumes(counts),
        "artifact_frequency": _ranked(counts, "artifact", "artifact", w.TOP_ARTIFACTS),
    }


def trend_long(rows: DataFrame, as_of, order: Sequence[str] = ORDER) -> DataFrame:
    """The whole report as (section, label, value): four passes over ``rows`` in all.

    Label counts come from one aggregation; fixed labels are filled with zeros.
    """
    return long_report(fact_counts(rows, *_FACTS, order=order), totals(rows, as_of), account_profiles(rows, as_of, order),
                       batch_hours(rows))


def long_report(counts: DataFrame, scalars: DataFrame, profiles: DataFrame, hours: DataFrame) -> DataFrame:
    """``trend_long`` from label counts, scalars, profiles and busy hours."""
    fixed = {"tier": w.TIERS, "hour": HOURS, "weekday": w.WEEKDAYS, "volume": list(w.VOLUME_BUCKETS)}
    slots = literal_table(counts.sparkSession, "section, label", [(k, x) for k, xs in fixed.items() for x in xs])
    counted = _top_labels(counts, {"token": w.TOP_TOKENS, "artifact": w.TOP_ARTIFACTS})
    labelled = counted.join(slots, ["section", "label"], "full_outer")
    labelled = (labelled.withColumn("_all", F.sum("n").over(W.partitionBy("section")))
                .where("section <> 'tier' OR _all > 0")
                .select("section", "label", F.coalesce("n", F.lit(0)).cast("string").alias("value")))
    wide = scalars.select(F.explode(F.array(*(
        F.struct(F.lit("totals").alias("section"), F.lit(c).alias("label"), F.col(c).cast("string").alias("value"))
        for c in scalars.columns))).alias("r")).select("r.*")
    evidence = batch_evidence(hours).select(
        F.lit("batch_evidence").alias("section"), F.col("evidence").alias("label"), F.lit("").alias("value"))
    top = top_accounts(profiles).select(F.lit("top_account").alias("section"), F.col("owner_login").alias("label"),
                                        F.col("total_keys").cast("string").alias("value"))
    suspects = automation_suspects(profiles).select(
        F.lit("automation_suspect").alias("section"), F.col("owner_login").alias("label"),
        F.array_join("automation_signals", "; ").alias("value"))
    return wide.unionByName(labelled).unionByName(evidence).unionByName(top).unionByName(suspects)


def _top_labels(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Cut some sections to their top labels.

    Name tokens may be very many, so hash buckets are cut first, a few for each task,
    and then the rest; both limits are constants, so Spark cuts before it shuffles.
    """
    order, most = [F.desc("n"), F.asc("first")], max(limits.values())
    limited, others = counts.where(F.col("section").isin(*limits)), counts.where(~F.col("section").isin(*limits))
    bucket = F.pmod(F.xxhash64("label"), F.lit(n_shares(counts)))
    cut = (limited.withColumn("_b", bucket)
           .withColumn("_r", F.row_number().over(W.partitionBy("section", "_b").orderBy(*order))).where(F.col("_r") <= most))
    ranked = cut.withColumn("_r", F.row_number().over(W.partitionBy("section").orderBy(*order))).where(F.col("_r") <= most)
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("section"))
    return ranked.where(F.col("_r") <= limit).select("section", "label", "n").unionByName(others.select("section", "label", "n"))
