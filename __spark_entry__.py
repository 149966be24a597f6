"""

Every query reads the supplied tables through ``Corpus`` and runs over all their rows
and whole texts.  Results that a query uses several times are written down while it is
built; nested results come as text so that both engines can be compared value by value.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.catalog import RULES, Rule
from keysift.functions.time import iso_text
from keysift.operators import candidates, hydrate, listing, reports, scope
from keysift.operators import classify as C
from keysift.operators import detect as D
from keysift.operators import findings as P
from keysift.operators import trends as T
from keysift.operators.exposure import exposure_rates
from keysift.operators.rule_join import rule_matches
from keysift.operators.scrub import scrub
from keysift.operators.trend_parts import Parts, write_part
from keysift.plans.durable import materialise, scratch_dir
from keysift.plans.scan import Inputs, classified_findings, run
from keysift.sources.corpus import AS_OF, COMMIT_ORDER, Corpus, files_of
from keysift.sources.fingerprints import FingerprintStore
from keysift.sources.phrase_index import build_phrase_index
from keysift.sources.tables import arriving_files
from keysift.streaming.alerts import batch_alerts, first_seen_events, write_events
from keysift.streaming.arrivals import scan_arrivals
from oracle.queries_sql import ORACLE

try:  # the operators on training data and their pipeline come in a subpackage that may be absent, or lack a library
    from keysift.llm import queries as llm_queries
except ImportError as missing:
    warnings.warn(f"without the operators on training data: {missing}", stacklevel=1)
    llm_queries = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"

# A rule of the user's own, for text the built-in rules do not cover.
QUOTED_TOKEN = Rule("QUOTED_HEX_TOKEN", "api_key", "Quoted hex token", "low", r'token = "([a-f0-9]{40})"', "", 40, 40,
                    '"token"', whole=False, needs=(("ken = \"",),), anchors=('token = "',))


def entry(spark: SparkSession) -> DataFrame:
    """Labelled findings of the smallest data set."""
    return _classified(Corpus(spark, FLAGSHIP_DIR))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: _on_corpus(build) for name, build in _QUERIES.items()}
    return own | (llm_queries.queries() if llm_queries else {})


def oracle_sql() -> dict[str, str]:
    return ORACLE | (llm_queries.oracle_sql() if llm_queries else {})


def _on_corpus(build: Callable[[Corpus], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Corpus(spark, sf_dir))


# ── Building blocks ──────────────────────────────────────────────────────────────────────

def _inputs(c: Corpus) -> Inputs:
    return Inputs(c.files, c.repos, c.owners, c.commits, c.languages, c.topics, COMMIT_ORDER, pushed_with_commit=True)


def _found(c: Corpus, skip_duplicates: bool = True) -> DataFrame:
    return classified_findings(_inputs(c), AS_OF, skip_duplicates)


def _leaked(c: Corpus) -> DataFrame:
    return T.leaked(_found(c))


def _classified(c: Corpus, skip_duplicates: bool = True) -> DataFrame:
    return _found(c, skip_duplicates).select(
        "file_id", "repo_name", "owner_login", "file_path", "key_count", "key_volume", "confidence_score",
        "classification")


def _signals(c: Corpus, *columns: str) -> DataFrame:
    return _found(c).select("file_id", *columns)


def _joined(column: str) -> F.Column:
    return F.array_join(column, " | ").alias(column)


def _shas() -> F.Column:
    return F.expr("array_join(transform(secrets, s -> s.sha), ';')").alias("fingerprints")


# ── Sources, scope, search ───────────────────────────────────────────────────────────────

def _scan_content_present(c: Corpus) -> DataFrame:
    return c.files.where(F.col("content").isNotNull()).groupBy("lang", "source").agg(
        F.count("*").alias("n_files"), F.sum(F.length("content")).alias("n_chars"))


def _rules_listing(c: Corpus) -> DataFrame:
    return listing.rules_listing(c.files.sparkSession, D.detections(c.files)).select(
        "category_ord", "category_label", "ord", "secret_id", "label", "confidence", "search_query", "n_detections")


def _query_list(c: Corpus) -> DataFrame:
    parsed = scope.parse_targets(c.targets).where("scope_type <> 'invalid'")
    return listing.query_list(parsed.withColumnRenamed("target_id", "request_id"))


def _targets_parsed(c: Corpus) -> DataFrame:
    return scope.parse_targets(c.targets).select(
        "target_id", "raw_input", "scope_type", "name", "search_qualifier", "display_label", "error")


def _resolved(c: Corpus) -> DataFrame:
    return scope.resolve_targets(scope.parse_targets(c.targets), c.owners, c.repos)


def _targets_resolved(c: Corpus) -> DataFrame:
    return _resolved(c).select(
        "target_id", "scope_type", "name", "search_qualifier", "display_label", "error", "verified")


def _scope_semi_join(c: Corpus) -> DataFrame:
    # Some of the supplied targets are global; without those the others restrict.
    scopes = materialise(_resolved(c).where("scope_type <> 'global'"), name="scopes")
    return scope.restrict(c.files.select("file_id", "repo_id", "file_path"), scopes, c.repos, c.owners)


def _scope_global(c: Corpus) -> DataFrame:
    scopes = materialise(_resolved(c), name="scopes")
    return scope.restrict(c.files.select("file_id", "repo_id", "file_path"), scopes, c.repos, c.owners)


def _findings_in_scope(c: Corpus) -> DataFrame:
    scopes = materialise(_resolved(c).where("scope_type <> 'global'"), name="scopes")
    found = classified_findings(_inputs(c), AS_OF, scopes=scopes)
    return found.select("file_id", "repo_name", "key_count", _shas(), "classification")


def _candidate_files(c: Corpus) -> DataFrame:
    return candidates.candidate_visits(c.files)


def _candidate_capped(c: Corpus) -> DataFrame:
    return candidates.cap_visits(candidates.candidate_visits(c.files), max_results=20)


def _indexed_search(c: Corpus) -> DataFrame:
    """All searches through an index made of the same files."""
    return build_phrase_index(c.files, scratch_dir(c.files.sparkSession, "phrases")).search()


def _rule_table_matches(c: Corpus) -> DataFrame:
    """A table of rules, the built-in searches and one for every 40 characters of a benchmark item, with its files."""
    built_in = c.files.sparkSession.createDataFrame(
        [(rule.secret_id, rule.phrases) for _, rule in candidates.requested_searches(("ALL",))], "rule_id string, phrases array<string>")
    at = F.explode(F.sequence(F.lit(0), F.floor(F.char_length("text") / 40).cast("int") - 1))
    slices = c.table("benchmark").where("char_length(text) >= 40").select("item_id", "text", at.alias("i"))
    passages = slices.select(F.concat_ws("/", "item_id", "i").alias("rule_id"), F.expr(
        "array(substr(text, i * 40 + 1, 20), substr(text, i * 40 + 21, 20))").alias("phrases"))
    matches = rule_matches(c.files, built_in.union(passages))
    return matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_files"), F.min("file_id").alias("first_file"))


def _findings_by_search(c: Corpus) -> DataFrame:
    found = classified_findings(_inputs(c), AS_OF, visits=candidates.candidate_visits(c.files))
    return found.select("file_id", "query_ord", "key_count", _shas(), "classification")


def _run_by_search_nodedup(c: Corpus) -> DataFrame:
    scopes = materialise(_resolved(c).where("scope_type <> 'global'"), name="scopes")
    result = run(_inputs(c), AS_OF, scratch_dir(c.files.sparkSession, "run"), skip_duplicates=False, scopes=scopes,
                 visits=candidates.candidate_visits(c.files))
    return result.findings.select("file_id", "query_ord", "key_count", "n_new", _shas(), "classification")


def _run_trends(c: Corpus) -> DataFrame:
    """Every trend table of a run in search order, as (section, place, values)."""
    result = run(_inputs(c), AS_OF, scratch_dir(c.files.sparkSession, "run"), visits=candidates.candidate_visits(c.files))
    picked = {"totals": ["total_leaked_findings", "total_unique_repos", "total_unique_accounts", "total_keys_observed"],
              "freshness": ["active_last_30_days", "active_last_90_days", "abandoned"],
              "top_accounts": ["owner_login", "repo_count", "total_keys"], "keyword_frequency": ["keyword", "n"],
              "language_share": ["language", "n"], "sophistication_tiers": ["tier", "n_findings"],
              "hour_heatmap": ["hour", "n_commits"], "weekday_heatmap": ["weekday", "n_commits"],
              "volume_buckets": ["bucket", "n_findings"], "artifact_frequency": ["artifact", "n"],
              "top_name_tokens": ["token", "n"]}
    return reduce(DataFrame.unionByName, (
        result.trends[name].select(F.lit(name).alias("section"), F.concat_ws(",", *columns).alias("row"))
        for name, columns in picked.items()))


# ── Hydration ────────────────────────────────────────────────────────────────────────────

def _hydrate_hits(c: Corpus) -> DataFrame:
    return _hits(c, hydrate.latest_commit(c.commits, COMMIT_ORDER))


def _hydrate_hits_by_path(c: Corpus) -> DataFrame:
    return _hits(c, hydrate.latest_commit(c.commits, COMMIT_ORDER, ["repo_id", "file_path"]))


def _hydrate_hits_as_of(c: Corpus) -> DataFrame:
    """Files as they were seen, at moments spread over ten years, with the commit that was the latest then."""
    seen = c.files.select("file_id", "repo_id", "file_path", F.expr(
        f"TIMESTAMP '{AS_OF}' - make_dt_interval(int(file_id * 41 % 3600), 0, int(file_id % 1440))").alias("seen_at"))
    counts = hydrate.repository_counts(seen)
    latest = hydrate.latest_commit_as_of(seen, c.commits, "seen_at", COMMIT_ORDER, counts=counts)
    hits = hydrate.hydrate(seen, c.repos, c.owners, latest, c.languages, c.topics, counts=counts)
    return hits.select("file_id", "repo_name", "owner_login", iso_text(F.col("seen_at")).alias("seen_at"), "latest_commit_sha",
                       "latest_commit_author_name", "latest_commit_author_email",
                       iso_text(F.col("latest_commit_date")).alias("latest_commit_date"))


def _hits(c: Corpus, latest: DataFrame) -> DataFrame:
    hits = hydrate.hydrate(c.files.drop("content"), c.repos, c.owners, latest, c.languages, c.topics,
                           pushed_with_commit=True)
    return hits.select(
        "file_id", "repo_name", "repo_url", "repo_description", "file_path", "default_branch", "raw_content_url",
        iso_text(F.col("repo_created_at")).alias("repo_created_at"),
        iso_text(F.col("repo_pushed_at")).alias("repo_pushed_at"), "repo_language",
        F.size("repo_languages").alias("n_languages"), _joined("repo_topics"), "repo_stargazers", "repo_size_kb",
        "owner_login", "owner_type", iso_text(F.col("owner_created_at")).alias("owner_created_at"),
        "owner_public_repos", "owner_followers", "owner_following", "owner_bio", "owner_location", "file_url",
        "latest_commit_sha", "latest_commit_author_name", "latest_commit_author_email",
        iso_text(F.col("latest_commit_date")).alias("latest_commit_date"))


def _latest_commit(c: Corpus) -> DataFrame:
    latest = hydrate.latest_commit(c.commits, COMMIT_ORDER)
    return latest.withColumn("latest_commit_date", iso_text(F.col("latest_commit_date")))


def _latest_commit_by_path(c: Corpus) -> DataFrame:
    latest = hydrate.latest_commit(c.commits, COMMIT_ORDER, ["repo_id", "file_path"])
    return latest.withColumn("latest_commit_date", iso_text(F.col("latest_commit_date")))


def _repo_languages(c: Corpus) -> DataFrame:
    return hydrate.language_map(c.languages).select("repo_id", F.expr(
        "array_join(transform(map_entries(repo_languages), e -> concat(e.key, '=', e.value)), ',')").alias("languages"))


def _repo_topics(c: Corpus) -> DataFrame:
    return hydrate.topic_list(c.topics).select("repo_id", F.array_join("repo_topics", ",").alias("topics"))


# ── Detection ────────────────────────────────────────────────────────────────────────────

def _prescreen_flag(c: Corpus) -> DataFrame:
    return c.files.select("file_id", D.contains_secret().alias("has_anchor"))


def _prescreen_counts(c: Corpus) -> DataFrame:
    return c.files.groupBy("lang", "source").agg(
        F.count("*").alias("n_files"), F.count_if(D.contains_secret()).alias("n_with_anchor"))


def _prescreen_pages(c: Corpus) -> DataFrame:
    pages = c.table("pages").select("page_id", D.contains_secret("html").alias("has_anchor"))
    return pages.agg(F.count("*").alias("n_pages"), F.count_if("has_anchor").alias("n_with_anchor"))


def _prescreen_conversations(c: Corpus) -> DataFrame:
    return c.table("conversations").groupBy("role").agg(
        F.count("*").alias("n_turns"), F.count_if(D.contains_secret("text")).alias("n_with_anchor"))


def _detections(c: Corpus) -> DataFrame:
    return D.detections(c.files).select("file_id", "ord", "secret_id", "category", "label", "sha256_fingerprint",
                                        "confidence", "redacted_sample", "is_pem_block")


def _detect_length_filtered(c: Corpus) -> DataFrame:
    return D.match_counts(c.files).groupBy("secret_id").agg(
        F.sum("n_matches").alias("n_matches"), F.sum("n_fitting").alias("n_fitting"))


def _detect_dedup_infile(c: Corpus) -> DataFrame:
    return D.detect(c.files).select("file_id", F.size("secrets").alias("n_secrets"), _shas())


def _pem_header_count(c: Corpus) -> DataFrame:
    return c.files.select("file_id", D.pem_header_count().alias("pem_headers"))


def _detections_by_category(c: Corpus) -> DataFrame:
    return D.group_by_category(D.detect(c.files)).withColumn("secret_ids", F.array_join("secret_ids", ","))


def _custom_rule_documents(c: Corpus) -> DataFrame:
    documents = c.table("documents").select("doc_id", "lang", "source", "text")
    found = D.detections(documents, "text", [*RULES, QUOTED_TOKEN])
    return found.select("doc_id", "lang", "source", "secret_id", "sha256_fingerprint", "redacted_sample")


def _custom_rule_run(c: Corpus) -> DataFrame:
    # In the documents' own texts only the user's rule finds anything.
    found = classified_findings(replace(_inputs(c), files=c.plain_files), AS_OF, rules=[*RULES, QUOTED_TOKEN])
    return found.select("file_id", "repo_name", "key_count", _shas(), "classification")


# ── Findings ─────────────────────────────────────────────────────────────────────────────

def _first_seen_secrets(c: Corpus) -> DataFrame:
    firsts = P.first_seen(D.explode_secrets(D.detect(c.files)))
    return firsts.select(F.col("sha").alias("sha256_fingerprint"), "file_id",
                         F.expr(D.rule_field("ord", "secret_id")).alias("secret_id"))


def _findings_dedup(c: Corpus) -> DataFrame:
    return P.findings(D.detect(c.files)).select("file_id", "key_count", "n_new", "pem_headers", _shas())


def _findings_nodedup(c: Corpus) -> DataFrame:
    detected = materialise(D.detect(c.files))
    return P.findings(detected, skip_duplicates=False).select("file_id", "key_count", "n_new", "pem_headers", _shas())


def _stream_findings(c: Corpus) -> DataFrame:
    spark = c.files.sparkSession
    out = scratch_dir(spark)
    scan_arrivals(files_of(c.arriving_documents()), out, f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/findings").select("file_id", "key_count", _shas())


def _incremental_findings(c: Corpus) -> DataFrame:
    """Two scheduled scans, of the first and the second half of the files, that remember what was seen."""
    store = FingerprintStore(c.files.sparkSession, scratch_dir(c.files.sparkSession, "seen"))
    middle = c.files.agg(F.max("file_id")).scalar() / 2
    halves = {"first": c.files.where(F.col("file_id") <= middle), "second": c.files.where(F.col("file_id") > middle)}
    found = [classified_findings(replace(_inputs(c), files=files), AS_OF, store=store, batch=name) for name, files in halves.items()]
    return reduce(DataFrame.unionByName, found).select("file_id", "key_count", _shas(), "classification")


def _incremental_fingerprints(c: Corpus) -> DataFrame:
    """What three scans of a third each leave in the store, one of them repeated."""
    store = FingerprintStore(c.files.sparkSession, scratch_dir(c.files.sparkSession, "seen"))
    for batch in (0, 1, 2, 1):
        part = c.files.where(F.col("file_id") % 3 == batch)
        store.take(P.first_seen(D.explode_secrets(D.detect(part))), str(batch))
    return store.fingerprints().select(F.col("sha").alias("sha256_fingerprint"), F.col("label").alias("batch"))


def _scrubbed_documents(c: Corpus) -> DataFrame:
    return scrub(c.files).select(F.col("file_id").alias("doc_id"), "n_spans", F.sha2("content", 256).alias("text_sha256"))


def _stream_first_seen(c: Corpus) -> DataFrame:
    """Fingerprints of documents that arrive a few files at a time, a second apart, under a watermark that spans them."""
    out = scratch_dir(c.files.sparkSession, "events")
    arriving = files_of(c.arriving_documents(maxFilesPerTrigger=4))
    timed = arriving.withColumn("at", F.timestamp_seconds(F.col("file_id") + 1_000_000_000))
    write_events(first_seen_events(timed, "at", "20000 days"), out, f"{out}-state").awaitTermination()
    return c.files.sparkSession.read.parquet(out).select("sha256_fingerprint")


def _stream_batch_alerts(c: Corpus) -> DataFrame:
    """Hours in which leaked findings of three repositories were committed, from findings that arrive in any order."""
    spark = c.files.sparkSession
    land, out = scratch_dir(spark, "leaked"), scratch_dir(spark, "events")
    leaked = _leaked(c).select("file_id", "repo_url", "latest_commit_date")
    leaked.repartition(4, "file_id").write.parquet(land)
    arriving = arriving_files(spark, land, leaked.schema, maxFilesPerTrigger=2)
    write_events(batch_alerts(arriving, "20000 days"), out, f"{out}-state").awaitTermination()
    return spark.read.schema("hour string, repos array<string>").parquet(out).select("hour", F.size("repos").alias("n_repos"))


def _class_counts(c: Corpus) -> DataFrame:
    return _found(c).groupBy("classification").agg(F.count("*").alias("n_findings"))


# ── Trends ───────────────────────────────────────────────────────────────────────────────

def _profiles(c: Corpus) -> DataFrame:
    return T.account_profiles(_leaked(c), AS_OF)


def _flat(profiles: DataFrame) -> DataFrame:
    return profiles.drop("first").withColumns({
        "locations": F.array_join("locations", " | "), "automation_signals": F.array_join("automation_signals", " | ")})


def _trend_long(c: Corpus) -> DataFrame:
    # Five aggregations share the leaked findings: compute those once.
    return T.trend_long(materialise(_leaked(c), name="leaked"), AS_OF)


def _iso_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns({k: iso_text(F.col(k)) for k in ("session_start", "session_end")})


def _trends_of_parts(c: Corpus) -> DataFrame:
    """The report over findings that came in three batches, the second one twice."""
    leaked, path = materialise(_leaked(c), name="leaked"), scratch_dir(c.files.sparkSession, "parts")
    for batch in (0, 1, 2, 1):
        write_part(leaked.where(F.pmod(F.xxhash64("file_id"), F.lit(3)) == batch), path, str(batch))
    return Parts(c.files.sparkSession, path).long(AS_OF)


# ── Reports ──────────────────────────────────────────────────────────────────────────────

def _report_findings_nested(c: Corpus) -> DataFrame:
    records = reports.finding_records(_found(c), with_email=True)
    secrets = F.expr("""array_join(transform(secrets, s -> concat_ws(',', s.secret_id, s.category, s.label,
                        s.confidence, s.redacted_sample, s.sha256_fingerprint)), ';')""")
    return records.withColumns({"secrets": secrets, "signals": F.array_join("signals", " | "),
                                "repo_topics": F.array_join("repo_topics", " | ")})


_QUERIES: dict[str, Callable[[Corpus], DataFrame]] = {
    "scan_content_present": _scan_content_present,
    "rules_listing": _rules_listing,
    "query_list": _query_list,
    "targets_parsed": _targets_parsed,
    "targets_resolved": _targets_resolved,
    "scope_semi_join": _scope_semi_join,
    "scope_global": _scope_global,
    "findings_in_scope": _findings_in_scope,
    "candidate_files": _candidate_files,
    "candidate_capped": _candidate_capped,
    "indexed_search": _indexed_search,
    "rule_table_matches": _rule_table_matches,
    "findings_by_search": _findings_by_search,
    "run_by_search_nodedup": _run_by_search_nodedup,
    "run_trends": _run_trends,
    "hydrate_hits": _hydrate_hits,
    "hydrate_hits_by_path": _hydrate_hits_by_path,
    "hydrate_hits_as_of": _hydrate_hits_as_of,
    "latest_commit": _latest_commit,
    "latest_commit_by_path": _latest_commit_by_path,
    "repo_languages": _repo_languages,
    "repo_topics": _repo_topics,
    "prescreen_flag": _prescreen_flag,
    "prescreen_counts": _prescreen_counts,
    "prescreen_pages": _prescreen_pages,
    "prescreen_conversations": _prescreen_conversations,
    "detections": _detections,
    "detect_length_filtered": _detect_length_filtered,
    "detect_dedup_infile": _detect_dedup_infile,
    "pem_header_count": _pem_header_count,
    "detections_by_category": _detections_by_category,
    "detections_by_rule": lambda c: D.count_by_rule(D.detections(c.files)),
    "custom_rule_documents": _custom_rule_documents,
    "custom_rule_run": _custom_rule_run,
    "first_seen_secrets": _first_seen_secrets,
    "findings_dedup": _findings_dedup,
    "findings_nodedup": _findings_nodedup,
    "stream_findings": _stream_findings,
    "stream_first_seen": _stream_first_seen,
    "stream_batch_alerts": _stream_batch_alerts,
    "incremental_findings": _incremental_findings,
    "incremental_fingerprints": _incremental_fingerprints,
    "scrubbed_documents": _scrubbed_documents,
    "exposure_rates": lambda c: exposure_rates(c.files),
    "run_summary": lambda c: C.run_summary(_found(c)),
    "run_summary_nodedup": lambda c: C.run_summary(_found(c, skip_duplicates=False)),
    "sig_dump_keyword": lambda c: _signals(c, "sig_dump_keyword"),
    "sig_non_owner": lambda c: _signals(c, "sig_non_owner"),
    "sig_bulk": lambda c: _signals(c, "key_volume", "sig_bulk"),
    "sig_gist": lambda c: _signals(c, "sig_gist"),
    "sig_username": lambda c: _signals(c, "sig_username"),
    "sig_new_account": lambda c: _signals(c, "sig_new_account"),
    "sig_dev_path": lambda c: _signals(c, "sig_dev_path"),
    "sig_pem": lambda c: _signals(c, "sig_pem"),
    "sig_topic": lambda c: _signals(c, "sig_topic"),
    "classified": _classified,
    "classified_nodedup": lambda c: _classified(c, skip_duplicates=False),
    "classified_signals": lambda c: _found(c).select("file_id", "commit_date", _joined("signals")),
    "class_counts": _class_counts,
    "trend_totals": lambda c: T.totals(_leaked(c), AS_OF),
    "account_profiles": lambda c: _flat(_profiles(c)),
    "account_age_bands": lambda c: T.account_age_bands(_profiles(c)),
    "automation_suspects": lambda c: _flat(T.automation_suspects(_profiles(c))),
    "top_accounts": lambda c: T.top_accounts(_profiles(c)).select(
        "owner_login", "repo_count", "total_keys", "age_label", "is_suspected_automation"),
    "keyword_freq": lambda c: T.keyword_frequency(_leaked(c)),
    "top_name_tokens": lambda c: T.top_name_tokens(_leaked(c)),
    "language_share": lambda c: T.language_share(_leaked(c)),
    "sophistication_scores": lambda c: T.sophistication_scores(_leaked(c)),
    "sophistication_tiers": lambda c: T.sophistication_tiers(_leaked(c)),
    "heatmap_hour": lambda c: T.hour_heatmap(_leaked(c)),
    "heatmap_dow": lambda c: T.weekday_heatmap(_leaked(c)),
    "batch_hours": lambda c: T.batch_hours(_leaked(c)),
    "batch_evidence": lambda c: T.batch_evidence(T.batch_hours(_leaked(c))),
    "upload_sessions": lambda c: _iso_sessions(T.upload_sessions(_leaked(c))),
    "upload_bursts": lambda c: _iso_sessions(T.upload_bursts(T.upload_sessions(_leaked(c), gap_minutes=90 * 24 * 60))),
    "batch_suspected": lambda c: T.batch_suspected(T.batch_hours(_leaked(c))),
    "volume_buckets": lambda c: T.volume_buckets(_leaked(c)),
    "artifact_freq": lambda c: T.artifact_frequency(_leaked(c)),
    "freshness": lambda c: T.freshness(_leaked(c), AS_OF),
    "trend_long": _trend_long,
    "trends_of_parts": _trends_of_parts,
    "secrets_by_category": lambda c: reports.secrets_by_category(_found(c)),
    "report_findings_nested": _report_findings_nested,
    "report_disclosure": lambda c: reports.disclosure_targets(_found(c)),
}
