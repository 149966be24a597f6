"""One SQL text per registered query."""

from __future__ import annotations

from keysift import wordlists as w
from keysift.catalog import ANCHORS, RULES, Rule
from oracle.base_sql import (AS_OF, BASE, DETECTION, FINDINGS, LABELLED, LABELLED_ALL, LEAKED, PRESCREEN, TABLES, detection,
                             _strip, labelled, q, tables, words)

INPUT = f"WITH {TABLES}"
DETECT = f"{INPUT}, {DETECTION}"
SHAS = "array_to_string(list_transform(secrets, lambda s: s.sha), ';')"

# ── Targets ──────────────────────────────────────────────────────────────────────────────

_REQUESTED = """CASE {0} % 4 WHEN 0 THEN ['ALL'] WHEN 1 THEN ['RSA_PRIVATE_KEY', 'openssh_private_key', 'NO_SUCH_RULE']
  WHEN 2 THEN ['all'] ELSE ['GITHUB_PAT', 'STRIPE_SECRET_KEY', 'GITHUB_PAT'] END"""
_GH = "'https://github.com/'"
TARGETS = f"""
targets AS (
  SELECT 'o' || owner_id AS target_id, [owner_login, {_GH} || owner_login, {_GH} || owner_login || '/',
      'github.com/' || owner_login, 'https://GITHUB.COM/' || owner_login, '  ' || owner_login || ' ',
      'https://gitlab.com/' || owner_login, owner_login || '.org', '', '   ', {_GH},
      {_GH} || owner_login || '?tab=repositories', 'https://github.com:443/' || owner_login,
      {_GH} || 'bad ' || owner_login][(owner_id % 14)::int + 1] AS raw, {_REQUESTED.format('owner_id')} AS secret_ids
  FROM owners
  UNION ALL
  SELECT 'r' || repo_id, [repo_name, {_GH} || repo_name, {_GH} || repo_name || '/tree/main/src',
      'www.github.com/' || repo_name, 'http://github.com//' || repo_name || '/',
      'github.com/' || repo_name || '/blob/main/README.md#L1', 'https://bitbucket.org/' || repo_name,
      repo_name || '-gone'][(repo_id % 8)::int + 1], {_REQUESTED.format('repo_id')}
  FROM repos),
cleaned AS (SELECT target_id, secret_ids, trim(raw) AS raw_input FROM targets),
urls AS (
  SELECT *, CASE WHEN starts_with(raw_input, 'http://') OR starts_with(raw_input, 'https://') THEN raw_input
                 ELSE 'https://' || raw_input END AS url FROM cleaned),
parts AS (
  SELECT *, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, list_filter(string_split(
    regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS path FROM urls),
kinds AS (
  SELECT *, CASE WHEN raw_input = '' THEN 'global'
    WHEN regexp_full_match(raw_input, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') AND NOT contains(lower(raw_input), 'github.com')
      THEN 'bare_repo'
    WHEN regexp_full_match(raw_input, '[A-Za-z0-9_-]+') THEN 'bare_org'
    WHEN lower(host) NOT IN ('', 'github.com', 'www.github.com') THEN 'bad_host'
    WHEN len(path) = 0 THEN 'global'
    WHEN len(path) = 1 THEN CASE WHEN regexp_full_match(path[1], '[A-Za-z0-9_.-]+') THEN 'org' ELSE 'bad_name' END
    WHEN len(path) = 2 THEN CASE WHEN regexp_full_match(path[1], '[A-Za-z0-9_.-]+')
      AND regexp_full_match(path[2], '[A-Za-z0-9_.-]+') THEN 'repo' ELSE 'bad_repo' END
    ELSE 'deep_repo' END AS kind FROM parts),
named AS (
  SELECT *, CASE WHEN kind IN ('bare_repo', 'bare_org') THEN raw_input WHEN kind = 'org' THEN path[1]
      WHEN kind IN ('repo', 'deep_repo') THEN path[1] || '/' || path[2] ELSE '' END AS name,
    CASE WHEN kind = 'global' THEN 'global' WHEN starts_with(kind, 'bad') THEN 'invalid'
      WHEN ends_with(kind, 'repo') THEN 'repo' ELSE 'org' END AS scope_type FROM kinds),
parsed AS (
  SELECT target_id, secret_ids, raw_input, scope_type, name,
    CASE WHEN scope_type IN ('org', 'repo') THEN scope_type || ':' || name ELSE '' END AS search_qualifier,
    CASE scope_type WHEN 'global' THEN 'Global scan (all of GitHub)' WHEN 'org' THEN 'Organisation / user: ' || name
      WHEN 'repo' THEN 'Single repository: ' || name ||
        CASE WHEN kind = 'deep_repo' THEN ' (truncated from longer URL)' ELSE '' END
      ELSE '' END AS display_label,
    CASE kind WHEN 'bad_host' THEN 'unsupported host: ' || host WHEN 'bad_name' THEN 'invalid name: ' || path[1]
      WHEN 'bad_repo' THEN 'invalid repository: ' || path[1] || '/' || path[2] END AS error FROM named),
checked AS (
  SELECT p.*, owner_type, owner_public_repos, CASE
      WHEN p.scope_type = 'org' AND owner_type IS NULL THEN 'invalid'
      WHEN p.scope_type = 'org' AND owner_type = 'User' THEN 'user'
      WHEN p.scope_type = 'repo' AND r.repo_id IS NULL THEN 'invalid' ELSE p.scope_type END AS kind
  FROM parsed p LEFT JOIN owners o ON p.scope_type = 'org' AND lower(p.name) = lower(o.owner_login)
  LEFT JOIN repos r ON p.scope_type = 'repo' AND lower(p.name) = lower(r.repo_name)),
resolved AS (
  SELECT target_id, kind AS scope_type, name,
    CASE WHEN kind IN ('org', 'user', 'repo') THEN kind || ':' || name ELSE '' END AS search_qualifier,
    CASE kind WHEN 'org' THEN 'Organisation: ' || name || ' (' || coalesce(owner_public_repos::varchar, '?') || ' public repos)'
      WHEN 'user' THEN 'User: ' || name || ' (' || coalesce(owner_public_repos::varchar, '?') || ' public repos)'
      WHEN 'invalid' THEN '' ELSE display_label END AS display_label,
    CASE WHEN kind <> 'invalid' OR scope_type = 'invalid' THEN error
      WHEN scope_type = 'org' THEN 'neither org nor user: ' || name ELSE 'not found: ' || name END AS error,
    kind <> 'invalid' AS verified FROM checked)"""

_SEARCHES = ", ".join(f"({i}, {q(r.secret_id)}, {q(r.search_query)})" for i, r in enumerate(RULES, 1))
_QUERY_LIST = f"""{INPUT}, {TARGETS},
searches AS (SELECT * FROM (VALUES {_SEARCHES}) t(ord, secret_id, search_query)),
wanted AS (
  SELECT target_id, search_qualifier, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM (
    SELECT target_id, search_qualifier, CASE WHEN len(secret_ids) = 1 AND upper(secret_ids[1]) = 'ALL'
      THEN {words(r.secret_id for r in RULES)} ELSE secret_ids END AS ids FROM parsed WHERE scope_type <> 'invalid')),
texts AS (
  SELECT target_id, trim(search_query || ' ' || search_qualifier) AS query, min(pos) AS pos
  FROM wanted JOIN searches ON secret_id = upper(id) GROUP BY ALL)
SELECT target_id AS request_id, row_number() OVER (PARTITION BY target_id ORDER BY pos)::int AS query_ord, query FROM texts"""

# ── Searches ─────────────────────────────────────────────────────────────────────────────

_VISITS = "visits AS (" + " UNION ALL ".join(
    f"SELECT {i} AS query_ord, {q(r.secret_id)} AS secret_id, file_id FROM files WHERE "
    + " AND ".join(f"contains(lower(content), {q(p.lower())})" for p in r.phrases)
    for i, r in enumerate(RULES, 1)) + ")"
_CAPPED = ("capped AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY query_ord ORDER BY file_id) <= 20)")
_IN_SCOPE = """repo_id IN (
      SELECT repo_id FROM repos JOIN owners USING (owner_id)
      WHERE lower(owner_login) IN (SELECT lower(name) FROM resolved WHERE scope_type IN ('org', 'user'))
         OR lower(repo_name) IN (SELECT lower(name) FROM resolved WHERE scope_type = 'repo'))"""
_SECRETS = "list({'ord': ord, 'pos': pos, 'sha': sha, 'sample': sample} ORDER BY ord, pos)"
_VISITED = f"""
first_visit AS (SELECT file_id, min(query_ord) AS query_ord FROM visits GROUP BY file_id),
visit_news AS (
  SELECT * FROM detected JOIN first_visit USING (file_id)
  QUALIFY row_number() OVER (PARTITION BY sha ORDER BY query_ord, file_id, ord, pos) = 1),
visited AS (SELECT file_id, query_ord, {_SECRETS} AS secrets, count(*) AS n_new FROM visit_news GROUP BY ALL)"""
_BY_SEARCH = f"""{DETECT}, {_VISITS}, {_VISITED}, {labelled('visited', 'findings', visited=True)}
SELECT file_id, query_ord, key_count, {SHAS} AS fingerprints, classification FROM findings"""
_SCOPED = f"""{INPUT}, {TARGETS}, {DETECTION.replace('detected AS', 'everywhere AS')},
detected AS (SELECT e.* FROM everywhere e JOIN files USING (file_id) WHERE {_IN_SCOPE})"""
# Every visit is a finding: the first one of a file lists what is new, or all; later ones list all.
_RUN_BY_SEARCH = f"""{_SCOPED}, {_VISITS}, {_VISITED},
listed AS (SELECT file_id, {_SECRETS} AS everything FROM detected GROUP BY file_id),
each_visit AS (
  SELECT v.file_id, v.query_ord, coalesce(n.secrets, everything) AS secrets, coalesce(n.n_new, 0) AS n_new
  FROM visits v JOIN listed USING (file_id) LEFT JOIN visited n ON n.file_id = v.file_id AND n.query_ord = v.query_ord),
{labelled('each_visit', 'findings', visited=True)}
SELECT file_id, query_ord, key_count, n_new, {SHAS} AS fingerprints, classification FROM findings"""
_CUSTOM = Rule("QUOTED_HEX_TOKEN", "api_key", "Quoted hex token", "low", r'token = "([a-f0-9]{40})"', "", 40, 40, '"token"',
               whole=False)
_CUSTOM_RUN = f"""WITH {tables('text')}, {detection([*RULES, _CUSTOM], [*ANCHORS, 'token = "'])}, {FINDINGS},
{labelled('listed', 'findings')}
SELECT file_id, repo_name, key_count, {SHAS} AS fingerprints, classification FROM findings"""

# ── Trends ───────────────────────────────────────────────────────────────────────────────

_SCORE = f"""least(10, CASE repo_language {' '.join(f"WHEN {q(k)} THEN {v}" for k, v in w.LANGUAGE_SCORES.items())}
    ELSE 1 END + CASE WHEN n_languages >= 3 THEN 2 WHEN n_languages >= 2 THEN 1 ELSE 0 END
  + CASE WHEN repo_size_kb > 500 THEN 2 WHEN repo_size_kb > 50 THEN 1 ELSE 0 END
  + CASE WHEN repo_stargazers >= 10 THEN 1 ELSE 0 END
  + CASE WHEN coalesce(repo_description, '') <> '' THEN 1 ELSE 0 END)"""
_FRESH = f"""count(*) FILTER (commit_ts > {AS_OF} - INTERVAL 30 DAY) AS active_last_30_days,
  count(*) FILTER (commit_ts > {AS_OF} - INTERVAL 90 DAY) AS active_last_90_days,
  count(*) FILTER (commit_ts IS NULL OR commit_ts < {AS_OF} - INTERVAL 180 DAY) AS abandoned"""
_HAS_ARTIFACT = "(" + " OR ".join(f"contains(path, {q(a)})" for a in w.STEALER_ARTIFACTS) + ")"
_TOTALS = f"""SELECT count(*) AS total_leaked_findings, count(DISTINCT repo_url) AS total_unique_repos,
  count(DISTINCT owner_login) AS total_unique_accounts, coalesce(sum(key_count), 0)::bigint AS total_keys_observed,
  coalesce(round_even(avg({_SCORE}), 2), 0)::double AS mean_sophistication_score,
  coalesce(median(key_count), 0)::double AS median_keys_per_repo,
  count(*) FILTER {_HAS_ARTIFACT} AS repos_with_stealer_artifacts, {_FRESH} FROM leaked"""
_BAND = ("CASE WHEN age IS NULL THEN 'unknown' "
         + " ".join(f"WHEN age < {n} THEN {q(t)}" for n, t in w.AGE_BANDS) + " ELSE 'unknown' END")
_PROFILES = f"""
grouped AS (
  SELECT owner_login, count(*) AS repo_count, sum(key_count)::bigint AS total_keys, min(file_id) AS first_id,
    arg_min(age, file_id)::int AS age, arg_min(owner_followers, file_id) AS followers,
    arg_min(owner_public_repos, file_id) AS public_repos,
    bool_or(coalesce(owner_location, '') <> '') AS located, arg_min(coalesce(owner_location, ''), file_id) AS place
  FROM leaked GROUP BY owner_login),
profiles AS (
  SELECT owner_login, repo_count, total_keys, age AS account_age_days, {_BAND} AS age_label, followers, public_repos,
    CASE WHEN located THEN place ELSE '' END AS locations, len(signals) >= 2 AS is_suspected_automation,
    array_to_string(signals, ' | ') AS automation_signals, first_id
  FROM (SELECT *, list_filter([CASE WHEN repo_count >= 5 THEN repo_count || ' leak repos from one account' END,
      CASE WHEN age <= 90 THEN 'account only ' || age || ' days old' END,
      CASE WHEN total_keys >= 50 THEN total_keys || ' keys across repos' END], lambda x: x IS NOT NULL) AS signals
    FROM grouped))"""
_PROFILE_COLUMNS = ("owner_login, repo_count, total_keys, account_age_days, age_label, followers, public_repos, "
                    "locations, is_suspected_automation, automation_signals")
_TIER = f"CASE WHEN {_SCORE} <= 3 THEN 'low (0-3)' WHEN {_SCORE} <= 6 THEN 'medium (4-6)' ELSE 'high (7-10)' END"
_VOLUME = "CASE WHEN key_count = 1 THEN '1' WHEN key_count < 10 THEN '2-9' WHEN key_count < 100 THEN '10-99' ELSE '100+' END"


def _labels(items) -> str:
    return f"(SELECT unnest({words(items)}) AS label)"


def _listed(column: str, items) -> str:
    """(label, n, first file, list position) of the listed words contained in a column."""
    return (f"SELECT label, count(*) AS n, min(file_id) AS f, arg_min(p, file_id * 100 + p) AS p FROM (SELECT file_id, "
            f"unnest(list_filter({words(items)}, lambda x: contains({column}, x))) AS label, "
            f"generate_subscripts(list_filter({words(items)}, lambda x: contains({column}, x)), 1) AS p FROM leaked) "
            "GROUP BY label")


_TOKENS = f"""SELECT label, count(*) AS n, min(file_id * 1000 + p) AS f FROM (
  SELECT file_id, unnest(ts) AS label, generate_subscripts(ts, 1) AS p FROM (
    SELECT file_id, list_filter(regexp_split_to_array(lower(substr(repo_name, instr(repo_name, '/') + 1)), '[^a-z0-9]+'),
      lambda x: length(x) > 1 AND NOT list_contains({words(w.NOISE_TOKENS)}, x)) AS ts FROM leaked)) GROUP BY label"""
_KEYWORDS = _listed("lower(repo_name)", w.TAXONOMY_KEYWORDS)
_ARTIFACTS = _listed("path", w.STEALER_ARTIFACTS)
_LANGUAGES = """SELECT coalesce(nullif(repo_language, ''), 'Unknown') AS label, count(*) AS n FROM leaked GROUP BY ALL"""
HOURS = [f"{h:02d}" for h in range(24)]


def _filled(items, expression: str) -> str:
    return (f"SELECT l.label, count(x.file_id) AS n FROM {_labels(items)} l LEFT JOIN "
            f"(SELECT file_id, {expression} AS label FROM leaked) x ON l.label = x.label GROUP BY l.label")


_HOUR = _filled(HOURS, "strftime(commit_ts, '%H')")
_DOW = _filled(w.WEEKDAYS, f"{words(w.WEEKDAYS)}[isodow(commit_ts)]")
_TIERS = _filled(w.TIERS, _TIER)
_BUCKETS = _filled(w.VOLUME_BUCKETS, _VOLUME)
_BATCH = """hours AS (SELECT strftime(commit_ts, '%Y-%m-%dT%H') AS hour, count(DISTINCT repo_url) AS n_repos FROM leaked
  WHERE commit_ts IS NOT NULL GROUP BY ALL HAVING count(DISTINCT repo_url) >= 3)"""
_EVIDENCE = "SELECT hour || 'Z: ' || n_repos || ' repos committed in same hour' AS evidence FROM hours ORDER BY 1 DESC LIMIT 5"
_READING = "CASE label " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in w.VOLUME_BUCKETS.items()) + " END"

_SCALARS = ["total_leaked_findings", "total_unique_repos", "total_unique_accounts", "total_keys_observed",
            "mean_sophistication_score", "median_keys_per_repo", "repos_with_stealer_artifacts", "active_last_30_days",
            "active_last_90_days", "abandoned"]
_LONG = " UNION ALL ".join([
    *(f"SELECT 'totals' AS section, {q(c)} AS label, {c}::varchar AS value FROM totals" for c in _SCALARS),
    f"SELECT 'keyword', label, n::varchar FROM ({_KEYWORDS})",
    f"SELECT 'token', label, n::varchar FROM (SELECT * FROM ({_TOKENS}) ORDER BY n DESC, f LIMIT 20)",
    f"SELECT 'language', label, n::varchar FROM ({_LANGUAGES})",
    f"SELECT 'tier', label, n::varchar FROM ({_TIERS}) WHERE (SELECT count(*) FROM leaked) > 0",
    f"SELECT 'hour', label, n::varchar FROM ({_HOUR})", f"SELECT 'weekday', label, n::varchar FROM ({_DOW})",
    f"SELECT 'volume', label, n::varchar FROM ({_BUCKETS})",
    f"SELECT 'artifact', label, n::varchar FROM (SELECT * FROM ({_ARTIFACTS}) ORDER BY n DESC, f, p LIMIT 10)",
    f"SELECT 'batch_evidence', evidence, '' FROM ({_EVIDENCE})",
    "SELECT 'top_account', owner_login, total_keys::varchar FROM (SELECT * FROM profiles ORDER BY total_keys DESC, first_id LIMIT 10)",
    "SELECT 'automation_suspect', owner_login, replace(automation_signals, ' | ', '; ') FROM profiles WHERE is_suspected_automation",
])

_SECRETS_TEXT = """array_to_string(list_transform(secrets, lambda s: concat_ws(',', names[s.ord].secret_id,
  names[s.ord].category, names[s.ord].label, names[s.ord].confidence, s.sample, s.sha)), ';')"""
_NAMES = ("(SELECT list({'secret_id': secret_id, 'category': category, 'label': label, 'confidence': confidence} "
          "ORDER BY ord) AS names FROM rules)")


def _signal(column: str, name: str) -> str:
    return f"{LABELLED} SELECT file_id, {column} AS {name} FROM findings"


_DETECTION_ROWS = """SELECT file_id, ord, secret_id, category, label, sha AS sha256_fingerprint, confidence,
  sample AS redacted_sample, category = 'private_key' AS is_pem_block FROM detected JOIN rules USING (ord)"""
_FINDING_COLUMNS = ("file_id, repo_name, owner_login, file_path, key_count, volume AS key_volume, confidence_score, "
                    "classification")
_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"

# Trend tables of a run in search order: places in that order stand for the files.
_RUN_TRENDS = f"""{DETECT}, {_VISITS}, {_VISITED}, {labelled('visited', 'findings', visited=True)},
leaked AS (SELECT * REPLACE (row_number() OVER (ORDER BY query_ord, file_id) AS file_id) FROM findings
  WHERE classification = 'LEAKED'), {_PROFILES}, totals AS ({_TOTALS})
""" + " UNION ALL ".join(f"SELECT {q(section)} AS section, concat_ws(',', {columns}) AS row FROM ({source})" for section, columns, source in (
    ("totals", "total_leaked_findings, total_unique_repos, total_unique_accounts, total_keys_observed", "SELECT * FROM totals"),
    ("freshness", "active_last_30_days, active_last_90_days, abandoned", "SELECT * FROM totals"),
    ("top_accounts", "owner_login, repo_count, total_keys", "SELECT * FROM profiles ORDER BY total_keys DESC, first_id LIMIT 10"),
    ("keyword_frequency", "label, n", _KEYWORDS), ("language_share", "label, n", _LANGUAGES),
    ("sophistication_tiers", "label, n", f"SELECT * FROM ({_TIERS}) WHERE (SELECT count(*) FROM leaked) > 0"),
    ("hour_heatmap", "label, n", _HOUR), ("weekday_heatmap", "label, n", _DOW), ("volume_buckets", "label, n", _BUCKETS),
    ("artifact_frequency", "label, n", f"SELECT * FROM ({_ARTIFACTS}) ORDER BY n DESC, f, p LIMIT 10"),
    ("top_name_tokens", "label, n", f"SELECT * FROM ({_TOKENS}) ORDER BY n DESC, f LIMIT 20")))

def _sessions(minutes: int) -> str:
    return f"""timed AS (SELECT owner_login, repo_url, file_id, commit_ts AS t FROM leaked WHERE commit_ts IS NOT NULL AND owner_login IS NOT NULL),
      stepped AS (SELECT *, CASE WHEN t - lag(t) OVER o < INTERVAL {minutes} MINUTE THEN 0 ELSE 1 END AS new
        FROM timed WINDOW o AS (PARTITION BY owner_login ORDER BY t, file_id)),
      numbered AS (SELECT *, sum(new) OVER (PARTITION BY owner_login ORDER BY t, file_id ROWS UNBOUNDED PRECEDING) AS session FROM stepped),
      sessions AS (SELECT owner_login, {_ISO.format('min(t)')} AS session_start, {_ISO.format('max(t)')} AS session_end,
        count(*) AS n_findings, count(DISTINCT repo_url) AS n_repos FROM numbered GROUP BY owner_login, session)"""


ORACLE: dict[str, str] = {
    "scan_content_present": f"""{INPUT} SELECT lang, source, count(*) AS n_files, sum(length(content))::bigint AS n_chars
      FROM files WHERE content IS NOT NULL GROUP BY ALL""",
    "rules_listing": f"""{DETECT} SELECT category_ord, category_label, r.ord, secret_id, label, confidence, search_query,
      count(d.sha) AS n_detections FROM rules r LEFT JOIN detected d ON r.ord = d.ord GROUP BY ALL""",
    "query_list": _QUERY_LIST,
    "targets_parsed": f"""{INPUT}, {TARGETS} SELECT target_id, raw_input, scope_type, name, search_qualifier,
      display_label, error FROM parsed""",
    "targets_resolved": f"{INPUT}, {TARGETS} SELECT * FROM resolved",
    "scope_semi_join": f"{INPUT}, {TARGETS} SELECT file_id, repo_id, file_path FROM files WHERE {_IN_SCOPE}",
    "scope_global": f"""{INPUT}, {TARGETS} SELECT file_id, repo_id, file_path FROM files
      WHERE {_IN_SCOPE} OR EXISTS (SELECT 1 FROM resolved WHERE scope_type = 'global')""",
    "findings_in_scope": f"""{_SCOPED}, {FINDINGS}, {labelled('listed', 'findings')}
      SELECT file_id, repo_name, key_count, {SHAS} AS fingerprints, classification FROM findings""",
    "candidate_files": f"{INPUT}, {_VISITS} SELECT * FROM visits",
    "candidate_capped": f"{INPUT}, {_VISITS}, {_CAPPED} SELECT * FROM capped",
    "indexed_search": f"{INPUT}, {_VISITS} SELECT * FROM visits",
    "rule_table_matches": f"""{INPUT}, {_VISITS},
      slices AS (SELECT item_id, lower(text) AS t, unnest(range(length(text) // 40)) AS i FROM benchmark),
      passages AS (SELECT item_id || '/' || i AS rule_id, substr(t, i * 40 + 1, 20) AS a, substr(t, i * 40 + 21, 20) AS b FROM slices),
      lowered AS MATERIALIZED (SELECT file_id, lower(content) AS content FROM files),
      matches AS (SELECT secret_id AS rule_id, file_id FROM visits UNION ALL
        SELECT rule_id, file_id FROM passages JOIN lowered ON contains(content, a) AND contains(content, b))
      SELECT rule_id, count(*) AS n_files, min(file_id) AS first_file FROM matches GROUP BY rule_id""",
    "findings_by_search": _BY_SEARCH,
    "run_by_search_nodedup": _RUN_BY_SEARCH,
    "run_trends": _RUN_TRENDS,
    "hydrate_hits": f"""{INPUT} SELECT file_id, repo_name, repo_url, repo_description, file_path, default_branch,
      '' AS raw_content_url, {_ISO.format('repo_created_at')} AS repo_created_at, {_ISO.format('ts')} AS repo_pushed_at,
      repo_language, n_languages, array_to_string(repo_topics, ' | ') AS repo_topics, repo_stargazers, repo_size_kb,
      owner_login, owner_type, {_ISO.format('owner_created_at')} AS owner_created_at, owner_public_repos,
      owner_followers, owner_following, owner_bio, owner_location,
      repo_url || '/blob/' || default_branch || '/' || file_path AS file_url, commit_sha AS latest_commit_sha, author_name AS latest_commit_author_name,
      author_email AS latest_commit_author_email, {_ISO.format('ts')} AS latest_commit_date
      FROM files LEFT JOIN repos USING (repo_id) LEFT JOIN owners USING (owner_id)
      LEFT JOIN (SELECT *, commit_ts AS ts FROM latest) USING (repo_id)""",
    "hydrate_hits_by_path": f"""{INPUT} SELECT file_id, repo_name, repo_url, repo_description, file_path, default_branch,
      '' AS raw_content_url, {_ISO.format('repo_created_at')} AS repo_created_at, {_ISO.format('ts')} AS repo_pushed_at,
      repo_language, n_languages, array_to_string(repo_topics, ' | ') AS repo_topics, repo_stargazers, repo_size_kb,
      owner_login, owner_type, {_ISO.format('owner_created_at')} AS owner_created_at, owner_public_repos,
      owner_followers, owner_following, owner_bio, owner_location,
      repo_url || '/blob/' || default_branch || '/' || file_path AS file_url, commit_sha AS latest_commit_sha, author_name AS latest_commit_author_name,
      author_email AS latest_commit_author_email, {_ISO.format('ts')} AS latest_commit_date
      FROM files LEFT JOIN repos USING (repo_id) LEFT JOIN owners USING (owner_id)
      LEFT JOIN (SELECT *, commit_ts AS ts FROM latest_by_path) USING (repo_id, file_path)""",
    "latest_commit": f"""{INPUT} SELECT repo_id, commit_sha AS latest_commit_sha, author_name AS latest_commit_author_name,
      author_email AS latest_commit_author_email, {_ISO.format('commit_ts')} AS latest_commit_date FROM latest""",
    "latest_commit_by_path": f"""{INPUT} SELECT repo_id, file_path, commit_sha AS latest_commit_sha,
      author_name AS latest_commit_author_name, author_email AS latest_commit_author_email,
      {_ISO.format('commit_ts')} AS latest_commit_date FROM latest_by_path""",
    "repo_languages": """SELECT p_partkey AS repo_id, CASE p_size % 4
        WHEN 0 THEN 'Python=' || (1000 + p_partkey) WHEN 1 THEN 'Go=' || (2000 + p_partkey) || ',Python=' || (1000 + p_partkey)
        WHEN 2 THEN 'Go=' || (2000 + p_partkey) || ',Python=' || (1000 + p_partkey) || ',Shell=' || (3000 + p_partkey)
        ELSE 'C=' || (4000 + p_partkey) || ',Go=' || (2000 + p_partkey) || ',Python=' || (1000 + p_partkey) ||
          ',Shell=' || (3000 + p_partkey) END AS languages FROM part WHERE p_partkey % 13 <> 0""",
    "repo_topics": f"""{INPUT} SELECT repo_id, array_to_string(repo_topics, ',') AS topics FROM repos
      WHERE len(repo_topics) > 0""",
    "prescreen_flag": f"{INPUT} SELECT file_id, coalesce({PRESCREEN}, false) AS has_anchor FROM files",
    "prescreen_counts": f"""{INPUT} SELECT lang, source, count(*) AS n_files, count(*) FILTER {PRESCREEN} AS n_with_anchor
      FROM files GROUP BY ALL""",
    "prescreen_pages": f"""SELECT count(*) AS n_pages, count(*) FILTER {PRESCREEN.replace('content', 'html')} AS n_with_anchor
      FROM pages""",
    "prescreen_conversations": f"""SELECT role, count(*) AS n_turns,
      count(*) FILTER {PRESCREEN.replace('content', 'text')} AS n_with_anchor FROM conversations GROUP BY ALL""",
    "detections": f"{DETECT} {_DETECTION_ROWS}",
    "detect_length_filtered": f"""{DETECT} SELECT secret_id, count(*) AS n_matches, count(f.n) AS n_fitting
      FROM matches m LEFT JOIN fitting f USING (file_id, ord, pos) JOIN rules USING (ord) GROUP BY secret_id""",
    "detect_dedup_infile": f"""{DETECT} SELECT f.file_id, count(sha) AS n_secrets,
      coalesce(string_agg(sha, ';' ORDER BY ord, pos), '') AS fingerprints
      FROM files f LEFT JOIN detected d ON f.file_id = d.file_id GROUP BY f.file_id""",
    "pem_header_count": f"{DETECT} SELECT file_id, pem_headers FROM pem",
    "detections_by_category": f"""{DETECT} SELECT file_id, category, count(*) AS n_secrets,
      string_agg(secret_id, ',' ORDER BY ord, pos) AS secret_ids FROM detected JOIN rules USING (ord)
      GROUP BY file_id, category""",
    "detections_by_rule": f"""{DETECT} SELECT secret_id, confidence, count(*) AS n_detections
      FROM detected JOIN rules USING (ord) GROUP BY ALL""",
    "custom_rule_documents": """SELECT DISTINCT doc_id, lang, source, 'QUOTED_HEX_TOKEN' AS secret_id,
      sha256(m) AS sha256_fingerprint, substr(m, 10, 4) || '****' AS redacted_sample
      FROM (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, 'token = "[a-f0-9]{40}"')) AS m FROM documents)""",
    "custom_rule_run": _CUSTOM_RUN,
    "first_seen_secrets": f"""{BASE} SELECT sha AS sha256_fingerprint, file_id, secret_id FROM news JOIN rules USING (ord)""",
    "findings_dedup": f"""{BASE} SELECT file_id, len(secrets) AS key_count, len(secrets) AS n_new, pem_headers,
      {SHAS} AS fingerprints FROM listed JOIN pem USING (file_id)""",
    "findings_nodedup": f"""{BASE} SELECT file_id, len(secrets) AS key_count, n_new, pem_headers,
      {SHAS} AS fingerprints FROM all_listed JOIN pem USING (file_id)""",
    "stream_findings": f"{BASE} SELECT file_id, len(secrets) AS key_count, {SHAS} AS fingerprints FROM listed",
    "run_summary": f"""{LABELLED} SELECT count(*) AS total_findings, count(*) FILTER (classification = 'LEAKED') AS leaked_count,
      count(*) FILTER (classification = 'ACCIDENTAL') AS accidental_count,
      count(*) FILTER (classification = 'UNCERTAIN') AS uncertain_count,
      (SELECT count(DISTINCT sha) FROM detected) AS unique_hashes FROM findings""",
    "run_summary_nodedup": f"""{LABELLED_ALL} SELECT count(*) AS total_findings,
      count(*) FILTER (classification = 'LEAKED') AS leaked_count,
      count(*) FILTER (classification = 'ACCIDENTAL') AS accidental_count,
      count(*) FILTER (classification = 'UNCERTAIN') AS uncertain_count,
      (SELECT count(DISTINCT sha) FROM detected) AS unique_hashes FROM findings""",
    "sig_dump_keyword": _signal("s_dump", "sig_dump_keyword"),
    "sig_non_owner": _signal("s_non", "sig_non_owner"),
    "sig_bulk": f"{LABELLED} SELECT file_id, volume AS key_volume, s_bulk AS sig_bulk FROM findings",
    "sig_gist": _signal("s_gist", "sig_gist"),
    "sig_username": _signal("s_user", "sig_username"),
    "sig_new_account": _signal("s_new", "sig_new_account"),
    "sig_dev_path": _signal("s_dev", "sig_dev_path"),
    "sig_pem": _signal("s_pem", "sig_pem"),
    "sig_topic": _signal("s_topic", "sig_topic"),
    "classified": f"{LABELLED} SELECT {_FINDING_COLUMNS} FROM findings",
    "classified_nodedup": f"{LABELLED_ALL} SELECT {_FINDING_COLUMNS} FROM findings",
    "classified_signals": f"{LABELLED} SELECT file_id, commit_date, signals FROM findings",
    "class_counts": f"{LABELLED} SELECT classification, count(*) AS n_findings FROM findings GROUP BY ALL",
    "trend_totals": f"{LEAKED} {_TOTALS}",
    "account_profiles": f"{LEAKED}, {_PROFILES} SELECT {_PROFILE_COLUMNS} FROM profiles",
    "account_age_bands": f"{LEAKED}, {_PROFILES} SELECT age_label, count(*) AS n_accounts FROM profiles GROUP BY ALL",
    "automation_suspects": f"{LEAKED}, {_PROFILES} SELECT {_PROFILE_COLUMNS} FROM profiles WHERE is_suspected_automation",
    "top_accounts": f"""{LEAKED}, {_PROFILES} SELECT owner_login, repo_count, total_keys, age_label, is_suspected_automation
      FROM profiles ORDER BY total_keys DESC, first_id LIMIT 10""",
    "keyword_freq": f"{LEAKED} SELECT label AS keyword, n FROM ({_KEYWORDS}) ORDER BY n DESC, f, p",
    "top_name_tokens": f"{LEAKED} SELECT label AS token, n FROM ({_TOKENS}) ORDER BY n DESC, f LIMIT 20",
    "language_share": f"""{LEAKED} SELECT label AS language, n,
      round_even(n / (SELECT count(*) FROM leaked)::double * 100, 1)::double AS pct FROM ({_LANGUAGES})""",
    "sophistication_scores": f"{LEAKED} SELECT file_id, {_SCORE} AS score FROM leaked",
    "sophistication_tiers": f"""{LEAKED} SELECT label AS tier, n AS n_findings FROM ({_TIERS})
      WHERE (SELECT count(*) FROM leaked) > 0""",
    "heatmap_hour": f"{LEAKED} SELECT label AS hour, n AS n_commits FROM ({_HOUR})",
    "heatmap_dow": f"{LEAKED} SELECT label AS weekday, n AS n_commits FROM ({_DOW})",
    "batch_hours": f"{LEAKED}, {_BATCH} SELECT * FROM hours",
    "batch_evidence": f"{LEAKED}, {_BATCH} {_EVIDENCE}",
    "batch_suspected": f"{LEAKED}, {_BATCH} SELECT count(*) > 0 AS batch_upload_suspected FROM hours",
    "volume_buckets": f"{LEAKED} SELECT label AS bucket, n AS n_findings, {_READING} AS interpretation FROM ({_BUCKETS})",
    "artifact_freq": f"{LEAKED} SELECT label AS artifact, n FROM ({_ARTIFACTS}) ORDER BY n DESC, f, p LIMIT 10",
    "freshness": f"{LEAKED} SELECT {_FRESH} FROM leaked",
    "trend_long": f"{LEAKED}, {_PROFILES}, {_BATCH}, totals AS ({_TOTALS}) {_LONG}",
    "secrets_by_category": f"""{LABELLED} SELECT category, count(*) AS n_secrets
      FROM (SELECT unnest(secrets).ord AS ord FROM findings) JOIN rules USING (ord) GROUP BY category""",
    "report_findings_nested": f"""{LABELLED} SELECT file_id, classification, confidence_score, signals, repo_url, file_path,
      commit_sha, author_name, author_email, commit_date, key_count AS secret_count, {_SECRETS_TEXT} AS secrets,
      owner_login, owner_type, repo_language, array_to_string(repo_topics, ' | ') AS repo_topics,
      {_ISO.format('repo_created_at')} AS repo_created_at FROM findings, {_NAMES}""",
    "report_disclosure": f"""{LABELLED} SELECT author_email, coalesce(author_name, '') AS author_name, repo_url, file_path,
      coalesce(commit_sha, '') AS commit_sha, commit_date, classification,
      array_to_string(list_transform(secrets, lambda s: names[s.ord].secret_id), ';') AS secret_types,
      array_to_string(list_sort(list_distinct(list_transform(secrets, lambda s: names[s.ord].category))), ';')
        AS secret_categories,
      key_count AS secret_count, {SHAS} AS secret_sha256_fingerprints
      FROM findings, {_NAMES} WHERE classification <> 'LEAKED' AND coalesce(author_email, '') <> ''""",
    "incremental_findings": f"""{LABELLED} SELECT file_id, len(secrets) AS key_count, {SHAS} AS fingerprints, classification
      FROM findings""",
    "incremental_fingerprints": f"""{BASE} SELECT sha AS sha256_fingerprint, CAST(min(file_id % 3) AS VARCHAR) AS batch
      FROM detected GROUP BY sha""",
    "scrubbed_documents": f"""{BASE}, cut AS (
        SELECT file_id, list(DISTINCT m) AS ms FROM (SELECT *, {_strip('v')} AS s FROM matches) JOIN rules USING (ord)
        WHERE length(s) >= min_length AND (max_length IS NULL OR length(s) <= max_length) GROUP BY file_id),
      scrubbed AS (
        SELECT file_id, list_reduce(list_prepend(content, list_transform(list_sort(list_transform(coalesce(ms, []),
                 lambda m: {{'n': -length(m), 'm': m}})), lambda x: x.m)),
                 lambda t, m: replace(t, m, '[secret; removed]')) AS cleaned
        FROM files LEFT JOIN cut USING (file_id))
      SELECT file_id AS doc_id, CAST((length(cleaned) - length(replace(cleaned, '[secret; removed]', ''))) / 17 AS INTEGER) AS n_spans,
             sha256(cleaned) AS text_sha256 FROM scrubbed""",
    "exposure_rates": f"""{BASE}, held AS (
        SELECT DISTINCT file_id, category FROM detected JOIN rules USING (ord)),
      levels AS (
        SELECT lang, source, CAST(GROUPING(lang, source) AS INTEGER) AS level, count(*) AS n_files FROM files GROUP BY CUBE (lang, source)),
      exposed AS (
        SELECT lang, source, coalesce(category, 'any') AS category, CAST(GROUPING(lang, source) AS INTEGER) AS level,
               count(DISTINCT file_id) AS n_exposed
        FROM (SELECT file_id, category FROM held UNION ALL SELECT DISTINCT file_id, null FROM held) JOIN files USING (file_id)
        GROUP BY GROUPING SETS ((lang, source, category), (lang, category), (source, category), (category)))
      SELECT l.lang, l.source, l.level, c.category, n_files, coalesce(n_exposed, 0) AS n_exposed, coalesce(n_exposed, 0) / n_files AS rate
      FROM levels l CROSS JOIN (SELECT DISTINCT category FROM rules UNION ALL SELECT 'any') c
           LEFT JOIN exposed e ON e.lang IS NOT DISTINCT FROM l.lang AND e.source IS NOT DISTINCT FROM l.source
                AND e.level = l.level AND e.category = c.category""",
    "stream_first_seen": f"{BASE} SELECT DISTINCT sha AS sha256_fingerprint FROM detected",
    "stream_batch_alerts": f"{LEAKED}, {_BATCH} SELECT hour, 3 AS n_repos FROM hours",
    "trends_of_parts": f"{LEAKED}, {_PROFILES}, {_BATCH}, totals AS ({_TOTALS}) {_LONG}",
    "hydrate_hits_as_of": f"""{INPUT}, seen AS (
        SELECT file_id, repo_id, {AS_OF} - to_days((file_id * 41 % 3600)::int) - to_minutes((file_id % 1440)::int) AS at FROM files),
      held AS (
        SELECT s.file_id, c.* EXCLUDE (repo_id, file_path) FROM seen s JOIN commits c ON c.repo_id = s.repo_id AND c.ts <= s.at
        QUALIFY row_number() OVER (PARTITION BY s.file_id
          ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
      SELECT s.file_id, repo_name, owner_login, {_ISO.format('s.at')} AS seen_at, commit_sha AS latest_commit_sha,
        author_name AS latest_commit_author_name, author_email AS latest_commit_author_email, {_ISO.format('ts')} AS latest_commit_date
      FROM seen s LEFT JOIN repos r ON r.repo_id = s.repo_id LEFT JOIN owners o ON o.owner_id = r.owner_id
        LEFT JOIN held t ON t.file_id = s.file_id""",
    "upload_sessions": f"{LEAKED}, {_sessions(60)} SELECT * FROM sessions",
    "upload_bursts": f"{LEAKED}, {_sessions(90 * 24 * 60)} SELECT * FROM sessions WHERE n_repos >= {w.BATCH_REPOS_MIN}",
}
