"""Shared WITH clause: input tables, detections, findings and labels in plain SQL."""

from __future__ import annotations

import re

from keysift import wordlists as w
from keysift.catalog import ANCHORS, CATEGORIES, RULES

AS_OF = "TIMESTAMP '2001-12-01 00:00:00'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


# ── Input tables ─────────────────────────────────────────────────────────────────────────

LOGIN = """CASE {k} % 5 WHEN 0 THEN 'xk' || substr(md5({k}::varchar), 1, 8) WHEN 1 THEN 'ghost-' || {k}
  WHEN 2 THEN 'user-' || lpad({k}::varchar, 7, '0') WHEN 3 THEN 'Dev-' || {k} ELSE 'Team.' || {k} END"""


def _hex(tag: str, n: int) -> str:
    return "substr(" + " || ".join(f"md5('{tag}{x}-' || (doc_id // 80))" for x in "abc") + f", 1, {n})"


def _pem(tag: str, kind: str, n: int) -> str:
    name = {"": "PRIVATE KEY", "PGP": "PGP PRIVATE KEY BLOCK"}.get(kind, f"{kind} PRIVATE KEY")
    return (f"array_to_string(list_transform(range(1, {n + 1}), lambda i: '-----BEGIN {name}-----' || chr(10) || "
            f"repeat(md5('{tag}-' || (doc_id // 80) || '-' || i), 2) || chr(10) || '-----END {name}-----'), chr(10))")


def _suffix() -> str:
    shapes = [
        _pem("os", "OPENSSH", 1), _pem("rs", "RSA", 12), _pem("ec", "EC", 120), _pem("ds", "DSA", 1),
        _pem("p8", "", 3), _pem("en", "ENCRYPTED", 1), _pem("pg", "PGP", 10),
        f"'id:  AK' || 'IA' || upper({_hex('aw', 16)}) || '  ;'",
        f"'AWS_SECRET_ACCESS_KEY = ' || {_hex('as', 40)}",
        "'{\"type\": \"service_account\"}'",
        f"'key: AI' || 'za' || {_hex('ga', 35)}",
        f"'{{\"client_secret\": \"GOC' || 'SPX-' || {_hex('go', 28)} || '\"}}'",
        f"'AZURE_CLIENT_SECRET=' || {_hex('az', 36)}",
        f"'DefaultEndpointsProtocol=https;AccountName=acct;AccountKey=' || {_hex('cs', 88)} || ';'",
        f"'gh' || 'p_' || {_hex('gh', 36)}", f"'glp' || 'at-' || {_hex('gl', 20)}",
        f"'np' || 'm_' || {_hex('np', 36)}", f"'py' || 'pi-' || {_hex('py', 40)}",
        f"'sk_' || 'live_' || {_hex('sk', 24)}", f"'rk_' || 'test_' || {_hex('rk', 24)}",
        f"'AccountSid A' || 'C' || {_hex('tw', 32)}", f"'TWILIO_AUTH_TOKEN = ' || {_hex('ta', 32)}",
        f"'S' || 'G.' || {_hex('s1', 22)} || '.' || {_hex('s2', 43)}", f"'xo' || 'xb-' || {_hex('sl', 40)}",
        f"'https://api.telegram.org/bot123456789:' || {_hex('tg', 35)}", f"'mailgun key' || '-' || {_hex('mg', 32)}",
        f"'HEROKU_API_KEY=' || {_hex('h1', 8)} || '-' || {_hex('h2', 4)} || '-4' || {_hex('h3', 3)} || '-8' || "
        f"{_hex('h4', 3)} || '-' || {_hex('h5', 12)}",
        f"'ey' || 'J' || {_hex('j1', 20)} || '.' || {_hex('j2', 43)} || '.' || {_hex('j3', 43)}",
        f"'access_token = ' || {_hex('at', 40)}",
        f"'postgres://app:' || {_hex('pw', 12)} || '@db.example.com/main'",
        _pem("r2", "RSA", 120),
        f"'id:  AK' || 'IA' || upper({_hex('ax', 16)}) || '  ;' || chr(10) || 'redis://u:' || {_hex('rp', 10)} || "
        f"'@cache.example.com:6379' || chr(10) || 'xo' || 'xp-' || {_hex('sp', 30)}",
        "'glp' || 'at-0123456789abcdefghij'",
        "'AK' || 'IA12345  postgres://u:short@h  ey' || 'Jab.cd  xo' || 'xb-123456789012'",
    ]
    return "CASE doc_id % 40 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes)) + " ELSE '' END"


PATHS = ["README.md", ".ssh/id_rsa", "tests/fixtures/key.pem", "logs/passwords.txt", "config/ssh/key", "src/app.env",
         "deploy/server.pem", "dump/cookies.txt", "examples/keys.txt", "wallet/metamask.json",
         "terraform/provision_key"]

def tables(content: str = f"text || chr(10) || {_suffix()}") -> str:
    return f"""
owners AS (
  SELECT c_custkey AS owner_id, {LOGIN.format(k='c_custkey')} AS owner_login,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Organization' ELSE 'User' END AS owner_type,
    {AS_OF} - to_days((c_custkey * 37 % 1500)::int) AS owner_created_at,
    (c_custkey % 40)::int AS owner_public_repos, floor(abs(c_acctbal))::int % 500 AS owner_followers,
    (c_custkey % 25)::int AS owner_following, CASE WHEN c_custkey % 2 = 1 THEN 'bio of ' || c_name END AS owner_bio,
    CASE WHEN c_custkey % 3 <> 0 THEN n_name END AS owner_location
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
repos AS (
  SELECT *, CASE WHEN repo_id % 17 = 0 THEN 'https://gist.github.com/' ELSE 'https://github.com/' END || repo_name AS repo_url
  FROM (SELECT p_partkey AS repo_id, owner_id, owner_login || '/' || replace(p_name, ' ', '-') ||
      CASE p_partkey % 9 WHEN 0 THEN '-stealer-logs' WHEN 1 THEN '-dump-2024' WHEN 2 THEN '-creds' ELSE '' END
      || '-' || p_partkey AS repo_name,
    CASE WHEN p_partkey % 4 = 0 THEN null WHEN p_partkey % 8 = 1 THEN '' ELSE p_name END AS repo_description,
    CASE p_partkey % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'main' WHEN 2 THEN 'master' ELSE 'main' END AS default_branch,
    {AS_OF} - to_days((p_partkey * 53 % 3000)::int) AS repo_created_at,
    CASE p_size % 8 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' WHEN 2 THEN 'Shell' WHEN 3 THEN 'JavaScript' WHEN 4 THEN 'PHP'
      WHEN 5 THEN 'C++' WHEN 7 THEN 'Rust' END AS repo_language,
    p_size::int AS repo_stargazers, floor(p_retailprice)::bigint % 900 AS repo_size_kb,
    CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 1 + p_size::int % 4 END AS n_languages,
    CASE p_partkey % 11 WHEN 0 THEN ['ctf'] WHEN 1 THEN ['python', 'tools'] WHEN 2 THEN ['pentest', 'red-team']
      WHEN 3 THEN ['ctf-writeups'] ELSE []::varchar[] END AS repo_topics
  FROM part LEFT JOIN owners ON p_partkey // 8 = owner_id)),
commits AS (
  SELECT l_partkey AS repo_id,
    CASE WHEN l_partkey % 4 = 0 THEN date_trunc('month', l_shipdate) + INTERVAL 2 HOUR
         ELSE l_shipdate + to_hours((l_orderkey % 24)::int) END AS ts,
    sha1(l_orderkey || '-' || l_linenumber || '-' || l_suppkey) AS commit_sha, 's' || l_suppkey AS author_name,
    CASE l_suppkey % 4 WHEN 0 THEN lower({LOGIN.format(k='(l_partkey // 8)')}) || '@example.com' WHEN 1 THEN null
      ELSE 's' || l_suppkey || '@example.com' END AS author_email,
    l_orderkey, l_linenumber, l_suppkey, l_extendedprice, {words(PATHS)}[((l_orderkey + 1) % 11)::int + 1] AS file_path
  FROM lineitem),
latest AS (
  SELECT repo_id, ts AS commit_ts, commit_sha, author_name, author_email FROM commits
  QUALIFY row_number() OVER (PARTITION BY repo_id
    ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1),
latest_by_path AS (
  SELECT repo_id, file_path, ts AS commit_ts, commit_sha, author_name, author_email FROM commits
  QUALIFY row_number() OVER (PARTITION BY repo_id, file_path
    ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1),
files AS MATERIALIZED (
  SELECT doc_id AS file_id, doc_id // 2 AS repo_id, {words(PATHS)}[((doc_id + 1) % 11)::int + 1] AS file_path,
    lang, source, {content} AS content
  FROM documents)"""


TABLES = tables()


# ── Detection ────────────────────────────────────────────────────────────────────────────

_WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _re2(rule) -> str:
    # No look-around in this dialect: the neighbours are consumed, and group 1 is the match.
    text = rule.pattern.replace("(?<![A-Z0-9])", "(?:^|[^A-Z0-9])").replace("(?![A-Z0-9])", "(?:[^A-Z0-9]|$)")
    text = re.sub(r"(\[[^\]]*)\\s", lambda m: m.group(1) + _WS, text).replace(r"\s", f"[{_WS}]").replace(r"\d", r"\p{Nd}")
    return f"(?{rule.flags}){text}" if rule.flags else text


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _matches(rules) -> str:
    parts = []
    for i, rule in enumerate(rules, 1):
        around = "(?<!" in rule.pattern
        p = q(_re2(rule))
        # Match and value are listed side by side; position is the index in the list.
        group = 0 if rule.whole and not around else 1
        parts.append(f"""SELECT file_id, {i} AS ord, generate_subscripts(ms, 1) AS pos, unnest(ms) AS m, unnest(vs) AS v
          FROM (SELECT file_id, regexp_extract_all(content, {p}, {1 if around else 0}) AS ms,
                       regexp_extract_all(content, {p}, {group}) AS vs FROM screened)""")
    return "\nUNION ALL\n".join(parts)


def prescreen(anchors) -> str:
    return f"(content <> '' AND regexp_matches(content, {q('(?i)' + '|'.join(re.escape(a) for a in anchors))}))"


PRESCREEN = prescreen(ANCHORS)


def detection(rules=RULES, anchors=ANCHORS) -> str:
    rows = ", ".join(
        f"({i}, {q(r.secret_id)}, {q(r.category)}, {q(r.label)}, {q(r.confidence)}, {r.min_length}, "
        f"{r.max_length or 'null'}, {q(r.search_query)}, {list(CATEGORIES).index(r.category) + 1}, "
        f"{q(CATEGORIES[r.category])})" for i, r in enumerate(rules, 1))
    return f"""
rules AS (SELECT * FROM (VALUES {rows}) t(ord, secret_id, category, label, confidence, min_length, max_length,
  search_query, category_ord, category_label)),
screened AS (SELECT file_id, content FROM files WHERE {prescreen(anchors)}),
matches AS ({_matches(rules)}),
fitting AS (
  SELECT file_id, ord, pos, sha256(m) AS sha, length(s) AS n,
    CASE WHEN length(s) >= 4 THEN substr(s, 1, 4) || '****' ELSE '****' END AS sample
  FROM (SELECT *, {_strip('v')} AS s FROM matches) JOIN rules USING (ord)
  WHERE length(s) >= min_length AND (max_length IS NULL OR length(s) <= max_length)),
detected AS MATERIALIZED (
  SELECT file_id, ord, pos, sha, sample FROM fitting
  QUALIFY row_number() OVER (PARTITION BY file_id, sha ORDER BY ord, pos) = 1),
pem AS (
  SELECT file_id, len(regexp_extract_all(content,
    '(?i)-----BEGIN (?:OPENSSH |RSA |EC |DSA |ENCRYPTED |PGP )?PRIVATE KEY'))::int AS pem_headers FROM files)"""


DETECTION = detection()


# ── Findings ─────────────────────────────────────────────────────────────────────────────

FINDINGS = """
news AS (
  SELECT * FROM detected QUALIFY row_number() OVER (PARTITION BY sha ORDER BY file_id, ord, pos) = 1),
listed AS (
  SELECT file_id, list({'ord': ord, 'pos': pos, 'sha': sha, 'sample': sample} ORDER BY ord, pos) AS secrets
  FROM news GROUP BY file_id),
all_listed AS (
  SELECT d.file_id, coalesce(any_value(l.secrets),
      list({'ord': ord, 'pos': pos, 'sha': sha, 'sample': sample} ORDER BY ord, pos)) AS secrets,
    coalesce(len(any_value(l.secrets)), 0) AS n_new
  FROM detected d LEFT JOIN listed l USING (file_id) GROUP BY d.file_id)"""


def _first(items, condition: str) -> str:
    """First listed word for which the condition on x holds."""
    return f"list_filter({words(items)}, lambda x: {condition})[1]"


_DEV = " OR ".join(
    f"regexp_matches(path, {q(p.replace(chr(92) + 'n?' + chr(92) + 'z', '$'))})" for p in w.DEV_PATHS)
_LOGIN_BAD = ("regexp_matches(owner_login, '^[a-z0-9]{8,16}$') OR regexp_matches(owner_login, '[0-9]{6}') OR "
              "regexp_matches(owner_login, '(?i)hack|crack|steal|leak|dump|ghost|anon')")


def labelled(source: str, name: str, visited: bool = False) -> str:
    """Hydrate and label the findings listed in ``source``; with ``visited`` it has query_ord and n_new."""
    n_new = "n_new" if source == "all_listed" or visited else "len(secrets) AS n_new"
    return f"""
{name}_wide AS (
  SELECT f.file_id,{" s.query_ord," if visited else ""} s.secrets, {n_new}, len(s.secrets)::int AS key_count, pem_headers,
    greatest(len(s.secrets), pem_headers)::int AS volume, f.repo_id, file_path, lower(file_path) AS path,
    coalesce(repo_name, '') AS repo_name, coalesce(repo_url, '') AS repo_url, repo_description, repo_language,
    coalesce(n_languages, 0) AS n_languages, coalesce(repo_topics, []) AS repo_topics, repo_stargazers, repo_size_kb,
    repo_created_at, coalesce(owner_login, '') AS owner_login, owner_type, owner_created_at, owner_followers, owner_public_repos, owner_location,
    commit_ts, commit_sha, author_name, author_email,
    date_diff('day', owner_created_at, {AS_OF}) AS age
  FROM {source} s JOIN files f USING (file_id) JOIN pem USING (file_id) LEFT JOIN repos r ON f.repo_id = r.repo_id
  LEFT JOIN owners o ON o.owner_id = r.owner_id
  LEFT JOIN latest c ON c.repo_id = f.repo_id),
{name}_signals AS (
  SELECT *, {_first(w.DUMP_KEYWORDS, 'contains(lower(repo_name), x)')} AS s_dump,
    coalesce(author_name, '') <> '' AND NOT contains(lower(owner_login), lower(author_name))
      AND coalesce(author_email, '') <> '' AND NOT contains(split_part(lower(author_email), '@', 1), lower(owner_login)) AS s_non,
    CASE WHEN volume >= 100 THEN 'mass' WHEN volume >= 10 THEN 'bulk' END AS s_bulk,
    contains(repo_url, '/gist.github.com/') OR starts_with(repo_name, 'gist:') AS s_gist,
    {_LOGIN_BAD} AS s_user, CASE WHEN age < 30 THEN age::int END AS s_new,
    CASE WHEN {_DEV} THEN CASE WHEN volume = 1 AND contains(path, '.ssh') THEN 'ssh'
      WHEN contains(path, 'test') OR contains(path, 'fixture') OR contains(path, 'example') THEN 'test' ELSE 'other' END
      END AS s_dev,
    {_first(w.RESEARCH_TOPICS, 'list_contains(repo_topics, x)')} AS s_topic
  FROM {name}_wide),
{name}_running AS (
  SELECT *, 0.0::double + (CASE WHEN s_dump IS NOT NULL THEN 0.45 ELSE 0 END)::double
    + (CASE WHEN s_non THEN 0.25 ELSE 0 END)::double
    + (CASE s_bulk WHEN 'mass' THEN 0.40 WHEN 'bulk' THEN 0.25 ELSE 0 END)::double
    + (CASE WHEN s_gist THEN 0.20 ELSE 0 END)::double + (CASE WHEN s_user THEN 0.15 ELSE 0 END)::double
    + (CASE WHEN s_new IS NOT NULL THEN 0.20 ELSE 0 END)::double
    - (CASE s_dev WHEN 'ssh' THEN 0.40 WHEN 'test' THEN 0.20 WHEN 'other' THEN 0.30 ELSE 0 END)::double AS running
  FROM {name}_signals),
{name}_scored AS (
  SELECT *, ends_with(path, '.pem') AND running <= 0.10::double AS s_pem,
    round(greatest(0::double, least(1::double, running
      - (CASE WHEN ends_with(path, '.pem') AND running <= 0.10::double THEN 0.10 ELSE 0 END)::double
      - (CASE WHEN s_topic IS NOT NULL THEN 0.10 ELSE 0 END)::double)), 3) AS confidence_score
  FROM {name}_running),
{name} AS MATERIALIZED (
  SELECT *, CASE WHEN confidence_score >= 0.40::double THEN 'LEAKED' WHEN confidence_score <= 0.15::double THEN 'ACCIDENTAL'
      ELSE 'UNCERTAIN' END AS classification,
    coalesce(strftime(commit_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00', 'unknown') AS commit_date,
    array_to_string(list_filter([
      'repo name contains dump keyword ''' || s_dump || '''',
      CASE WHEN s_non THEN 'commit author ''' || author_name || ''' ≠ repo owner ''' || owner_login || '''' END,
      CASE s_bulk WHEN 'mass' THEN 'mass key dump: ' || volume || ' keys in file'
                  WHEN 'bulk' THEN 'bulk keys: ' || volume || ' keys in file' END,
      CASE WHEN s_gist THEN 'hosted as a GitHub Gist' END,
      CASE WHEN s_user THEN 'suspicious username pattern: ''' || owner_login || '''' END,
      'account only ' || s_new || ' days old',
      CASE s_dev WHEN 'ssh' THEN 'single key in personal .ssh/ directory (likely accidental)'
        WHEN 'test' THEN 'key in test/fixture/example folder: ''' || file_path || ''''
        WHEN 'other' THEN 'file path matches normal dev pattern: ''' || file_path || '''' END,
      CASE WHEN s_pem THEN 'file has .pem extension (weak accidental signal)' END,
      'repo topic ''' || s_topic || ''' suggests research/CTF context'], lambda x: x IS NOT NULL), ' | ') AS signals
  FROM {name}_scored)"""


BASE = f"WITH {TABLES}, {DETECTION}, {FINDINGS}"
LABELLED = f"{BASE}, {labelled('listed', 'findings')}"
LABELLED_ALL = f"{BASE}, {labelled('all_listed', 'findings')}"
LEAKED = f"{LABELLED}, leaked AS (SELECT * FROM findings WHERE classification = 'LEAKED')"
