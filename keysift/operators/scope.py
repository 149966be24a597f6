"""Scan targets: parsing target strings, resolving them, and restricting files to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.functions.bind import computed_once
from keysift.functions.text import sql_strip, sql_text
from keysift.operators.skew import spread_left_join, spread_semi_join

# Fixed values here and below: labels and error texts.
GLOBAL_LABEL = "Global scan (all of GitHub)"

# A name is letters, digits, underscore, dot and hyphen.
_NAME = r"\A[A-Za-z0-9_.\-]+\z"
_PAIR = r"\A[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+\z"
_HOSTS = ("", "github.com", "www.github.com")


def parse_targets(targets: DataFrame, raw: str = "raw") -> DataFrame:
    """Add raw_input, scope_type, name, search_qualifier, display_label and error.

    scope_type is global, repo, org (also for a user, until resolved) or invalid.
    Pure column expressions: any number of targets is parsed in one narrow pass.
    """
    text = computed_once(targets, {"raw_input": sql_strip(f"coalesce({raw}, '')")})
    # Tabs and line breaks inside a URL are ignored; a path ends at ? or # and its last
    # segment at ;
    url = computed_once(text, {"_url": """regexp_replace(
        if(startswith(raw_input, 'http://') OR startswith(raw_input, 'https://'), raw_input,
           concat('https://', raw_input)), '[\\\\t\\\\r\\\\n]', '')"""})
    split = computed_once(url, {
        "_host": "regexp_extract(_url, '^https?://([^/?#]*)', 1)",
        "_parts": """filter(split(regexp_replace(regexp_extract(_url, '^https?://[^/?#]*([^?#]*)', 1),
                            ';[^/]*$', ''), '/'), p -> p <> '')"""})
    first, second = "get(_parts, 0)", "get(_parts, 1)"
    kinds = computed_once(split, {"_kind": f"""CASE
        WHEN raw_input = '' THEN 'global'
        WHEN raw_input RLIKE {sql_text(_PAIR)} AND NOT contains(lower(raw_input), 'github.com') THEN 'bare_repo'
        WHEN raw_input RLIKE {sql_text(_NAME)} AND NOT contains(raw_input, '.') THEN 'bare_org'
        WHEN lower(_host) NOT IN {_HOSTS} THEN 'bad_host'
        WHEN size(_parts) = 0 THEN 'global'
        WHEN size(_parts) = 1 THEN if({first} RLIKE {sql_text(_NAME)}, 'org', 'bad_name')
        WHEN size(_parts) = 2 THEN if({first} RLIKE {sql_text(_NAME)} AND {second} RLIKE {sql_text(_NAME)},
                                      'repo', 'bad_repo')
        ELSE 'deep_repo' END"""})
    scoped = computed_once(kinds, {
        "scope_type": """CASE WHEN _kind = 'global' THEN 'global' WHEN startswith(_kind, 'bad') THEN 'invalid'
                         WHEN endswith(_kind, 'repo') THEN 'repo' ELSE 'org' END""",
        "name": f"""CASE WHEN _kind IN ('bare_repo', 'bare_org') THEN raw_input WHEN _kind = 'org' THEN {first}
                    WHEN _kind IN ('repo', 'deep_repo') THEN concat_ws('/', {first}, {second}) ELSE '' END"""})
    return scoped.selectExpr(
        "*", "if(scope_type IN ('org', 'repo'), concat(scope_type, ':', name), '') AS search_qualifier",
        f"""CASE scope_type WHEN 'global' THEN '{GLOBAL_LABEL}' WHEN 'org' THEN concat('Organisation / user: ', name)
            WHEN 'repo' THEN concat('Single repository: ', name,
                                    if(_kind = 'deep_repo', ' (truncated from longer URL)', ''))
            ELSE '' END AS display_label""",
        f"""CASE _kind WHEN 'bad_host' THEN concat('unsupported host: ', _host)
            WHEN 'bad_name' THEN concat('invalid name: ', {first})
            WHEN 'bad_repo' THEN concat('invalid repository: ', {first}, '/', {second}) END AS error"""
    ).drop("_url", "_host", "_parts", "_kind")


def resolve_targets(parsed: DataFrame, owners: DataFrame, repos: DataFrame) -> DataFrame:
    """Check targets against known owners and repositories; add ``verified``.

    A tentative org becomes a user where the owner is one; an unknown name makes the
    target invalid.  Names compare without letter case, as the code host does; of owners
    that differ in case alone the smallest id counts.  Each kind of target meets its own
    table, so none has an empty key, and no target is lost or doubled.
    """
    known = owners.groupBy(F.lower("owner_login").alias("_key")).agg(
        F.min_by("owner_type", "owner_id").alias("owner_type"),
        F.min_by("owner_public_repos", "owner_id").alias("owner_public_repos"), F.lit(True).alias("_found"))
    names = repos.select(F.lower("repo_name").alias("_key")).distinct().select(
        "_key", F.lit(None).cast("string").alias("owner_type"), F.lit(None).cast("int").alias("owner_public_repos"),
        F.lit(True).alias("_found"))
    keyed = parsed.withColumn("_key", F.lower("name"))
    others = keyed.where("scope_type NOT IN ('org', 'repo')").selectExpr(
        "*", "cast(null AS string) AS owner_type", "cast(null AS int) AS owner_public_repos", "cast(null AS boolean) AS _found")
    joined = others
    for kind, table in (("org", known), ("repo", names)):
        joined = joined.unionByName(keyed.where(F.col("scope_type") == kind).join(table, "_key", "left"))
    checked = computed_once(joined, {"_kind": """CASE
        WHEN scope_type IN ('org', 'repo') AND _found IS NULL THEN 'invalid'
        WHEN scope_type = 'org' AND owner_type <> 'Organization' THEN 'user' ELSE scope_type END"""})
    count = "coalesce(string(owner_public_repos), '?')"
    new = {
        "scope_type": "_kind",
        "search_qualifier": "if(_kind IN ('org', 'user', 'repo'), concat(_kind, ':', name), '')",
        "display_label": f"""CASE _kind
            WHEN 'org' THEN concat('Organisation: ', name, ' (', {count}, ' public repos)')
            WHEN 'user' THEN concat('User: ', name, ' (', {count}, ' public repos)')
            WHEN 'invalid' THEN '' ELSE display_label END""",
        "error": """CASE WHEN _kind <> 'invalid' OR scope_type = 'invalid' THEN error
            WHEN scope_type = 'org' THEN concat('neither org nor user: ', name) ELSE concat('not found: ', name) END""",
        "verified": "_kind <> 'invalid'"}
    kept = [c for c in parsed.columns if c not in new]
    return checked.selectExpr(*kept, *(f"{sql} AS {name}" for name, sql in new.items()))


def scoped_repo_ids(scopes: DataFrame, repos: DataFrame, owners: DataFrame) -> DataFrame:
    """repo_id of every repository inside any org, user or repo scope; global ones add none.

    Owners are found by name first, then their repositories by id, so that one owner of
    very many repositories is spread; repositories named themselves are added.
    """
    of_owner = scopes.where("scope_type IN ('org', 'user')").select(F.lower("name").alias("_name")).distinct()
    of_repo = scopes.where("scope_type = 'repo'").select(F.lower("name").alias("_name")).distinct()
    owner_ids = owners.select("owner_id", F.lower("owner_login").alias("_name")).join(of_owner, "_name", "left_semi")
    owned = spread_semi_join(repos.select("repo_id", "owner_id"), owner_ids.select("owner_id").distinct(), "owner_id", "repo_id")
    named = repos.select("repo_id", F.lower("repo_name").alias("_name")).join(of_repo, "_name", "left_semi")
    return owned.select("repo_id").unionByName(named.select("repo_id")).distinct()


def restrict(rows: DataFrame, scopes: DataFrame, repos: DataFrame, owners: DataFrame, spread_by: str = "file_id") -> DataFrame:
    """Rows (files, or better detections) of repositories inside the scopes.

    One global scope is no restriction at all: every row stays, those without a
    repository included.  ``rows`` is read twice and ``scopes`` three times.
    """
    ids = scoped_repo_ids(scopes, repos, owners).withColumn("_in", F.lit(True))
    everywhere = scopes.agg(F.coalesce(F.bool_or(F.col("scope_type") == "global"), F.lit(False))).scalar()
    marked = spread_left_join(rows, ids, "repo_id", spread_by)
    return marked.where(F.coalesce("_in", F.lit(False)) | everywhere).drop("_in")
