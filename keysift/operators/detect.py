"""Detection: from a table of file contents to fingerprints of the secrets in them.

The whole step is one narrow pass over the content column: no shuffle, no Python
worker, and content leaves the plan right here.  Per file it yields an array that
is smaller than the text it came from, so nothing grows beyond the input row.

Privacy: only a SHA-256 fingerprint and a four-character sample of a match leave
this module; neither the match nor the content does.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.catalog import ANCHORS, CATEGORIES, PEM_HEADER, RULES, Rule, anchors_of, jvm_pattern
from keysift.functions.bind import computed_once
from keysift.functions.text import FOLDING_LETTERS, sql_contains_any, sql_strip, sql_text

# ord: rule position; pos: position among the rule's distinct matches in the file.
SECRET_TYPE = "array<struct<ord:int,pos:int,sha:string,sample:string>>"
_HIT_TYPE = "array<struct<sha:string,ord:int,pos:int,sample:string>>"


def contains_secret(content: str = "content", anchors: Sequence[str] = ANCHORS) -> Column:
    """True when any anchor occurs, in any letter case; false for null or empty text."""
    fold = sql_contains_any(content, FOLDING_LETTERS)
    # exists() over a one-element array binds the lower-cased text once.
    return F.expr(f"coalesce(exists(array(lower({content})), t -> {anchored_sql(content, 't', fold, anchors)}), false)")


def pem_header_count(content: str = "content") -> Column:
    """Number of private-key headers, closed or not, repeated ones included."""
    return F.expr(f"coalesce({_pem_headers(content)}, 0)")


def detect(files: DataFrame, content: str = "content", rules: Sequence[Rule] | None = None,
           anchors: Sequence[str] | None = None) -> DataFrame:
    """Replace ``content`` by ``secrets`` and ``pem_headers``; keep every other column and row.

    ``secrets`` lists each distinct fingerprint of the file once (first rule, then
    first position wins) in (ord, pos) order.  The anchors are the built-in ones and
    those of the rules, unless given.
    """
    anchors = anchors_of(rules) if anchors is None else anchors
    keep = [c for c in files.columns if c != content]

    # Lower-case once; cheap literal look-ups then decide which patterns run at all.
    lowered = files.select(*keep, content, F.lower(content).alias("_lower"),
                           F.expr(sql_contains_any(content, FOLDING_LETTERS)).alias("_fold"))
    hits = ",\n".join(_rule_hits(i, r, content) for i, r in enumerate(rules or RULES, 1))
    found = lowered.select(*keep, content, "_lower", "_fold", F.expr(f"flatten(array({hits}))").alias("_found"))
    # The pre-screen only matters where something was found, so it is looked up there alone.
    # Sorted by fingerprint, copies are neighbours: in-file dedup without leaving the row.
    ordered = found.select(
        *keep,
        F.expr(f"""CASE WHEN size(_found) = 0 OR NOT {anchored_sql(content, '_lower', '_fold', anchors)} THEN null
                        WHEN size(_found) = 1 THEN _found ELSE array_sort(_found) END""").alias("_hits"),
        F.expr(f"""coalesce(CASE WHEN _fold THEN {_pem_headers(content)}
                        WHEN contains(_lower, 'private key') THEN {_pem_headers_in_lower('_lower')}
                        ELSE 0 END, 0)""").alias("pem_headers"))
    listed = """coalesce(array_sort(transform(
        filter(_hits, (x, i) -> i = 0 OR x.sha <> get(_hits, i - 1).sha),
        x -> named_struct('ord', x.ord, 'pos', x.pos, 'sha', x.sha, 'sample', x.sample))),
        cast(array() AS """ + SECRET_TYPE + "))"
    # Later filters on the result must not repeat the patterns below them.
    return computed_once(ordered, {"secrets": listed}).select(*keep, "secrets", "pem_headers")


def with_secrets(detected: DataFrame) -> DataFrame:
    """Only files in which something was found."""
    return detected.where(F.size("secrets") > 0)


def explode_secrets(detected: DataFrame) -> DataFrame:
    """One row per (file, fingerprint)."""
    others = [c for c in detected.columns if c != "secrets"]
    return (detected.select(*others, F.explode("secrets").alias("s"))
            .select(*others, "s.ord", "s.pos", "s.sha", "s.sample"))


def rule_field(ord_sql: str, field: str, rules: Sequence[Rule] | None = None) -> str:
    """SQL for a rule attribute by rule position: a literal look-up, no join."""
    return f"element_at(array({', '.join(sql_text(getattr(r, field)) for r in rules or RULES)}), {ord_sql})"


def detections(files: DataFrame, content: str = "content", rules: Sequence[Rule] | None = None,
               anchors: Sequence[str] | None = None) -> DataFrame:
    """The flat detection table: one row per file and distinct fingerprint."""
    return describe(explode_secrets(detect(files, content, rules, anchors)), rules)


def describe(rows: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Spell out (ord, sha, sample) rows as reported detections."""
    others = [c for c in rows.columns if c not in ("ord", "pos", "sha", "sample", "pem_headers")]
    category = rule_field("ord", "category", rules)
    return rows.select(
        *others, "ord", "pos", F.expr(rule_field("ord", "secret_id", rules)).alias("secret_id"),
        F.expr(category).alias("category"), F.expr(rule_field("ord", "label", rules)).alias("label"),
        F.col("sha").alias("sha256_fingerprint"), F.expr(rule_field("ord", "confidence", rules)).alias("confidence"),
        F.col("sample").alias("redacted_sample"), F.expr(f"{category} = 'private_key'").alias("is_pem_block"))


def group_by_category(detected: DataFrame, key: str = "file_id", rules: Sequence[Rule] | None = None) -> DataFrame:
    """Per file and category: how many secrets and which, in detection order.

    Works inside each file's own array, so no shuffle is needed.
    """
    category, secret_id = rule_field("s.ord", "category", rules), rule_field("s.ord", "secret_id", rules)
    names = ", ".join(sql_text(c) for c in dict.fromkeys([*CATEGORIES, *(r.category for r in rules or RULES)]))
    groups = f"""transform(array({names}), c -> named_struct('category', c,
        'secret_ids', transform(filter(secrets, s -> {category} = c), s -> {secret_id})))"""
    return (detected.select(key, F.explode_outer(F.expr(groups)).alias("g"))
            .select(key, "g.category", F.size("g.secret_ids").alias("n_secrets"), "g.secret_ids")
            .where("n_secrets > 0"))


def match_counts(files: DataFrame, key: str = "file_id", content: str = "content",
                 rules: Sequence[Rule] | None = None) -> DataFrame:
    """Per file and rule: matches (repeats included), and those within the length limits."""
    lowered = files.where(contains_secret(content, anchors_of(rules))).select(
        key, content, F.lower(content).alias("_lower"),
        F.expr(sql_contains_any(content, FOLDING_LETTERS)).alias("_fold"))
    counts = []
    for i, rule in enumerate(rules or RULES, 1):
        matches = f"regexp_extract_all({content}, {sql_text(jvm_pattern(rule.pattern, rule.flags))}, 0)"
        counts.append(f"""CASE WHEN {possible_sql(rule, content)} THEN transform(array({matches}),
            ms -> named_struct('ord', {i}, 'n_matches', size(ms),
                               'n_fitting', size(filter(ms, m -> {fits_sql(rule, value_sql(rule))}))))[0] END""")
    return (lowered.select(key, F.explode_outer(F.expr(f"array({', '.join(counts)})")).alias("c"))
            .where("c.n_matches > 0")
            .select(key, "c.ord", F.expr(rule_field("c.ord", "secret_id", rules)).alias("secret_id"),
                    "c.n_matches", "c.n_fitting"))


def count_by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("secret_id", "confidence").agg(F.count("*").alias("n_detections"))


def _rule_hits(ord_: int, rule: Rule, content: str) -> str:
    """SQL for all distinct matches of one rule that pass its length limits."""
    pattern = sql_text(jvm_pattern(rule.pattern, rule.flags))
    found = f"""transform(
        filter(transform(array_distinct(regexp_extract_all({content}, {pattern}, 0)),
                         m -> named_struct('m', m, 'v', {value_sql(rule)})), x -> {fits_sql(rule, 'x.v')}),
        (x, i) -> named_struct('sha', sha2(x.m, 256), 'ord', {ord_}, 'pos', i, 'sample',
            if(length(x.v) >= 4, concat(substr(x.v, 1, 4), '****'), '****')))"""
    return f"CASE WHEN {possible_sql(rule, content)} THEN {found} ELSE cast(array() AS {_HIT_TYPE}) END"


def value_sql(rule: Rule) -> str:
    """SQL of the value inside a match ``m``: re-read from the short match, not from the text."""
    pattern = sql_text(jvm_pattern(rule.pattern, rule.flags))
    return sql_strip("m" if rule.whole else f"regexp_extract(m, {pattern}, 1)")


def fits_sql(rule: Rule, value: str) -> str:
    upper = f" AND length({value}) <= {rule.max_length}" if rule.max_length else ""
    return f"length({value}) >= {rule.min_length}{upper}"


def possible_sql(rule: Rule, content: str) -> str:
    """SQL telling whether a rule's necessary literals all occur."""
    if not rule.needs:
        return "true"
    if "i" not in rule.flags:
        return " AND ".join(sql_contains_any(content, any_) for any_ in rule.needs)
    return "_fold OR (" + " AND ".join(sql_contains_any("_lower", any_) for any_ in rule.needs) + ")"


def anchored_sql(content: str, lower: str, fold: str, anchors: Sequence[str]) -> str:
    """SQL of the pre-screen: literal look-ups, or the pattern where folding letters occur."""
    pattern = jvm_pattern("|".join(re.escape(a) for a in anchors), "i")
    # The shortest anchors are by far the most common in any text, so they go first.
    literals = sorted(dict.fromkeys(a.lower() for a in anchors), key=len)
    return f"""(CASE WHEN {fold} THEN {content} RLIKE {sql_text(pattern)}
                ELSE {sql_contains_any(lower, literals)} END)"""


def _pem_headers(content: str) -> str:
    return f"regexp_count({content}, {sql_text(jvm_pattern(PEM_HEADER, 'i'))})"


def _pem_headers_in_lower(lower: str) -> str:
    return f"regexp_count({lower}, {sql_text(PEM_HEADER.lower())})"
