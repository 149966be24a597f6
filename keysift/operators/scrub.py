"""Scrubbing: texts with every detected secret cut out.

A detected match of any rule is a span of its text, every occurrence of it too.  Spans of different rules
overlap (a client secret is also an assignment, a token is part of a URL), so they are merged before the text is
rewritten; what is left holds no part of any of them.

Everything happens inside the row, in built-in expressions: a text that needs no rewriting is returned as it
is, no text is shuffled, and places are counted in bytes so that a cut costs the length of what it
returns.  Spans are gathered in pieces of ``CHUNK``, because an array is copied whenever it grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.catalog import RULES, Rule, anchors_of, jvm_pattern
from keysift.functions.bind import computed_once
from keysift.functions.text import FOLDING_LETTERS, sql_contains_any, sql_text
from keysift.operators.detect import anchored_sql, fits_sql, possible_sql, value_sql
from keysift.plans.durable import materialise

# Holds a blank and a semicolon and is shorter than any secret, so no rule matches across it and no match grows by it.
MARKER = "[secret; removed]"
CHUNK = 256
_SPAN = "struct<start:int,stop:int>"


def scrub(files: DataFrame, content: str = "content", rules: Sequence[Rule] | None = None, marker: str = MARKER) -> DataFrame:
    """``files`` with secrets in ``content`` replaced by ``marker``, and ``n_spans``, the places that were cut.

    Detection decides what is a secret: its anchors, patterns and length limits.  A null text stays null, a text
    without secrets stays as it is.  Columns named ``n_spans`` are replaced.
    """
    rules = list(rules or RULES)
    keep = [c for c in files.columns if c not in (content, "n_spans")]
    lowered = computed_once(files.select(*keep, content), {
        "_lower": f"lower({content})", "_fold": sql_contains_any(content, FOLDING_LETTERS)})
    found = computed_once(lowered, {"_found": f"flatten(array({', '.join(_gaps(r, content) for r in rules)}))"})
    anchored = anchored_sql(content, "_lower", "_fold", anchors_of(rules))
    spans = computed_once(found, {
        "_spans": f"CASE WHEN size(_found) > 0 AND {anchored} THEN {_merged(_placed('_found'))} END"})
    bound = computed_once(spans.select(*keep, content, "_spans"), {
        "_cut": f"""CASE WHEN size(_spans) > 0 THEN transform(array(cast({content} as binary)), b -> array_join(concat(
            transform(_spans, (s, i) -> concat(
                decode(substring(b, coalesce(get(_spans, i - 1).stop, 0) + 1, s.start - coalesce(get(_spans, i - 1).stop, 0)), 'UTF-8'),
                {sql_text(marker)})),
            array(decode(substring(b, element_at(_spans, -1).stop + 1, octet_length(b)), 'UTF-8'))), ''))[0] ELSE {content} END"""})
    cleaned = bound.select(*keep, F.col("_cut").alias(content), F.greatest(F.coalesce(F.size("_spans"), F.lit(0)), F.lit(0)).alias("n_spans"))
    return cleaned.select(*(c for c in files.columns if c != "n_spans"), "n_spans")


def scrub_until_clean(files: DataFrame, content: str = "content", rules: Sequence[Rule] | None = None, marker: str = MARKER,
                      most: int = 5) -> DataFrame:
    """``scrub`` repeated until nothing is found any more, ``n_spans`` being all cuts.

    A match that is too short to be a secret hides another of its rule that overlaps it, which shows once
    a different rule has cut into it.  Each pass is written down; the second one usually finds nothing.
    """
    out = materialise(scrub(files, content, rules, marker), name="scrubbed")
    for _ in range(most - 1):
        again = materialise(scrub(out.withColumnRenamed("n_spans", "_cuts"), content, rules, marker), name="scrubbed")
        out = again.withColumn("n_spans", F.col("n_spans") + F.col("_cuts")).drop("_cuts")
        if again.where("n_spans > 0").isEmpty():
            return out
    return out


def _gaps(rule: Rule, content: str) -> str:
    """SQL: for every match of a rule the bytes before it, its own bytes, and whether it counts.

    What a pattern splits a text into are the gaps between its matches.
    """
    pattern = sql_text(jvm_pattern(rule.pattern, rule.flags))
    listed = f"""transform(array(named_struct('p', split({content}, {pattern}, -1), 'ms', regexp_extract_all({content}, {pattern}, 0))),
        z -> transform(z.ms, (m, i) -> named_struct('first', i = 0, 'gap', octet_length(get(z.p, i)), 'len', octet_length(m),
                                                    'fits', {fits_sql(rule, value_sql(rule))})))[0]"""
    kind = "array<struct<first:boolean,gap:int,len:int,fits:boolean>>"
    return f"CASE WHEN {possible_sql(rule, content)} THEN {listed} ELSE cast(array() AS {kind}) END"


def _gather(items: str, start: str, step: str, span: str, when: str, last: str = "null") -> str:
    """SQL: a fold over ``items`` that emits ``span`` where ``when`` holds, with ``acc`` the folded state and ``x`` the item."""
    empty, many = f"cast(array() AS array<{_SPAN}>)", f"cast(array() AS array<array<{_SPAN}>>)"
    full = f"size(acc.cur) >= {CHUNK}"
    return f"""aggregate({items}, named_struct('s', {start}, 'done', {many}, 'cur', {empty}),
        (acc, x) -> named_struct('s', {step},
            'done', CASE WHEN {when} AND {full} THEN concat(acc.done, array(acc.cur)) ELSE acc.done END,
            'cur', CASE WHEN NOT ({when}) THEN acc.cur WHEN {full} THEN array({span}) ELSE concat(acc.cur, array({span})) END),
        acc -> concat(flatten(acc.done), acc.cur{last}))"""


def _placed(found: str) -> str:
    """SQL: spans of the matches that count, in order of their places."""
    at = "if(x.first, 0, acc.s) + x.gap"
    span = f"named_struct('start', {at}, 'stop', {at} + x.len)"
    return f"array_sort({_gather(found, '0', f'{at} + x.len', span, 'x.fits', '')})"


def _merged(spans: str) -> str:
    """SQL: the union of sorted spans; those that overlap or touch become one."""
    start = f"cast(null AS {_SPAN})"
    joins = "(acc.s IS NOT NULL AND x.start <= acc.s.stop)"
    step = f"CASE WHEN {joins} THEN named_struct('start', acc.s.start, 'stop', greatest(acc.s.stop, x.stop)) ELSE x END"
    emits = f"(acc.s IS NOT NULL AND NOT {joins})"
    return _gather(spans, start, step, "acc.s", emits, f", CASE WHEN acc.s IS NULL THEN cast(array() AS array<{_SPAN}>) ELSE array(acc.s) END")
