"""String helpers that agree with Unicode-aware text handling."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysift.catalog import WHITESPACE

# Letters outside ASCII that equal an ASCII letter when case is ignored (dotted capital I,
# dotless i, long s, Kelvin sign).  Where one occurs, lower-casing is not a safe substitute
# for case-insensitive matching and the pattern itself must decide.
FOLDING_LETTERS = ["\u0130", "\u0131", "\u017f", "\u212a"]


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(text.contains(F.lit(w)) for w in words)


def sql_text(value: str) -> str:
    """A Python string as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_contains_any(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_text(w)})" for w in words) + ")"


_ENDS = rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, {sql_text(_ENDS)}, '')"


def non_empty(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))
