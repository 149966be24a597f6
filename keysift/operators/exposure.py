"""How many files of a corpus hold secrets: by any dimensions, by category, with all subtotals.

A file counts once for a category however many secrets it holds, and once as exposed at all.  Every file has one value
in each dimension, so these counts add up: they are taken at the finest level, in the scan that detects, with partial
counts, and all subtotals come from that small table.  No distinct count is needed, and a
source with a third of all files is one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.catalog import CATEGORIES, RULES, Rule
from keysift.functions.bind import computed_once
from keysift.functions.text import sql_text
from keysift.operators.detect import detect, rule_field

ANY = "any"


def exposure_counts(files: DataFrame, dimensions: Sequence[str], content: str = "content", rules: Sequence[Rule] | None = None) -> DataFrame:
    """dimensions, n_files, and per category (``any`` for all of them) the files that hold one."""
    names = list(dict.fromkeys([*CATEGORIES, *(r.category for r in rules or RULES)]))
    # Only the dimensions and the text are read.
    found = computed_once(detect(files.select(*dimensions, content), content, rules), {
        "_held": f"array_distinct(transform(secrets, s -> {rule_field('s.ord', 'category', rules)}))"})
    return found.groupBy(*dimensions).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.size("_held") > 0).alias(ANY),
        *(F.count_if(F.array_contains("_held", c)).alias(c) for c in names))


def exposure_rates(files: DataFrame, dimensions: Sequence[str] = ("lang", "source"), content: str = "content",
                   rules: Sequence[Rule] | None = None) -> DataFrame:
    """dimensions, level, category, n_files, n_exposed, rate for every combination of dimensions.

    ``level`` has a bit per dimension, the first one highest, set where the dimension is summed over; its column is
    null there.  ``category`` is ``any`` for files with a secret of any kind.  Categories without a file have rate 0.
    """
    counts = exposure_counts(files, dimensions, content, rules)
    categories = [c for c in counts.columns if c not in (*dimensions, "n_files")]
    sets = [list(kept) for n in range(len(dimensions) + 1) for kept in combinations(dimensions, n)]
    cubed = counts.groupingSets([[F.col(c) for c in kept] for kept in sets], *dimensions).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n_files").alias("n_files"), *(F.sum(c).alias(c) for c in categories))
    listed = ", ".join(f"named_struct('category', {sql_text(c)}, 'n_exposed', `{c}`)" for c in categories)
    # A corpus without files has no total either.
    return (cubed.where("n_files > 0").select(*dimensions, "level", "n_files", F.expr(f"inline(array({listed}))"))
            .select(*dimensions, "level", "category", "n_files", "n_exposed", (F.col("n_exposed") / F.col("n_files")).alias("rate")))
