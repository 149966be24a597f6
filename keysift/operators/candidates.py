"""Optional phrase search that picks the files to visit, with an optional cap per search.

The default run visits every file.  With a search, a *visit* is a (query_ord, file)
pair; visits are processed in (query_ord, file_id) order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keysift.catalog import RULES, Rule
from keysift.functions.text import sql_text
from keysift.operators.skew import n_shares


def candidate_visits(files: DataFrame, secret_ids: Sequence[str] = ("ALL",), rules: Sequence[Rule] | None = None,
                     key: str = "file_id", content: str = "content") -> DataFrame:
    """(query_ord, secret_id, key) for every file holding all phrases of a requested search.

    Phrases ignore letter case.  Two rules with the same search text make one search.
    One narrow pass over the content.
    """
    return visits_of(files, requested_searches(secret_ids, rules), key, content)


def visits_of(files: DataFrame, searches: Sequence[tuple[int, Rule]], key: str = "file_id", content: str = "content") -> DataFrame:
    """``candidate_visits`` for numbered searches."""
    if not searches:
        return files.select(F.lit(0).alias("query_ord"), F.lit("").alias("secret_id"), key).where("false")
    checks = ", ".join(
        f"CASE WHEN {' AND '.join(f'contains(_lower, {sql_text(p.lower())})' for p in rule.phrases)} "
        f"THEN named_struct('query_ord', {i}, 'secret_id', {sql_text(rule.secret_id)}) END"
        for i, rule in searches)
    lowered = files.where(F.col(content).isNotNull()).select(key, F.lower(content).alias("_lower"))
    return (lowered.select(key, F.explode_outer(F.expr(f"array_compact(array({checks}))")).alias("q"))
            .where("q IS NOT NULL").select("q.query_ord", "q.secret_id", key))


def requested_searches(secret_ids: Sequence[str], rules: Sequence[Rule] | None = None) -> list[tuple[int, Rule]]:
    """The distinct searches for the requested rule ids, numbered in request order.

    A rule without a quoted phrase has no search and is skipped.
    """
    catalogue = {r.secret_id: r for r in rules or RULES}
    ids = list(catalogue) if len(secret_ids) == 1 and secret_ids[0].upper() == "ALL" else secret_ids
    distinct = {}
    for rule in (catalogue.get(i.upper()) for i in ids):
        if rule is not None and rule.phrases:
            distinct.setdefault(rule.search_query, rule)
    return list(enumerate(distinct.values(), 1))


def cap_visits(visits: DataFrame, max_results: int = 1000, key: str = "file_id") -> DataFrame:
    """Keep the first ``max_results`` visits of every search, in file order.

    A search may match most files, so the cut is made twice: first within hash buckets
    of the search, a few for each task, then among the few survivors.  The first N of a
    search are among the first N of their bucket, so the result is exact.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(n_shares(visits)))
    in_bucket = W.partitionBy("query_ord", "_bucket").orderBy(key)
    survivors = (visits.withColumn("_bucket", bucket).withColumn("_n", F.row_number().over(in_bucket))
                 .where(F.col("_n") <= max_results).drop("_n", "_bucket"))
    return (survivors.withColumn("_n", F.row_number().over(W.partitionBy("query_ord").orderBy(key)))
            .where(F.col("_n") <= max_results).drop("_n"))


def first_visits(visits: DataFrame, key: str = "file_id") -> DataFrame:
    """One row per visited file with the earliest search that reached it."""
    return visits.groupBy(key).agg(F.min("query_ord").alias("query_ord"))
