"""Left joins whose many side may hold a third of its rows under one key, or under none.

Rows without a key match nothing, and an ordinary join would still send all of them to
one task; they are dealt out by a hash.  A hot key is one with more rows than a quarter
of a task's share.  There are at most ``4 * shuffle partitions`` of those whatever the
size of the input, so the list of them is broadcast; their rows are dealt to as many parts
as their size asks for, and only the matching rows of the other side are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES_PER_TASK = 4


def n_shares(df: DataFrame) -> int:
    return SHARES_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_rows): one row per key with map-side partial counts; null keys are left out."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).dropna(subset=list(keys))


def hot_keys(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_parts) of the keys in ``counts`` (keys, n_rows) above a share; at most ``n_shares`` rows.

    Lazy: the total is a subquery of the plan that uses the result.
    """
    share = F.greatest(F.lit(1.0), counts.agg(F.sum("n_rows")).scalar() / n_shares(counts))
    return counts.where(F.col("n_rows") > share).select(*keys, F.ceil(F.col("n_rows") / share).cast("int").alias("n_parts"))


def spread_left_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], spread_by: str,
                     counts: DataFrame | None = None) -> DataFrame:
    """``left`` LEFT JOIN ``right`` USING (keys); ``right`` has each key once.

    ``left`` is read twice, for its keys alone the first time; give ``counts`` (keys,
    n_rows) where they are known.  Nothing is dropped or doubled.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = F.broadcast(hot_keys(counts if counts is not None else key_counts(left, keys), keys))
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    n_parts = F.when(missing, F.lit(n_shares(left))).otherwise(F.coalesce("n_parts", F.lit(1)))
    dealt = left.join(hot, keys, "left").withColumn(
        "_part", F.pmod(F.xxhash64(spread_by), n_parts).cast("int")).drop("n_parts")
    repeated = right.join(hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("n_parts", F.lit(1)) - 1))).drop("n_parts")
    return dealt.join(repeated, [*keys, "_part"], "left").drop("_part")


def spread_semi_join(left: DataFrame, ids: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Rows of ``left`` whose key is among the distinct ``ids``."""
    marked = spread_left_join(left, ids.withColumn("_in", F.lit(True)), key, spread_by)
    return marked.where("_in").drop("_in")
