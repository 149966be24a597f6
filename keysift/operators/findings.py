"""From per-file detections to findings: de-duplication across files, key lists.

A fingerprint is *new* in the first file (in processing order) that holds it.  With
duplicates skipped, only files with a new fingerprint become findings and they list
just the new ones; otherwise every file with detections is a finding and lists its
new fingerprints, or all of them if none is new.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.operators.candidates import first_visits
from keysift.operators.detect import explode_secrets, with_secrets

KEY = "file_id"


def first_seen(rows: DataFrame, order: Sequence[str] = (KEY,)) -> DataFrame:
    """One row per distinct fingerprint of exploded detections: where it was seen first,
    with that file's columns.

    A single aggregation by fingerprint.  A value copied into a third of all files is
    reduced to one row per map task before the shuffle, and because the aggregate
    itself carries the winning row no join back to the detections is needed.  Rows are
    compared by their place alone, so the other columns may have any type.
    """
    rank = [*order, "ord", "pos"]
    rest = [c for c in rows.columns if c not in rank and c != "sha"]
    place = F.struct(*rank)
    firsts = rows.groupBy("sha").agg(F.min(place).alias("r"), F.min_by(F.struct(*rest), place).alias("f"))
    return firsts.select("r.*", "f.*", "sha")


def new_secrets_by_file(firsts: DataFrame, key: str = KEY) -> DataFrame:
    """One row per file with new fingerprints: its columns, and the new ones in detection order.

    The collected list is a part of what one file's own text held, never more.
    """
    rest = [c for c in firsts.columns if c not in (key, "ord", "pos", "sha", "sample")]
    return firsts.groupBy(key).agg(
        *(F.any_value(c).alias(c) for c in rest),
        F.array_sort(F.collect_list(F.struct("ord", "pos", "sha", "sample"))).alias("secrets"))


def findings(detected: DataFrame, skip_duplicates: bool = True, visits: DataFrame | None = None,
             only_new: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Findings without repository context: file columns, ``secrets``, ``key_count``, ``n_new``.

    ``visits`` (query_ord, file_id) restricts and orders the run as a search does; in
    default mode only the first visit of a file can bring anything new, without
    skipping duplicates every visit is a finding.  When duplicates are kept,
    ``detected`` is used twice, so pass a materialised frame.  ``only_new`` takes away
    the first-seen rows whose fingerprint is known from elsewhere, such as earlier runs.
    """
    detected, order = with_secrets(detected), [KEY]
    if visits is not None:
        detected, order = detected.join(first_visits(visits, KEY), KEY), ["query_ord", KEY]
    firsts = first_seen(explode_secrets(detected), order)
    new = new_secrets_by_file(only_new(firsts) if only_new else firsts)
    if skip_duplicates:
        return new.withColumns({"key_count": F.size("secrets"), "n_new": F.size("secrets")})

    joined = detected.join(new.select(KEY, F.col("secrets").alias("_new")), KEY, "left")
    listed = F.coalesce("_new", "secrets")
    out = joined.withColumns({"n_new": F.when(F.col("_new").isNull(), 0).otherwise(F.size("_new")),
                              "key_count": F.size(listed), "secrets": listed}).drop("_new")
    if visits is None:
        return out
    # Later visits of a file find nothing new and list everything the file holds.
    again = (visits.select("query_ord", KEY).join(detected.withColumnRenamed("query_ord", "_first"), KEY)
             .where("query_ord > _first").drop("_first")
             .withColumns({"n_new": F.lit(0), "key_count": F.size("secrets")}))
    return out.unionByName(again)
