"""Exact de-duplication by sorting contents.

Texts without white space are range-partitioned by splitters that Spark samples from
them, sorted within their range (spilling where needed), and compared in full with
their neighbours: a window over the sorted rows starts a new group where the text
changes.  Splitters reach the driver, so ranges are cut by a text's first characters and
a digest that parts longer common beginnings, not by whole texts.  DataFrame functions throughout; two exchanges, of which one moves texts.

A text with more copies than a quarter of a task's share is dealt to several pieces by
a hash of its id, which is part of the sort key.  At most ``4 * shuffle partitions``
texts can be that frequent, so that list has a bound and is broadcast; their pieces are
joined afterwards by comparing one text per piece.

Defined cases.  A null text counts as empty and all texts of white space alone are
equal.  Ties in length go to the smaller id, null ids last.  Rows repeated with the
same id and text are one group and only one of them is kept.  No rows give no rows.
Only the two named columns are read, so further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.llm.names import unused
from keysift.plans.durable import materialise

# Fixed value: the characters that normalisation deletes.
WHITE_SPACE = " \t\n\x0b\x0c\r"
SPLITTER_CHARS = 32


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), squeezed(F.col(text_col)).alias("content"),
                       F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).alias("n_points"))
    rows = rows.withColumn("digest", F.xxhash64("content"))

    share = max(1, docs.count() // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counts = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    frequent = counts.where(F.col("copies") > share).select(
        "digest", F.ceil(F.col("copies") / share).cast("int").alias("pieces"))
    dealt = rows.join(F.broadcast(frequent), "digest", "left").withColumn(
        "piece", F.when(F.col("pieces").isNull(), -1).otherwise(
            F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("pieces"))).cast("int"))

    key = ["beginning", "digest", "piece"]
    neighbours = Window.partitionBy(*key, "content").orderBy(F.desc("n_points"), F.asc_nulls_last("doc_id"))
    whole = neighbours.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranged = dealt.select("doc_id", "content", "n_points", "digest", "piece", F.substring(
        "content", 1, SPLITTER_CHARS).alias("beginning")).repartitionByRange(*key)
    compared = ranged.select(
        "doc_id", "content", "piece", F.row_number().over(neighbours).alias("place"),
        F.first("doc_id").over(whole).alias("head_id"), F.first("n_points").over(whole).alias("head_points"),
        F.count(F.lit(1)).over(whole).alias("n"))
    split = F.col("piece") >= 0
    runs = materialise(compared.select(
        "doc_id", F.sha2("content", 256).alias("text_sha256"), "place", "head_id", "head_points", "n",
        split.alias("split"), F.when(split & (F.col("place") == 1), F.col("content")).alias("piece_text")), name="runs")

    best = F.max_by(F.col("head_id"), F.struct("head_points", (-F.col("head_id")).alias("o")))
    joined = (runs.where("piece_text IS NOT NULL").groupBy("piece_text")
              .agg(best.alias("whole_id"), F.sum("n").alias("whole_n"))
              .select(F.sha2("piece_text", 256).alias("text_sha256"), "whole_id", "whole_n", F.lit(True).alias("split")))
    merged = runs.join(F.broadcast(joined), ["text_sha256", "split"], "left")  # bounded as `frequent` is
    keep = F.when(F.col("split"), F.col("whole_id")).otherwise(F.col("head_id"))
    return merged.select(
        "doc_id", keep.alias("keep_id"),
        F.when(F.col("split"), F.col("whole_n")).otherwise(F.col("n")).alias("group_size"),
        ((F.col("place") == 1) & keep.eqNullSafe(F.col("doc_id"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, all columns kept.

    Decisions are by id, so ids should be unique.  Where one id stands on several rows,
    rows with equal id and text become one, and rows with the same id and other texts
    stay as long as one of them is kept.
    """
    kept_id = unused(docs.columns, "kept_id")
    kept = content_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    stay = docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    return stay.dropDuplicates([id_col, text_col])
