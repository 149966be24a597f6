"""Packing with optimal length buckets.

Sequences are padded to the length of their bucket and batched under a token budget.
The lengths of the whole corpus are counted into one histogram, dynamic programming
over it finds the bucket boundaries with the least padding, and batches are filled
inside each bucket.

Documents longer than the longest sequence are cut into consecutive pieces, so the
histogram has at most ``max_len`` rows whatever the corpus: that bounded table is all
the driver sees.  Places inside a bucket come from counting: a bucket is dealt to parts
by hash, rows are numbered inside their part and shifted by the sizes of the parts
before, so that no task orders a whole bucket and every batch but a bucket's last is full.

Sequences carry their token ids where these are given, as bytes of a fixed width per id; a loader pads them to the
bucket's length.

Defined cases.  A null or empty text is one sequence holding the end token alone.  Rows
repeated with the same id are packed each, in an order that only tells them apart by
id and piece.  No rows give no rows.  Texts of any length are cut, none is shortened.  Columns other than those named are
not read, so extra ones may have any name.  Fewer distinct lengths than buckets give one
bucket per length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.plans.durable import materialise

MAX_LEN = 8192
N_BUCKETS = 32
TOKEN_BUDGET = 65_536
# The end token of the byte vocabulary: a byte that UTF-8 never uses.
END_BYTE = b"\xff"


def optimal_boundaries(lengths: Sequence[int], counts: Sequence[int], n_buckets: int) -> list[int]:
    """Bucket lengths, ascending, that minimise padding over a histogram.

    ``lengths`` ascend and are distinct.  ``best[j]`` is the least total of padded tokens
    for the first j lengths; the last bucket (i, j] costs ``lengths[j-1] * (rows in it)``.
    The best split i never moves left as j grows, so each row of the table is filled by
    halving the range of j, and for one j all splits are tried in one array operation.
    """
    n = len(lengths)
    if n <= n_buckets:
        return [int(x) for x in lengths]
    length = np.asarray(lengths, dtype=np.float64)
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    best = np.concatenate([[0.0], length * rows[1:]])
    splits = []
    for k in range(2, n_buckets + 1):
        new, split = best.copy(), np.zeros(n + 1, dtype=np.int64)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + length[j - 1] * (rows[j] - rows[i])
            at = int(np.argmin(cost))
            new[j], split[j] = cost[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        best = new
        splits.append(split)
    ends, j = [], n
    for split in reversed(splits):
        ends.append(j)
        j = int(split[j])
    return [int(lengths[e - 1]) for e in reversed([*ends, j]) if e > 0]


def byte_tokens(text: Column) -> Column:
    """Tokens of a text under a byte vocabulary: its UTF-8 bytes and an end token."""
    return (F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) + 1).cast("long")


def byte_ids(text: Column) -> Column:
    """Ids of a text under a byte vocabulary, one byte each: its UTF-8 bytes and the end token."""
    return F.concat(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), F.lit(END_BYTE))


def pack(docs: DataFrame, n_tokens: Column, id_col: str = "doc_id", max_len: int = MAX_LEN,
         n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET, ids: Column | None = None, id_bytes: int = 1) -> DataFrame:
    """One row per sequence: doc_id, piece, n_tokens, bucket_len, batch_id, place, and ``ids`` where given.

    ``ids`` is binary, ``id_bytes`` bytes for each of the ``n_tokens`` ids of a document; a sequence gets its own part.

    ``batch_id`` is unique over all buckets; ``bucket_len`` times the rows of a batch is
    at most ``token_budget`` (a bucket longer than the budget has batches of one row).
    """
    spark = docs.sparkSession
    whole = [] if ids is None else [ids.alias("ids")]
    counted = docs.select(F.col(id_col).alias("doc_id"), n_tokens.alias("total"), *whole)
    last = F.floor((F.greatest("total", F.lit(1)) - 1) / F.lit(max_len)).cast("int")
    piece = F.explode(F.sequence(F.lit(0), last))
    own = [] if ids is None else [F.substring(F.col("ids"), F.col("piece") * F.lit(max_len * id_bytes) + 1, F.lit(max_len * id_bytes)).alias("ids")]
    pieces = counted.select("*", piece.alias("piece")).select("doc_id", "piece", F.least(
        F.lit(max_len), F.col("total") - F.col("piece") * F.lit(max_len)).cast("int").alias("n_tokens"), *own)
    pieces = materialise(pieces, name="sequences")

    histogram = sorted((r["n_tokens"], r["n"]) for r in  # at most max_len rows
                       pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    bounds = optimal_boundaries([a for a, _ in histogram], [b for _, b in histogram], n_buckets) or [1]
    in_bucket = np.zeros(len(bounds), dtype=np.int64)
    np.add.at(in_bucket, np.searchsorted(bounds, [a for a, _ in histogram]), [b for _, b in histogram])
    share = max(64, -(-int(in_bucket.sum()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))

    ends = F.array(*map(F.lit, bounds))
    parts = F.array(*(F.lit(max(1, -(-int(n) // share))) for n in in_bucket))
    bucket = F.size(F.filter(ends, lambda e: e < F.col("n_tokens")))
    rows = pieces.withColumn("bucket", bucket).withColumn("part", F.pmod(
        F.xxhash64("doc_id", "piece"), F.element_at(parts, F.col("bucket") + 1)).cast("int"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("bucket", "part").agg(F.count("*").alias("n")).select(
        "bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    numbered = rows.withColumn("at", F.row_number().over(
        Window.partitionBy("bucket", "part").orderBy("doc_id", "piece")) - 1)
    # At most 4 * shuffle partitions + n_buckets parts, so the offsets have a bound.
    at = F.col("at") + F.col("offset")
    length = F.element_at(ends, F.col("bucket") + 1)
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / length)).cast("long")
    return numbered.join(F.broadcast(offsets), ["bucket", "part"]).select(
        "doc_id", "piece", "n_tokens", length.alias("bucket_len"),
        (F.col("bucket").cast("long") * F.lit(1 << 40) + F.floor(at / capacity)).alias("batch_id"),
        (at % capacity).cast("int").alias("place"), *([] if ids is None else ["ids"]))
