"""Bloom filters of DataFrame functions: a small side turns rows of a large one away before they are shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 3
BITS_PER_KEY = 8
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 23


def bits_for(n_keys: int) -> int | None:
    """A power of two; none where the keys are too many for a filter of bounded size to be of use."""
    bits = LEAST_BITS
    while bits < n_keys * BITS_PER_KEY:
        bits *= 2
    return bits if bits <= MOST_BITS else None


def _places(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(k)).bitwiseAND(F.lit(bits - 1)) for k in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str, bits: int) -> Column:
    """A scalar for the plan that uses it: an array of ``bits / 64`` longs, one megabyte at most."""
    places = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    longs = places.select(F.shiftright("p", 6).alias("id"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    filled = longs.groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(bits // 64, numPartitions=1).join(F.broadcast(filled), "id", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    return listed.select(F.col("all.bits").alias("bits")).scalar()


def may_hold(bloom: Column, key: Column, bits: int) -> Column:
    """False only for keys that the filter was not made of."""
    def tested(place: Column) -> Column:
        word = F.get(bloom, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return reduce(lambda a, b: a & b, map(tested, _places(key, bits)))
