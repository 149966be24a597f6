"""A contains join: a table of rules, thousands of them, with the files that hold all phrases of a rule.

Testing every rule on every text costs rules times text.  Here each rule is met by its *anchor*, the gram of
its phrases that occurs least: the grams of a text are enumerated once however many rules there are, those
that are no anchor are turned away by a table of marks before anything is shuffled, the rest join the anchors by equality, and
all phrases are verified on the texts of the pairs this leaves.  The first of two passes over the texts counts the grams.

A phrase is cut into grams of the largest size in ``SIZES`` that it has, in bytes of UTF-8.  A gram is known by a 64-bit
hash, so that numpy takes all grams of a slice of a batch at a time; equal hashes of unequal grams cost a look at a
text and no row.  (In built-in functions every gram is a string: 3,800 CPU seconds a GB, most of them for strings.)
The marks are ``1 << LOG_SLOTS`` bits at any number of rules; they let more pass as they fill, and the join decides.

Defined cases.  Letter case is ignored.  Null and empty phrases say nothing; a rule without others matches no file.  A
null content matches nothing.  Rows that repeat a rule's id with equal phrases count once; the id and phrases together name a rule.
Hot grams are dealt to several tasks.  Contents of any length are read whole, in slices.  Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.operators.skew import spread_left_join
from keysift.plans.durable import materialise

SIZES = (16, 8, 4, 3, 2, 1)
SLICE = 1 << 19
LOG_SLOTS = 22

Batches = Iterator[pa.RecordBatch]


def rule_matches(files: DataFrame, rules: DataFrame, key: str = "file_id", content: str = "content", rule_id: str = "rule_id",
                 phrases: str = "phrases") -> DataFrame:
    """(rule_id, key) for every file holding all phrases of a rule; ``rules`` has an id and an array of phrases."""
    lowered = F.filter(F.transform(F.col(phrases), F.lower), lambda p: p != "")
    listed = rules.select(F.col(rule_id).alias("rule_id"), F.array_sort(F.array_distinct(lowered)).alias("phrases"))
    listed = materialise(listed.where(F.size("phrases") > 0).distinct(), name="rules")
    texts = files.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.lower(content).alias("text"))

    distinct = listed.select(F.explode("phrases").alias("key")).distinct().withColumn("text", F.col("key"))
    bytes_in, grams_of = F.octet_length("text"), []
    for size, larger in zip(SIZES, (1 << 31, *SIZES)):
        fitting = distinct.where((bytes_in >= size) & (bytes_in < larger))
        grams_of.append(_run(fitting, _finder((size,)), "key string, gram long, slot int"))
    cut = materialise(reduce(DataFrame.union, grams_of), name="grams")
    grams = listed.select("rule_id", "phrases", F.explode("phrases").alias("key")).join(cut, "key")

    seen = _run(texts, _finder(SIZES, _marks(cut), counts=True), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # A gram that occurs nowhere leaves its rule without a match.
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "slot"))
    anchored = grams.join(seen, "gram", "left").groupBy("rule_id", "phrases").agg(rarest.alias("a"))
    anchors = materialise(anchored.where("a.n > 0").select("rule_id", "phrases", "a.gram", "a.slot"), name="anchors")

    kind = dict(texts.dtypes)["key"]
    met = _run(texts, _finder(SIZES, _marks(anchors)), f"key {kind}, gram long, slot int").select("key", "gram")
    met = materialise(met.distinct(), name="met")
    by_gram = anchors.groupBy("gram").agg(F.collect_list(F.struct("rule_id", "phrases")).alias("rules"))  # no longer than the rule table
    pairs = spread_left_join(met, by_gram, "gram", "key").where("rules IS NOT NULL").select("key", F.explode("rules").alias("r"))
    verified = texts.join(pairs, "key").where(F.forall("r.phrases", lambda p: F.contains(F.col("text"), p)))
    return verified.select("r.rule_id", F.col("key").alias(key)).distinct()


def _run(texts: DataFrame, find: Callable[[Batches], Batches], schema: str) -> DataFrame:
    return texts.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(find, schema)


def _marks(grams: DataFrame) -> bytes:
    """A bit per slot, set where a gram has it."""
    words = (1 << LOG_SLOTS) // 64
    filled = grams.select(F.shiftright("slot", 6).alias("i"), F.expr("shiftleft(1L, slot & 63)").alias("b"))
    out = [0] * words
    for row in filled.groupBy("i").agg(F.bit_or("b").alias("b")).collect():  # at most 1 << LOG_SLOTS bits
        out[row["i"]] = row["b"]
    return b"".join(x.to_bytes(8, "little", signed=True) for x in out)


def _finder(sizes: tuple[int, ...], marks: bytes | None = None, counts: bool = False) -> Callable[[Batches], Batches]:
    """Batches of (key, text) to the distinct marked grams of each slice of a text, or to counts of them.

    All it needs travels inside the function: Spark's workers need not have this package.
    """
    step, shift = SLICE, 64 - LOG_SLOTS

    def find(batches: Batches) -> Batches:
        import numpy as np
        import pyarrow as pa

        odd, other = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        marked = None if marks is None else np.unpackbits(np.frombuffer(marks, np.uint8), bitorder="little").astype(bool)

        def hashes(data, size):
            """A hash for the gram at each place; distinct for distinct grams of up to eight bytes and one size."""
            width = min(size, 8)
            out = np.zeros(max(0, len(data) - width + 1), np.uint64)
            for i in range(width):
                out |= data[i:i + len(out)].astype(np.uint64) << np.uint64(8 * i)
            if size > 8:
                out = (out[:-8] * other) ^ out[8:] if len(out) > 8 else out[:0]
            return (out ^ np.uint64(size)) * odd

        def in_slices(keys, offsets, data):
            for lo in range(int(offsets[0]), int(offsets[-1]), step):
                for size in sizes:
                    found = hashes(data[lo:min(lo + step + size - 1, int(offsets[-1]))], size)
                    slots = (found >> np.uint64(shift)).astype(np.int32)
                    at = np.flatnonzero(marked[slots]) if marked is not None else np.arange(len(found))
                    row = np.searchsorted(offsets, at + lo, "right") - 1
                    inside = at + lo + size <= offsets[row + 1]
                    at, row = at[inside], row[inside]
                    found, slots = found[at].view(np.int64), slots[at]
                    if counts:
                        values, n = np.unique(found, return_counts=True)
                        yield pa.record_batch({"gram": values, "n": n.astype(np.int64)})
                        continue
                    order = np.lexsort((found, row))
                    found, slots, row = found[order], slots[order], row[order]
                    first = np.ones(len(row), bool)
                    first[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                    yield pa.record_batch({"key": keys.take(pa.array(row[first])), "gram": found[first], "slot": slots[first]})

        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            if len(text) and text.buffers()[2] is not None:
                offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
                yield from in_slices(batch.column("key"), offsets, np.frombuffer(text.buffers()[2], np.uint8))

    return find
