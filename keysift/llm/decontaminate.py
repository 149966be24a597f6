"""Benchmark passages in documents, found by a prefix-filtered set join.

A window is ``n`` consecutive words of a benchmark item, or the whole item where it has fewer.
A document word inside any occurrence of a window is hit.

1.  Order.  Shingles of ``SHINGLE`` words (all of a shorter window) are counted over the documents,
    only those that some window holds: partial counts in the scan, then one row a shingle.
2.  Prefix.  In the order of rarity the first shingle of a window is its necessary prefix: a
    stretch of words equal to the window holds it at the same place.  Windows whose rarest
    shingle never occurs are done.
3.  Join.  A place of a document is left where it is unless the words around it are those of a window
    with its prefix there, by a Bloom filter of bounded size.  Places that remain meet the windows by
    prefix shingle.  The rest of a window must fit between the beginning and the end of the text.
4.  Verification.  The words around a place are carried along, and compared with the window's
    words one by one.  Equal windows of several items are one window until here.

Both passes read texts in one narrow stage.  A shingle that no window holds is turned away there by
a table of ``SLOTS`` marks, whatever the size of the benchmark; what it lets through meets the
windows in an exact join.  Shingles with many places are dealt to many tasks, and equal
windows start a row once per document.  DataFrame functions throughout.

Defined cases.  Null texts and texts without words have no words; such items have no windows.  Items
without id count as hits and are not listed; items repeated under one id are one item.  Repeated
documents are judged alike, row by row.  Ties in rarity go to the earliest shingle.  A very long text is a
row's own array of words.  No documents give no rows, no items no hits.  Only ids and texts are read, so
further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.bloom import MOST_BITS, bits_for, bloom_filter, may_hold
from keysift.operators.skew import spread_left_join
from keysift.plans.durable import materialise

WINDOW = 10
SHINGLE = 3
# A fixed size: with more shingles it turns fewer away, and results stay the same.
SLOTS = 1 << 18
# What separates words, and the letters whose case is ignored.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Capitals beyond A-Z, whose case stays.
_OTHER_CAPITALS = r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is much faster than translate() and does the same where no other capital occurs.
    lowered = F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _windows(items: DataFrame, n: int) -> DataFrame:
    """window (its words), item_ids: every distinct window once, with the items that hold it."""
    worded = items.select("item_id", F.inline(F.array(F.struct(words(F.col("text")).alias("words"))))).where(F.size("words") > 0)
    each = worded.select("item_id", "words", F.explode(F.sequence(
        F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))).alias("at"))
    return each.select(F.slice("words", F.col("at"), n).alias("window"), "item_id").distinct()


def _shingle(words_: str, i: str, size: int) -> str:
    """SQL of a shingle's hash: ``size`` words from place ``i``, counted from 0."""
    return f"xxhash64({size}, {', '.join(f'get({words_}, {i} + {k})' for k in range(size))})"


def _shingled(windows: DataFrame) -> DataFrame:
    """window, at (from 0), size, shingle: every shingle of every distinct window."""
    sized = windows.select("window", F.least(F.size("window"), F.lit(SHINGLE)).alias("size")).distinct()
    placed = sized.select("*", F.explode(F.expr("sequence(0, size(window) - size)")).alias("at"))
    hashed = "CASE size " + " ".join(f"WHEN {k} THEN {_shingle('window', 'at', k)}" for k in range(1, SHINGLE + 1)) + " END"
    return placed.select("window", "at", "size", F.expr(hashed).alias("shingle"))


def _marks(shingles: DataFrame) -> Column:
    """A scalar: array of ``SLOTS`` marks, true where a shingle falls."""
    marked = shingles.select(F.expr(_slot("shingle")).cast("long").alias("id"), F.lit(True).alias("mark")).distinct()
    every = shingles.sparkSession.range(SLOTS, numPartitions=1).join(F.broadcast(marked), "id", "left")  # SLOTS rows at most
    listed = every.agg(F.array_sort(F.collect_list(F.struct("id", F.col("mark").isNotNull().alias("mark")))).alias("all"))
    return listed.select(F.col("all.mark").alias("marks")).scalar()


def _slot(shingle: str) -> str:
    return f"cast({shingle} & {SLOTS - 1} as int)"


def _places(docs: DataFrame, shingles: DataFrame, sizes: list[int], **more: Column) -> DataFrame:
    """doc_id, words, places: at (from 0) and shingle wherever the shingle may be among ``shingles``; and what ``more`` names."""
    # Rows of a one-element array: the words must not be cut anew for every look at them.
    bound = F.array(F.struct(words(F.col("text")).alias("words"), _marks(shingles).alias("marks"), *(c.alias(k) for k, c in more.items())))
    marked = docs.select("doc_id", F.inline(bound))
    found = []
    for size in sizes:
        h = _shingle("words", "i", size)
        found.append(F.expr(f"""transform(filter(if(size(words) < {size}, cast(array() as array<int>), sequence(0, size(words) - {size})),
            i -> get(marks, {_slot(h)})), i -> named_struct('at', i, 'shingle', {h}))"""))
    places = F.concat(*found) if found else F.expr("cast(array() as array<struct<at:int,shingle:bigint>>)")
    return marked.select("doc_id", "words", places.alias("places"), *more)


def _surrounded(docs: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """``_places`` of prefix shingles with the words of a window around them, or by chance with others."""
    bits = bits_for(prefixes.count()) or MOST_BITS
    keys = prefixes.select(F.xxhash64("offset", "window").alias("key"))
    places = _places(docs, prefixes.select(F.col("prefix").alias("shingle")), sizes, held=bloom_filter(keys, "key", bits))
    # At most a few dozen: an offset is less than a size, and a size at most that of a window.
    shapes = sorted(map(tuple, prefixes.select("offset", F.size("window")).distinct().collect()))

    def fits(p: Column) -> Column:
        inside = [F.when((p["at"] >= offset) & (p["at"] - offset + size <= F.size("words")),
                         F.xxhash64(F.lit(offset), F.slice("words", p["at"] - offset + 1, size))) for offset, size in shapes]
        return F.exists(F.array(*inside), lambda key: key.isNotNull() & may_hold(F.col("held"), key, bits))

    return places.select("doc_id", "words", (F.filter("places", fits) if shapes else F.slice("places", 1, 0)).alias("places"))


def _rarest(windows: DataFrame, shingled: DataFrame, counts: DataFrame) -> DataFrame:
    """window, prefix (the rarest shingle), offset: windows of which every shingle occurs in some document."""
    ranked = shingled.join(counts, "shingle", "left").select("window", "at", "shingle", F.coalesce("n", F.lit(0)).alias("n"))
    order = F.struct("n", "at")
    return ranked.groupBy("window").agg(F.min("n").alias("least"), F.min_by("shingle", order).alias("prefix"),
                                        F.min_by("at", order).alias("offset")).where("least > 0").drop("least")


def overlaps(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (start, end in words, end exclusive; apart from
    one another) and item_ids (as text, sorted) of the items with a window in it."""
    named = items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    windows = materialise(_windows(named, n), name="windows")
    shingled = materialise(_shingled(windows), name="shingles")
    sizes = sorted(r["size"] for r in shingled.select("size").distinct().collect())  # at most SHINGLE of them
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    counts = _places(texts, shingled.select("shingle"), sizes).select(
        F.explode("places.shingle").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    prefixes = materialise(_rarest(windows, shingled, counts), name="prefixes")

    # The words around a place reach as far as any window with the shingle in it can.
    reach = n - min(sizes, default=1)
    near = F.transform("places", lambda p: F.struct(
        p["at"].alias("at"), p["shingle"].alias("prefix"), F.least(p["at"], F.lit(reach)).alias("before"),
        F.slice("words", F.greatest(p["at"] - reach, F.lit(0)) + 1, F.least(p["at"], F.lit(reach)) + n).alias("around")))
    rows = materialise(_surrounded(texts, prefixes, sizes).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), near.alias("places")),
        name="places")

    places = rows.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    met = spread_left_join(places, prefixes, "prefix", "row").where(F.col("window").isNotNull())
    start = F.col("at") - F.col("offset")
    bounded = met.where((start >= 0) & (start + F.size("window") <= F.col("n_words")))
    equal = F.slice("around", F.col("before") - F.col("offset") + 1, F.size("window")) == F.col("window")
    found = materialise(bounded.where(equal).select("row", start.alias("start"), "window"), name="found")

    each = found.select("row", F.explode(F.expr("sequence(start, start + size(window) - 1)")).alias("word"))
    hit = each.groupBy("row").agg(F.array_sort(F.collect_set("word")).alias("hit"))
    held = found.select("row", "window").distinct()
    listed = spread_left_join(held, windows, "window", "row").groupBy("row").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    ends = F.expr("filter(hit, (w, i) -> i + 1 = size(hit) or get(hit, i + 1) <> w + 1)")
    starts = F.expr("filter(hit, (w, i) -> i = 0 or get(hit, i - 1) <> w - 1)")
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    out = rows.select("row", "doc_id", "n_words").join(hit.select("row", spans.alias("spans")), "row", "left").join(listed, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"),
                      F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return overlaps(docs, items, n).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
