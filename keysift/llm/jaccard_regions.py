"""Jaccard join of word shingles as a join in a metric space.

Jaccard distance is a metric.  Two documents are linked when theirs is at most the
radius ``1 - share``.  The space is divided so that linked documents meet in some region:

1.  Sizes.  Measured from a pivot that contains both, a document's distance is a matter
    of its size alone, so by the triangle inequality linked documents have sizes within
    the share of each other.  Sizes are divided into regions, and a window below each
    border is replicated into the region above.
2.  Parts.  Shingles are hashed into more parts than linked documents of a size region can
    differ in.  Distances add up over parts, so they agree wholly in several parts: with
    the contents of a part as pivot both are at distance 0 from it.  Documents with the
    same contents of one part share a cell.  Cells say who may be linked: two documents
    that meet in fewer small cells than linked ones must are no pair, and pairs and large
    cells together are connected into regions.  No link leaves its region.
3.  Documents.  A region small enough for one task is joined there exactly, by the sizes
    of all intersections.  A larger one takes some of its documents as pivots.  Each
    document goes to the Voronoi region of its nearest pivot, and as a replica into every
    other one whose pivot is at most two radii farther away.  Documents that are too far
    from all pivots for links to a document that shares nothing with one make a region of
    their own.  Others within a radius of it are replicated into it, and its documents into
    the regions of pivots that they share anything with.  Every part is joined in the same way again.
    Where pivots do not divide a region, it is cut into blocks that meet in pairs.

Pivots that are documents cannot divide the whole corpus: unrelated texts share no
shingle and are all at distance 1 from each other, so every window would hold nearly
everything.  Hence the first two levels, whose pivots do tell texts apart.

Documents with equal sets are one representative from the start, so copies are never
paired.  Of a pair that several regions hold, the one counts in which the smaller set is
no replica.  A region returns what is connected in it, each set with the smallest one,
and each set's number of links; it does not return pairs.

Defined cases.  A text with fewer words than a shingle has its whole word sequence as
the only element; a text without words, or null, has no element and no link.  Rows
repeated with one id are judged one by one.  Null ids come last where the smallest id
names a component.  No rows give no rows.  Shingles are compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keysift.llm.blocks import text_blocks
from keysift.llm.components import components
from keysift.llm.names import unused
from keysift.llm.words import mixed, sequence_hashes, words_of
from keysift.operators.skew import spread_left_join
from keysift.plans.durable import discard, materialise, release_shuffles, scratch_dir

# Cells of up to so many sets are listed as pairs.
SMALL_CELL = 16
# Up to so many cells, or shingles of regions, are handled in one pass.  More cells take as many passes as that makes, up to
# the number of lists that a set's cells are written in; more shingles take up to so many more, by their share of all shingles.
PASS_HASHES, SLICES, REGION_PASSES = 10_000_000, 8, 6
# A region of more sets, or of more shingles in all, is divided.
REGION_SETS, REGION_SHINGLES = 1024, 2_000_000
N_PIVOTS = 8
# A size region spans at most this ratio, or one window where that is wider.
_SIZE_RATIO = 1.4
_ROUNDING = 1e-9


def shingle_sets(texts: list[bytes], n_words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(texts, lower=True)
    shingles = sequence_hashes(words.hashes, n_words) if len(words.hashes) >= n_words else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n_words:
            out.append(np.unique(shingles[a:b - n_words + 1]))
        else:
            out.append(sequence_hashes(words.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


class Cells:
    """The cells of shingle sets in which linked ones meet."""

    def __init__(self, percent: int):
        self._percent = percent
        window = 100 / percent
        self._ratio = window ** max(1, int(np.log(_SIZE_RATIO) / np.log(window)))
        self._parts: dict[int, tuple[int, int, int]] = {}
        self._borders = [1]  # of the regions of sizes
        self._extend(64)

    def _extend(self, size: int) -> None:
        while self._borders[-1] <= size:
            low = self._borders[-1]
            self._borders.append(max(low + 1, int(low * self._ratio)))

    def regions(self, size: int) -> list[int]:
        """Own region, and the one above if a linked set may lie there."""
        self._extend(2 * size + 2)
        own = int(np.searchsorted(self._borders, size, side="right")) - 1
        return [own, own + 1] if size * 100 >= self._percent * self._borders[own + 1] else [own]

    def parts(self, region: int) -> tuple[int, int, int]:
        """How many shingles linked sets of a region may differ in, its number of parts, and the most
        shingles of a part that is thin.

        Shingles fall into parts at random.  So many parts are made beyond the ones that may
        differ that a set with more thin ones is rare: five standard deviations above the
        mean of the smallest set listed there, as far as that leaves the parts any contents.
        """
        if region not in self._parts:
            # The smaller of two linked sets is below the region's end.
            differ = ((self._borders[region + 1] - 1) * (100 - self._percent)) // self._percent
            low, spare = self._borders[region] * self._percent / 100, 1
            thin = 1 if low >= 5 * (differ + 1) else 0
            for _ in range(8):
                mean = low / (differ + 1 + spare)
                few = (differ + 1 + spare) * np.exp(-mean) * (1 + mean * thin)
                spare = max(spare, min(1 + differ // 2, int(np.ceil(few + 5 * np.sqrt(few)))))
            self._parts[region] = (differ, differ + 1 + spare, thin)
        return self._parts[region]

    def of(self, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        """Cells, one per part: a hash of the region, the part's number and its contents; and how
        many of them a linked set shares at least.

        Parts with next to no shingles tell nothing.  A few of them are left out, and as many
        more parts are made, so that linked sets still agree in a part that both list.
        """
        size, out, shared = len(shingles), [], []
        for region in self.regions(size):
            differ, n_parts, thin = self.parts(region)
            if differ == 0:
                continue  # only equal sets are linked
            spare = n_parts - differ - 1
            ends = (np.arange(n_parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(n_parts)
            starts = np.searchsorted(shingles >> np.uint64(32), ends, side="left")
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles))])
            contents = total[starts[1:]] - total[starts[:-1]]
            keys = mixed(contents + mixed(np.arange(n_parts, dtype=np.uint64) + np.uint64(region << 32)))
            few = np.diff(starts) <= thin
            # Of the parts in which two sets agree, thin ones are at most the fewer of either's. A set with
            # too many lists all its parts, and nothing is stated about how many it shares.
            n_few = int(few.sum())
            out.append(keys[~few] if n_few <= spare else keys)
            shared.append(spare + 1 - n_few if n_few <= spare else 1)
        return (np.concatenate(out), min(shared)) if out else (np.zeros(0, np.uint64), 1)


def _set_key(shingles: np.ndarray) -> bytes:
    return mixed(np.array([mixed(shingles).sum(), mixed(shingles * np.uint64(3)).sum()], np.uint64)).tobytes()


def _dealt(listed: list[np.ndarray]) -> list[pa.Array]:
    """The cells of each set in as many lists as there are slices, by the cells' hashes."""
    n, keys = len(listed), np.concatenate(listed)
    place = (keys % np.uint64(SLICES)).astype(np.int64) * n + np.repeat(np.arange(n), list(map(len, listed)))
    keys = keys[np.argsort(place, kind="stable")].view(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=SLICES * n))])
    ends = [ends[k * n:(k + 1) * n + 1] for k in range(SLICES)]
    return [pa.ListArray.from_arrays(pa.array(e - e[0], pa.int32()), pa.array(keys[e[0]:e[-1]])) for e in ends]


def sketches(docs: DataFrame, percent: int, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set (128 bits that stand for the set), half (64 of them), shared, n_cells, and the
    cells in cells_0, cells_1 and so on."""
    lists = [f"cells_{k}" for k in range(SLICES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(percent)
        for batch in batches:
            for first, texts in text_blocks(batch["text"]):
                sets = shingle_sets(texts, n_words)
                whole, listed = list(map(_set_key, sets)), list(map(cells.of, sets))
                yield pa.record_batch(
                    [batch["doc_id"].slice(first, len(texts)), pa.array(list(map(len, sets)), pa.int64()),
                     pa.array(whole, pa.binary()), pa.array([int.from_bytes(w[:8], "little", signed=True) for w in whole]),
                     pa.array([n for _, n in listed], pa.int32()), pa.array([len(keys) for keys, _ in listed], pa.int32()),
                     *_dealt([keys for keys, _ in listed])],
                    names=["doc_id", "n_shingles", "set", "half", "shared", "n_cells", *lists])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, set binary, half long, "
                                f"shared int, n_cells int, {', '.join(f'{c} array<long>' for c in lists)}")


def _edges(listed: DataFrame, classes: DataFrame, percent: int, listed_at: str) -> DataFrame:
    """a, b: sets to be kept in one region.  Deletes ``listed``, which is at ``listed_at``.

    Linked sets share at least ``shared`` cells.  Those of them that are small show them as
    a pair, listed often enough once the large cells that both may share are taken off.  If
    they share no small cell, all of those are large: so only sets with that many large
    cells have to be connected through them.  A passage that many texts hold makes
    large cells, but not that many in a text that has other content.

    Cells are many rows.  Some slices of them at a time are turned into counts of pairs and members of large cells;
    all else of a pass is deleted before the next, which holds tables and shuffles down.
    """
    spark, kept = listed.sparkSession, scratch_dir(listed.sparkSession, "passes")
    n_cells = listed.agg(F.sum("n_cells")).first()[0] or 0
    n_passes = 1 if n_cells <= PASS_HASHES else min(SLICES, 2 + n_cells // PASS_HASHES)
    counted, large, n_large = [], [], []
    for k in range(n_passes):
        now = scratch_dir(spark, "cells")
        cells = listed.select(F.explode(F.concat(*(f"cells_{i}" for i in range(k, SLICES, n_passes)))).alias("cell"), "half")
        met = materialise(cells.groupBy("cell").agg(F.min("half").alias("least"), F.max("half").alias("most"))
                          .where("least <> most").select("cell"), f"{now}/met")
        if n_passes > 1:
            release_shuffles(spark)
        members = materialise(cells.join(met, "cell", "left_semi").distinct(), f"{now}/members")
        if n_passes > 1:
            release_shuffles(spark)
        shape = materialise(members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), f"{now}/shape")
        sized = materialise(members.join(shape, "cell"), f"{now}/sized")
        large.append(materialise(sized.where(F.col("n") > SMALL_CELL).select("cell", "half"), f"{kept}/large-{k}"))
        n_large.append(materialise(large[k].groupBy("half").agg(F.count(F.lit(1)).alias("n_large")), f"{kept}/n_large-{k}"))
        # Lists of at most SMALL_CELL sets, turned into pairs inside their row.  Those of one group of near copies mostly
        # begin with the same set and so come to one task, which adds up their pairs before these are dealt out.
        small = sized.where(F.col("n") <= SMALL_CELL).groupBy("cell").agg(F.array_sort(F.collect_list("half")).alias("sets"))
        pair = F.explode(F.expr("flatten(transform(sets, (x, i) -> transform(slice(sets, i + 2, size(sets)), y -> struct(x AS a, y AS b))))"))
        pairs = small.select("sets").repartition(F.get("sets", F.lit(0))).select(pair.alias("p"))
        counted.append(materialise(pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")), f"{kept}/pairs-{k}"))
        discard(spark, now)
        if n_passes > 1:
            release_shuffles(spark)
    discard(spark, listed_at)

    known = classes.groupBy("half").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"),
                                        F.min("shared").alias("shared"))
    in_large = reduce(DataFrame.unionByName, n_large).groupBy("half").agg(F.sum("n_large").alias("n_large"))
    known = materialise(known.join(in_large, "half", "left").withColumn("n_large", F.coalesce("n_large", F.lit(0))), f"{kept}/known")

    links = []
    for k in range(n_passes):
        tied = materialise(large[k].join(known.where(F.col("n_large") >= F.col("shared")).select("half"), "half", "left_semi"),
                           f"{kept}/tied-{k}")
        first = materialise(tied.groupBy("cell").agg(F.min("half").alias("first")), f"{kept}/firsts-{k}")
        links.append(materialise(tied.join(first, "cell").select("half", "first").distinct(), f"{kept}/links-{k}"))
        discard(spark, f"{kept}/large-{k}", f"{kept}/tied-{k}", f"{kept}/firsts-{k}")
    release_shuffles(spark)
    # A set is connected with the smallest of its cells' first sets, and that one with the others of them,
    # which are few and the same for most sets of a group.
    firsts = reduce(DataFrame.unionByName, links).groupBy("half").agg(F.collect_set("first").alias("firsts"))
    centre = F.array_min("firsts")
    stars = firsts.select(centre.alias("a"), F.explode(F.array_union("firsts", F.array("half"))).alias("b")).where("a <> b")

    counted = reduce(DataFrame.unionByName, counted).groupBy("a", "b").agg(F.sum("n").alias("n"))
    of = lambda side: known.select(F.col("half").alias(side), *(
        F.col(c).alias(f"{c}_{side}") for c in ("least", "most", "shared", "n_large")))
    pairs = counted.join(of("a"), "a").join(of("b"), "b").where(
        (F.col("n") >= F.least("shared_a", "shared_b") - F.least("n_large_a", "n_large_b"))
        & (F.col("most_a") * 100 >= F.col("least_b") * percent)
        & (F.col("most_b") * 100 >= F.col("least_a") * percent)).select("a", "b")
    edges = materialise(stars.unionByName(pairs).distinct(), name="edges")
    discard(spark, kept)
    return edges


def _sets(docs: DataFrame, wanted: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """set, shingles of the documents whose id is in ``wanted`` (first_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_blocks(batch["text"]):
                sets = shingle_sets(texts, n_words)
                yield pa.record_batch([pa.array(list(map(_set_key, sets)), pa.binary()),
                                       pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                      names=["set", "shingles"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("text")
    return rows.mapInArrow(run, "set binary, shingles array<long>").dropDuplicates(["set"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, from products of 0/1 matrices of some columns at a time."""
    n = len(sets)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    np.fill_diagonal(out, np.bincount(member[count[column] == 1], minlength=n))
    several = count[column] > 1  # a shingle of one set alone adds to no other intersection
    member, column = member[several], column[several]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0) if len(column) else column
    width = max(64, (1 << 21) // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        block = np.zeros((n, width), np.float32)
        block[member[a:b], column[a:b] - low] = 1
        out += block @ block.T
    return out


def _joined(percent: int):
    """The exact join inside one region, as a function of its rows."""

    def join(region: pa.Table) -> pa.Table:
        keys = region["set"].to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys = [keys[i] for i in order]
        lists = region["shingles"].combine_chunks()
        sets = [np.asarray(lists[i].values.to_numpy(zero_copy_only=False)) for i in order]
        own = np.asarray(region["own"].to_pylist(), bool)[order]
        side = np.asarray(region["side"].to_pylist())[order]
        size = np.array([len(s) for s in sets], np.int64)
        common = intersections(sets).astype(np.int64)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        # Each pair once, by its smaller set; of two sides only pairs across them.
        linked &= np.triu(np.ones_like(linked), 1) & own[:, None]
        if region["across"][0].as_py():
            linked &= side[:, None] != side[None, :]
        linked |= linked.T
        a, b, todo = [], [], set(np.flatnonzero(linked.any(axis=1)).tolist())
        while todo:
            first = min(todo)
            todo.discard(first)
            front = [first]
            while front:
                new = [y for y in np.flatnonzero(linked[front.pop()]).tolist() if y in todo]
                todo.difference_update(new)
                a += [keys[first]] * len(new)
                b += [keys[y] for y in new]
                front += new
        n = linked.sum(axis=1)
        some = np.flatnonzero(n).tolist()
        return pa.table({"a": pa.array(a + [keys[i] for i in some], pa.binary()),
                         "b": pa.array(b + [None] * len(some), pa.binary()),
                         "n": pa.array([0] * len(a) + n[some].tolist(), pa.int64())})

    return join


_REGION = ["region", "set", "shingles", "own", "side", "across"]


def _join_regions(rows: DataFrame, percent: int, max_sets: int, max_shingles: int) -> list[DataFrame]:
    """a, b, n of all regions in ``rows`` (region, set, shingles): sets b that links connect with a, and
    with b null the number n of a's links."""
    radius = 1 - percent / 100
    rows = rows.withColumns({"own": F.lit(True), "side": F.lit(0), "across": F.lit(False)})
    out = []
    while True:
        shape = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("weight"))
        too_large = (F.col("n") > max_sets) | ((F.col("weight") > max_shingles) & (F.col("n") > 2))
        large_ids = materialise(shape.where(too_large), name="large")
        small = rows.join(large_ids.select("region"), "region", "left_anti")
        out.append(materialise(small.select(*_REGION).groupBy("region").applyInArrow(
            _joined(percent), "a binary, b binary, n long"), name="links"))
        if large_ids.isEmpty():
            return out
        large = rows.join(large_ids, "region")
        rows = materialise(_divided(large, radius, max_sets, max_shingles), name="regions")


def _divided(large: DataFrame, radius: float, max_sets: int, max_shingles: int) -> DataFrame:
    """The rows of regions that are too large, in smaller ones."""
    # Pivots come from the region's own sets, in the order of a hash; a region without any has no pair to find.
    first = Window.partitionBy("region").orderBy(F.xxhash64("region", "set"), "set")
    pivots = (large.where("own").select("region", "set", "shingles").withColumn("place", F.row_number().over(first))
              .where(F.col("place") <= N_PIVOTS).groupBy("region").agg(F.collect_list("shingles").alias("pivots")))
    pivots = materialise(pivots, name="pivots")

    def distance(pivot):
        common = F.size(F.array_intersect("shingles", pivot))
        return 1 - common / (F.size("shingles") + F.size(pivot) - common)

    placed = large.join(pivots, "region").withColumn("distances", F.transform("pivots", distance)).drop("pivots")
    placed = materialise(placed.withColumns({
        "nearest": F.array_min("distances"), "home": F.array_position("distances", F.array_min("distances")).cast("int")}), name="placed")
    # Far from all pivots: the region of its own has number 0.  Either set of a linked pair may be the smaller, so
    # each has to be in the home of the other: far sets also with the pivots of others.  A set that is not far is
    # linked with none that shares nothing with its pivot.
    far = F.col("nearest") >= 1 - radius - _ROUNDING
    near_pivots = F.filter(F.sequence(F.lit(1), F.size("distances")), lambda j: (
        (F.element_at("distances", j) < 1) & (F.element_at("distances", j) <= F.col("nearest") + 2 * radius + _ROUNDING)))
    places = F.concat(near_pivots, F.when(
        F.col("nearest") >= 1 - 2 * radius - 3 * _ROUNDING, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    home = F.when(far, 0).otherwise(F.col("home"))
    parted = placed.select("*", F.explode(places).alias("place"), home.alias("at")).select(
        "region", "n", "set", "shingles", (F.col("own") & (F.col("place") == F.col("at"))).alias("own"), "side", "across",
        F.xxhash64("region", "place").alias("next"))

    # Where a part is nearly as large as its region, pivots lead nowhere: cut that region into blocks instead.
    sizes = parted.groupBy("region", "next").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.max("own").alias("any"))
    stuck = materialise(sizes.groupBy("region").agg(F.max(F.col("m") / F.col("n")).alias("most")).where("most > 0.9").select("region"),
                        name="stuck")
    useful = sizes.where("any").select("region", "next")
    divided = parted.join(useful, ["region", "next"], "left_semi").join(stuck, "region", "left_anti")
    n_blocks = F.ceil(2 * F.greatest(F.col("n") / max_sets, F.col("weight") / max_shingles)).cast("int")
    blocked = large.join(stuck, "region", "left_semi").withColumn("blocks", n_blocks).withColumn(
        "mine", F.pmod(F.xxhash64("set", "region"), F.col("blocks")).cast("int"))
    met = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Two different blocks are the sides of a region in which only pairs across count.  In a region
    # that has sides already, every block of one side meets every block of the other.
    side = F.when(F.col("across"), F.col("side")).otherwise((F.col("mine") > F.col("other")).cast("int"))
    left, right = F.when(side == 0, F.col("mine")).otherwise(F.col("other")), F.when(side == 0, F.col("other")).otherwise(F.col("mine"))
    return divided.select(F.col("next").alias("region"), "set", "shingles", "own", "side", "across").unionByName(met.select(
        F.xxhash64("region", left, right, F.lit("blocks")).alias("region"), "set", "shingles", "own",
        side.alias("side"), (F.col("across") | (F.col("mine") != F.col("other"))).alias("across")))


def near_duplicates(docs: DataFrame, percent: int = 80, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text",
                    max_sets: int = REGION_SETS, max_shingles: int = REGION_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to) and n_links of every row.

    Two documents are linked when ``100 * common shingles >= percent * all their shingles``;
    ``n_links`` counts the different sets that a document's set is linked with.
    """
    spark = docs.sparkSession
    listed_at = scratch_dir(spark, "cells")
    listed = materialise(sketches(docs, percent, n_words, id_col, text_col), listed_at)
    rows = materialise(listed.select("doc_id", "n_shingles", "set", "half", "shared"), name="sketches")
    classes = materialise(rows.where("n_shingles > 0").groupBy("set").agg(
        F.min("doc_id").alias("first_id"), F.first("half").alias("half"), F.first("n_shingles").alias("n_shingles"),
        F.first("shared").alias("shared")), name="classes")
    edges = _edges(listed, classes, percent, listed_at)
    release_shuffles(spark)
    regions = components(edges).select(F.col("node").alias("half"), F.col("label").alias("region"))
    members = materialise(classes.join(regions, "half").select("region", "set", "first_id", "n_shingles"), name="members")
    # Sets are larger than their texts.  The more of them have to be compared, the smaller the share of regions at a time.
    inside, whole = (t.agg(F.sum("n_shingles")).first()[0] or 0 for t in (members, classes))
    n_passes, found = 1 if inside <= PASS_HASHES else 1 + REGION_PASSES * inside // whole, []
    for k in range(n_passes):
        some, sets_at = members.where(F.pmod(F.xxhash64("region"), F.lit(n_passes)) == k), scratch_dir(spark, "sets")
        sets = materialise(_sets(docs, some.select("first_id"), n_words, id_col, text_col), sets_at)
        release_shuffles(spark)
        found += _join_regions(some.select("region", "set").join(sets, "set"), percent, max_sets, max_shingles)
        discard(spark, sets_at)
        release_shuffles(spark)

    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    labels = components(links.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("set"), "label")
    n_links = links.where("b IS NULL").groupBy(F.col("a").alias("set")).agg(F.sum("n").alias("n_links"))
    labelled = classes.select("set", "first_id").join(labels, "set")
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component"))
    named = classes.select("set", "first_id").join(
        labelled.join(smallest, "label").select("set", "component").join(n_links, "set"), "set", "left")
    named = materialise(named.select("set", F.coalesce("component", "first_id").alias("component"),
                                     F.coalesce("n_links", F.lit(0)).alias("n_links")), name="named")
    # A set with very many copies is dealt to many tasks.
    return spread_left_join(rows.select("doc_id", "n_shingles", "set"), named, "set", "doc_id").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, percent: int = 80, n_words: int = 5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest id of every group, all columns kept.

    Ids should be unique; rows that share an id stay or go together.
    """
    groups = near_duplicates(docs, percent, n_words, id_col, text_col)
    kept_id = unused(docs.columns, "kept_id")
    kept = groups.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
