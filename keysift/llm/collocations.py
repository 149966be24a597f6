"""Collocations: phrases of two to four words whose words seek each other out, per language.

Counting is by direct-address tiling, level by level.  Elements (at first the words, then the
frequent pairs of words, ...) are ranked by frequency, and pairs of neighbouring elements
are counted in tiles of ranks: a tile of ``TILE`` by ``TILE`` ranks that receives many pairs is a dense table to
which numpy's bincount adds; all other pairs are sorted lists of (left, right, count).  Pairs
found often enough are the next level's elements, ranked anew: two pairs of words that overlap make
a phrase of three, two that touch one of four.  A phrase is only as frequent as its parts, so nothing is missed.

Each level reads the texts once, counts in its tasks and sends counts, not occurrences.  What tasks know of a
level has a fixed size: the ``HEAD`` most frequent elements with their ranks, and a table of ``MARK_BITS`` bits in
which all frequent elements are marked.  A bit set by chance only lets a pair through that the count
turns away.  With more elements than bits more pairs are sent, and results stay the same.

Most phrases of three or four words whose parts are frequent are themselves rare.  So a pass before theirs
counts them by ``SLOTS`` slots of their keys' bits, and only those whose slot is full enough are counted by
their words.  Slots are shared by chance, which lets rare phrases through and holds back none; when the
phrases are many times as many as the slots, all are counted by their words.

A task of that last pass sends a row for each phrase it has met, and both phrases and parts of the input grow with the
texts.  So the pass has as many tasks as the cluster has cores at most, not one for each part, and a task sums
what it finds, up to ``HELD`` phrases; beyond them it sends the rarer ones and goes on.

Scores.  For every cut of a phrase the counts of both sides are looked up in joins that deal
frequent words to many tasks; the lowest score counts.  Phrases that mostly occur inside a
longer one are dropped, and the best of each language are ranked in buckets first.

Words are compared by 64 bits (with their language), phrases by all their words' bits.  Two frequent words
with equal bits are noticed and refused.

Defined cases.  A null text has no words, a null language is ``und``; an empty one is a
language.  Rows repeated in full count each.  Very long texts are cut at the ends of pieces, which no phrase
crosses; a single piece is held by its task.  No rows, or nothing frequent, give no rows.  Only
the two named columns are read, so further columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.llm.blocks import text_blocks
from keysift.llm.words import mixed, powers
from keysift.operators.skew import spread_left_join
from keysift.plans.durable import materialise

LONGEST = 4
LEAST = 30
TOP = 2000
INSIDE_PERCENT = 80
SCALE = 2_000_000
UNDETERMINED = "und"

TILE = 256
HEAD = 16 * TILE
# Pairs in one tile that make a dense table worth its memory.
DENSE_PAIRS = TILE * TILE // 16
MARK_BITS = 1 << 24
SLOTS, ROW_SLOTS, BATCH_ROWS = 1 << 25, 1 << 14, 256
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 4096
VOCABULARY_BYTES = 2 << 20
BUFFER_PAIRS = 1 << 20
HELD, SUMMED_PAIRS, SENT_ROWS = 1 << 19, 1 << 18, 1 << 16

# What ends a piece, and what stands between the words of one.
_BREAKS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK = np.isin(np.arange(256), list(_BREAKS))
_OUTSIDE = np.isin(np.arange(256), list(_BREAKS + _GAPS))
_END_OF_PIECE = re.compile(b"[" + re.escape(_BREAKS) + b"]")
_random = np.random.Generator(np.random.PCG64(20250131))
_OF_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PAIRING = np.uint64(int(_random.integers(1, 1 << 62)) * 2 + 1)


@dataclass(frozen=True)
class Words:
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # index of each word's text
    codes: np.ndarray  # of each word in its text's language
    follows: np.ndarray  # whether the next word continues the piece


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of pairs of elements."""
    return mixed(left * _PAIRING + right)


def _language_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def words_of(texts: list[bytes], languages: list[str]) -> Words:
    data = (b"\n".join(texts) + b"\n").translate(_LOWER)
    raw = np.frombuffer(data, np.uint8)
    inside = ~_OUTSIDE[raw]
    change = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool))
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(at.astype(np.int32), lengths)
    hashes = np.add.reduceat(_OF_BYTE[raw[inside]] * powers(int(lengths.max()))[place], at)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    own = {lang: _language_code(lang) for lang in set(languages)}
    of_text = np.array([own[lang] for lang in languages], np.uint64)
    piece = np.cumsum(_BREAK[raw], dtype=np.int32)[starts]
    return Words(data, starts, ends, text, mixed(mixed(hashes + lengths.astype(np.uint64)) ^ of_text[text]),
                 np.append(piece[1:] == piece[:-1], False))


def _blocks(batch: pa.RecordBatch, max_bytes: int) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts with their languages; a text longer than a block comes in parts."""
    for first, texts in text_blocks(batch["text"], max_bytes, BLOCK_ROWS):
        languages = batch["lang"].slice(first, len(texts)).to_pylist()
        if len(texts) > 1 or len(texts[0]) <= max_bytes:
            yield texts, languages
            continue
        whole, at = texts[0], 0
        while at < len(whole):
            end = _END_OF_PIECE.search(whole, min(at + max_bytes, len(whole)))
            until = end.end() if end else len(whole)
            yield [whole[at:until]], languages
            at = until


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n of a block's distinct words; a null word counts all of a language."""
    for batch in batches:
        for texts, languages in _blocks(batch, VOCABULARY_BYTES):
            words = words_of(texts, languages)
            _, where, counts = np.unique(words.codes, return_index=True, return_counts=True)
            spelled = [words.data[a:b] for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist())]
            named = pa.array(languages, pa.string())
            totals = np.bincount(words.text, minlength=len(texts))
            yield pa.record_batch([
                pa.concat_arrays([named.take(pa.array(words.text[where])), named]),
                pa.concat_arrays([pa.array(spelled, pa.binary()).cast(pa.string()), pa.nulls(len(texts), pa.string())]),
                pa.array(np.concatenate([counts, totals]).astype(np.int64))], names=["lang", "word", "n"])


def _with_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, code, f of words in their languages."""
    for batch in batches:
        words = words_of([w.encode() for w in batch["word"].to_pylist()], batch["lang"].to_pylist())
        yield pa.record_batch([batch["lang"], batch["word"], pa.array(words.codes.view(np.int64)), batch["f"]],
                              names=["lang", "word", "code", "f"])


def _marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set; the number of bits is a power of two."""
    place = keys & np.uint64(64 * len(marks) - 1)
    return (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


@dataclass(frozen=True)
class Level:
    """What tasks know of the elements of ``size`` words."""

    size: int
    marks: np.ndarray  # bits of all frequent elements
    keys: np.ndarray  # of the most frequent ones, sorted
    ranks: np.ndarray  # of those keys
    codes: np.ndarray  # words of the element with each rank

    def known(self, keys: np.ndarray) -> np.ndarray:
        return _marked(self.marks, keys)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Ranks, or -1 beyond the head."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


class Sums:
    """Counts of at most ``most`` phrases, the more frequent ones of those seen."""

    def __init__(self, most: int, size: int):
        self._most = most
        self._rows = np.zeros(0, np.uint64), np.zeros((0, size), np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Count phrases.  When there are too many, returns the rarer ones and keeps half as many as it may."""
        keys, codes, counts = (np.concatenate(both) for both in zip(self._rows, (keys, codes, counts)))
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
        sums = np.add.reduceat(counts[order], first)
        rows = keys[order[first]], codes[order[first]], sums
        if len(sums) <= self._most:
            self._rows = rows
            return None
        stays, n = np.zeros(len(sums), bool), max(self._most // 2, 1)
        stays[np.argpartition(sums, -n)[-n:]] = True
        self._rows = tuple(r[stays] for r in rows)
        return tuple(r[~stays] for r in rows)

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, self._rows = self._rows, tuple(r[:0] for r in self._rows)
        return rows


class Tiles:
    """Counts of pairs of elements ``apart`` words from each other: dense tiles, and sorted lists for the rest.

    With ``held``, the lists are summed up to so many phrases until ``rest`` is called.
    """

    def __init__(self, level: Level, apart: int = 1, width: int | None = None, held: int = 0):
        self._level, self._dense, self._apart = level, {}, apart
        self._sums = Sums(held, level.size + apart) if held else None
        self._width = width or level.size + apart
        self._key_of_rank = np.zeros(len(level.ranks), np.uint64)
        self._key_of_rank[level.ranks] = level.keys

    def add(self, left: np.ndarray, right: np.ndarray, codes: np.ndarray) -> pa.RecordBatch | None:
        """Count pairs given by keys; ``codes`` has a row of words per pair.  Returns what is not kept in a tile."""
        a, b = self._level.rank(left), self._level.rank(right)
        rest = (a < 0) | (b < 0)
        head = np.flatnonzero(~rest)
        tile = (a[head] // TILE) * (HEAD // TILE) + b[head] // TILE
        order = np.argsort(tile, kind="stable")
        head, tile = head[order], tile[order]
        for t in np.unique(tile).tolist():
            own = head[np.searchsorted(tile, t):np.searchsorted(tile, t, side="right")]
            if t not in self._dense and len(own) < DENSE_PAIRS:
                rest[own] = True
                continue
            table = self._dense.setdefault(t, np.zeros(TILE * TILE, np.uint32))
            table += np.bincount((a[own] % TILE) * TILE + b[own] % TILE, minlength=TILE * TILE).astype(np.uint32)
        sparse = np.flatnonzero(rest)
        if not len(sparse):
            return None
        keys, where, counts = np.unique(paired(left[sparse], right[sparse]), return_index=True, return_counts=True)
        found = keys, codes[sparse[where]], counts
        if self._sums and (found := self._sums.add(*found)) is None:
            return None
        return _counted(*found, self._width)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.dense()
        found = self._sums.rest() if self._sums else ([],)
        for first in range(0, len(found[0]), SENT_ROWS):
            yield _counted(*(r[first:first + SENT_ROWS] for r in found), self._width)

    def dense(self) -> Iterator[pa.RecordBatch]:
        for t, table in self._dense.items():
            cell = np.flatnonzero(table)
            a = t // (HEAD // TILE) * TILE + cell // TILE
            b = t % (HEAD // TILE) * TILE + cell % TILE
            words = np.hstack([self._level.codes[a], self._level.codes[b][:, -self._apart:]])
            yield _counted(paired(self._key_of_rank[a], self._key_of_rank[b]), words, table[cell], self._width)
        self._dense.clear()


def _counted(keys: np.ndarray, codes: np.ndarray, counts: np.ndarray, width: int) -> pa.RecordBatch:
    """key, c1 ... (null beyond the phrase's words) and n."""
    words = [pa.array(np.ascontiguousarray(codes[:, i]).view(np.int64)) for i in range(codes.shape[1])]
    words += [pa.nulls(len(keys), pa.int64())] * (width - len(words))
    return pa.record_batch([pa.array(keys.view(np.int64)), *words, pa.array(counts.astype(np.int64))],
                           names=["key", *(f"c{i + 1}" for i in range(width)), "n"])


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, c1 ..., f of elements of a power of two words, as ``_elements`` has their keys."""
    for batch in batches:
        keys = [batch.column(i).to_numpy().view(np.uint64) for i in range(batch.num_columns - 1)]
        while len(keys) > 1:
            keys = [paired(left, right) for left, right in zip(keys[::2], keys[1::2])]
        yield pa.record_batch([pa.array(keys[0].view(np.int64)), *batch.columns], names=["key", *batch.schema.names])


def _elements(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the ``size`` words (a power of two) from each word on, and whether they are in one piece."""
    keys, fits, have = words.codes, np.ones(len(words.codes), bool), 1
    while have < size:
        joins = words.follows[have - 1:len(fits) - 1]
        keys, fits = paired(keys[:-have], keys[have:]), fits[:-have] & fits[have:] & joins
        have *= 2
    return keys, fits


def _places(words: Words, level: Level, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all elements, and where a phrase of size + apart words begins whose elements are all frequent."""
    n = len(words.codes) - level.size - apart + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, fits = _elements(words, level.size)
    good = level.known(keys) & fits
    every = np.logical_and.reduce([good[k:n + k] for k in range(apart + 1)])
    for k in range(apart):  # the last word of one element continues into the next
        every &= words.follows[level.size - 1 + k:n + level.size - 1 + k]
    return keys, np.flatnonzero(every)


def _neighbours(words: Words, level: Level, apart: int, likely: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of left and right element, and the words, of every such phrase, or of those whose slot is marked."""
    keys, at = _places(words, level, apart)
    if likely is not None:
        at = at[_marked(likely, paired(keys[at], keys[at + apart]))]
    return keys[at], keys[at + apart], np.stack([words.codes[at + i] for i in range(level.size + apart)], axis=1)


def _likely(docs: DataFrame, level: Level, longest: int, least: int) -> np.ndarray:
    """Bits of the slots to which ``least`` or more phrases longer than the level's elements come."""
    shared = docs.sparkSession.sparkContext.broadcast(level)
    widest = min(2 * level.size, longest) - level.size
    kind = np.uint8 if least < 1 << 8 else np.uint32  # no task counts beyond ``least``

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n_held = np.zeros(SLOTS, kind), [], 0

        def add() -> None:
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            table[slots] = np.minimum(table[slots] + counts, least)
            held.clear()

        for batch in batches:
            for texts, languages in _blocks(batch, BLOCK_BYTES):
                words = words_of(texts, languages)
                for apart in range(1, widest + 1):
                    keys, at = _places(words, shared.value, apart)
                    held.append((paired(keys[at], keys[at + apart]) & np.uint64(SLOTS - 1)).astype(np.uint32))
                    n_held += len(at)
                if n_held >= BUFFER_PAIRS:
                    add()
                    n_held = 0
        if n_held:
            add()
        used = np.flatnonzero(table)
        ends = np.searchsorted(used, np.arange(0, SLOTS + 1, ROW_SLOTS))
        rows = np.flatnonzero(np.diff(ends))
        for first in range(0, len(rows), BATCH_ROWS):
            some = rows[first:first + BATCH_ROWS]
            slots = [used[ends[r]:ends[r + 1]] for r in some]
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array([(s % ROW_SLOTS).astype(np.uint16).tobytes() for s in slots], pa.binary()),
                                   pa.array([table[s].tobytes() for s in slots], pa.binary())], names=["at", "slots", "counts"])

    def total(tasks: pa.Table) -> pa.Table:
        sums = np.zeros(ROW_SLOTS, np.int64)
        for slots, counts in zip(tasks["slots"].to_pylist(), tasks["counts"].to_pylist()):
            sums[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, kind)
        return pa.table({"at": tasks["at"].slice(0, 1), "bits": pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())})

    counted = docs.mapInArrow(count, "at int, slots binary, counts binary").groupBy("at").applyInArrow(total, "at int, bits binary")
    bits = np.zeros((SLOTS // ROW_SLOTS, ROW_SLOTS // 8), np.uint8)
    for r in counted.collect():  # at most SLOTS bits
        bits[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(-1).view("<u8")


def _count_pairs(docs: DataFrame, level: Level, longest: int, likely: np.ndarray | None = None) -> DataFrame:
    """key, c1 ... and n of phrases longer than the level's elements, up to twice as long."""
    shared, slots = docs.sparkSession.sparkContext.broadcast(level), docs.sparkSession.sparkContext.broadcast(likely)
    width = min(2 * level.size, longest)
    held_phrases, most_pairs = 0, BUFFER_PAIRS
    if likely is not None:
        docs, held_phrases, most_pairs = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism), HELD, SUMMED_PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = {apart: Tiles(shared.value, apart, width, held_phrases) for apart in range(1, width - level_size + 1)}
        held, n_held, n_dense = {apart: [] for apart in every}, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for apart, tiles in every.items():
                if (rest := tiles.add(*(np.concatenate(c) for c in zip(*held[apart])))) is not None:
                    yield rest
                held[apart].clear()

        for batch in batches:
            for texts, languages in _blocks(batch, BLOCK_BYTES):
                words = words_of(texts, languages)
                for apart in every:
                    held[apart].append(_neighbours(words, shared.value, apart, slots.value))
                    n_held += len(held[apart][-1][0])
                if n_held >= most_pairs:
                    yield from flush()
                    n_dense, n_held = n_dense + n_held, 0
                    if n_dense >= 1 << 31:  # a cell has 32 bits
                        for tiles in every.values():
                            yield from tiles.dense()
                        n_dense = 0
        if n_held:
            yield from flush()
        for tiles in every.values():
            yield from tiles.rest()

    level_size = level.size
    codes = ", ".join(f"c{i + 1} long" for i in range(width))
    return docs.mapInArrow(run, f"key long, {codes}, n long")


def _level(found: DataFrame, size: int) -> Level:
    """The bounded knowledge of frequent elements (key, c1 ..., f)."""
    names = [f"c{i + 1}" for i in range(size)]
    place = F.col("key").bitwiseAND(F.lit(MARK_BITS - 1))
    bits = found.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(key & 63 as int))").alias("bit"))
    marks = np.zeros(MARK_BITS // 64, np.int64)
    for r in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # at most MARK_BITS / 64
        marks[r["at"]] = r["bits"]
    top = found.orderBy(F.desc("f"), "key").limit(HEAD).select("key", *names).collect()
    keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    codes = np.array([[r[c] for c in names] for r in top], np.int64).reshape(len(top), size).view(np.uint64)
    return Level(size, marks.view(np.uint64), keys[order], order, codes)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals (lang, n), words (lang, word, code), and all frequent phrases of 1 to ``longest`` words (codes, f)."""
    # Codes and keys follow from the words: they are left out of the shuffles and made again for what is frequent.
    counted = docs.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = materialise(counted.where(F.col("word").isNull() | (F.col("f") >= least)), name="counts")
    totals = counts.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = materialise(counts.where("word IS NOT NULL").mapInArrow(_with_codes, "lang string, word string, code long, f long"), name="words")
    if not words.groupBy("code").count().where("count > 1").isEmpty():
        raise ArithmeticError("two frequent words have the same 64 bits")
    found = words.select(F.col("code").alias("key"), F.col("code").alias("c1"), "f")
    phrases, size = found.select(F.array("c1").alias("codes"), "f"), 1
    while size < longest:
        level = _level(found, size)
        if not len(level.keys):
            break
        width = min(2 * size, longest)
        names = [f"c{i + 1}" for i in range(width)]
        likely = _likely(docs, level, longest, least) if size > 1 else None
        pairs = _count_pairs(docs, level, longest, likely).groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        longer = materialise(pairs, name=f"phrases{width}")
        phrases = phrases.unionByName(longer.select(F.array_compact(F.array(*names)).alias("codes"), "f"))
        if width < longest:  # then it is twice the level's size
            full = longer.select(*names, "f").where(F.col(names[-1]).isNotNull())
            found = full.mapInArrow(_with_keys, f"key long, {', '.join(f'{c} long' for c in names)}, f long")
        size = width
    return totals, words.select("lang", "word", "code", "f"), phrases


def _exact(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(19,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """codes, a, l, r, score of phrases of two words or more: the cut with the lowest score."""
    cuts = phrases.where(F.size("codes") > 1).select("codes", F.col("f").alias("a"), F.explode(
        F.sequence(F.lit(1), F.size("codes") - 1)).alias("k"))
    cuts = cuts.select("*", F.expr("slice(codes, 1, k)").alias("first"), F.expr("slice(codes, k + 1, size(codes) - k)").alias("rest"))
    with_l = spread_left_join(cuts, phrases.select(F.col("codes").alias("first"), F.col("f").alias("l")), "first", "codes")
    with_r = spread_left_join(with_l, phrases.select(F.col("codes").alias("rest"), F.col("f").alias("r")), "rest", "codes")
    quotient = F.expr(f"cast({SCALE} as decimal(19,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = with_r.withColumn("score", quotient).groupBy("codes", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return lowest.select("codes", "a", "c.l", "c.r", "c.score")


def _apart(found: DataFrame, phrases: DataFrame, percent: int) -> DataFrame:
    """Without the phrases of which a longer one takes ``percent`` of the occurrences or more."""
    longer = phrases.where(F.size("codes") > 2)
    parts = longer.select("f", F.explode(F.expr("""flatten(transform(sequence(2, size(codes) - 1), m ->
        transform(sequence(1, size(codes) - m + 1), i -> slice(codes, i, m))))""")).alias("codes"))
    most = parts.groupBy("codes").agg(F.max("f").alias("most"))
    inside = _exact(100) * _exact(F.col("most")) >= _exact(percent) * _exact(F.col("a"))
    return found.join(most, "codes", "left").where(F.coalesce(~inside, F.lit(True))).drop("most")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    a, l and r are the occurrences of the phrase and of both sides of its weakest cut, n all
    words of the language, score ``2,000,000 * a / (l + r)`` rounded down.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"),
                        F.col(text_col).cast("string").alias("text"))
    totals, words, phrases = frequent(texts, least, longest)
    stay = materialise(_apart(scored(phrases), phrases, inside_percent), name="scored")

    each = stay.select("codes", "a", "l", "r", "score", F.posexplode("codes").alias("at", "code"))
    spelled = spread_left_join(each, words.select("code", "lang", "word"), "code", "codes").groupBy("codes", "a", "l", "r", "score").agg(
        F.any_value("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = spelled.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "l", "r", "score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    n_buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_bucket = Window.partitionBy("lang", "bucket").orderBy(*order)
    first = named.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(n_buckets))).withColumn(
        "rank", F.row_number().over(in_bucket)).where(F.col("rank") <= top).drop("bucket", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
