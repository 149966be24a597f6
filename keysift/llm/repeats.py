"""Removal of passages that repeat across the corpus, located by a join of hashed phrases.

A window is ``n`` consecutive words.  Every word covered by a window whose words also
start earlier in the corpus is removed.

1.  Recurring phrases.  Each window is represented by the phrase of ``PHRASE`` words in it
    with the smallest hash.  Equal windows have equal phrases and neighbouring windows
    mostly share one, so a text has about one phrase in seven words.  Phrases that occur
    twice are confirmed by counting all of them, aggregated before the shuffle.
2.  Location.  Documents meet the recurring phrases that they hold, in a join on the hash of
    the phrase: it moves 64 bits a phrase, where automata over all phrases would grow with
    the corpus, or need every text in every shard.  The phrases a document holds are known
    after that, and give the runs of windows that may recur.  Each block of documents also
    compiles its phrases into an automaton that streams its texts.  It finds the same
    phrases again and so changes no result.
3.  Windows.  Runs with equal words are reduced to the first of them, in one aggregation
    that also collapses copied documents, and the windows of those are grouped: the
    first place of every window stays.  All other windows in located runs are repeats.
4.  Removal.  Each document meets its runs and first places, covers the words of the
    repeats and keeps the rest.

Texts move twice, by document id.  Hot phrases are counts, minima or splittable joins.

Defined cases.  A null text has no words.  Texts shorter than a window are kept whole.
Documents are ordered by id and ids should be unique; rows that repeat an id and its
text are one document and judged alike.  Rows without an id are kept whole.  No rows
give no rows.  Words are compared by hashes: a window by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.blocks import text_blocks
from keysift.llm.words import mixed, powers, sequence_hashes, words_of
from keysift.plans.durable import materialise, release_shuffles

WINDOW = 20
PHRASE = 8
LETTERS = 3
# Documents that share an automaton.
SHARD_BYTES, SHARD_ROWS = 2 << 20, 1024

_inverse_powers = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    """Inverses of the first n powers of the hash base, modulo 2^64."""
    global _inverse_powers
    if len(_inverse_powers) < n:
        base = np.full(n, np.uint64(pow(int(powers(2)[1]), -1, 1 << 64)), np.uint64)
        base[0] = 1
        _inverse_powers = np.multiply.accumulate(base)
    return _inverse_powers[:n]


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in every ``width`` consecutive ones; widths double until they cover it."""
    best, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        have += step
    return best


@dataclass(frozen=True)
class Runs:
    """Runs of windows that share a phrase, in order of the texts."""

    text: np.ndarray  # index of the text
    phrase: np.ndarray  # place of the phrase among all words, and its hash
    phrase_hash: np.ndarray
    start: np.ndarray  # place of the first and the last window among all words
    last: np.ndarray


def runs_of(hashes: np.ndarray, first: np.ndarray, n: int) -> Runs:
    """The runs of texts whose words have ``hashes``; text k begins at word ``first[k]``."""
    empty = np.zeros(0, np.int64)
    if len(hashes) < n:
        return Runs(empty, empty, np.zeros(0, np.uint64), empty, empty)
    phrases = sequence_hashes(hashes, PHRASE)
    best = _smallest(phrases, n - PHRASE + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(best)]
    whole = np.arange(len(best)) + n <= first[text + 1]
    places, best, text = np.flatnonzero(whole), best[whole], text[whole]
    if not len(places):
        return Runs(empty, empty, np.zeros(0, np.uint64), empty, empty)
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(places)]]) - 1
    return Runs(text[begin], best[begin], phrases[best[begin]], places[begin], places[end])


class Hashes:
    """Hashes of any stretch of words, from sums up to every word."""

    def __init__(self, words: np.ndarray):
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(len(words)))]) if len(words) else None
        self._inverse = _inverses(len(words)) if len(words) else None

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


def _phrases(docs: DataFrame, n: int) -> DataFrame:
    """phrase, doc_id of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch["text"]):
                words = words_of(texts)
                runs = runs_of(words.hashes, words.first, n)
                yield pa.record_batch([batch["doc_id"].slice(first, len(texts)).take(pa.array(runs.text)),
                                       pa.array(runs.phrase_hash.view(np.int64))], names=["doc_id", "phrase"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, phrase long")


def spelled(hashes: np.ndarray) -> str:
    """``LETTERS`` letters for every word.

    Automata take long to leave a node with many children, and one letter a word would
    give the root as many as there are words; 64 letters do not.
    """
    out = np.empty((len(hashes), LETTERS), np.uint8)
    for k in range(LETTERS):
        out[:, k] = ((hashes >> np.uint64(20 + 6 * k)) & np.uint64(63)).astype(np.uint8) + 48
    return out.tobytes().decode("ascii")


def compiled(text: str, places: np.ndarray) -> ahocorasick.Automaton | None:
    """An automaton that finds the phrases at ``places`` (counted in words) of a spelled text."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for at in (places * LETTERS).tolist():
        automaton.add_word(text[at:at + PHRASE * LETTERS])
    if not len(places):
        return None
    automaton.make_automaton()
    return automaton


def located(automaton: ahocorasick.Automaton, text: str) -> np.ndarray:
    """The words at which a phrase begins."""
    ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64) + 1
    return ends[ends % LETTERS == 0] // LETTERS - PHRASE


def _located(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, phrase, run (hash of its words and of where the phrase stands), start, windows (hash of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch["text"], SHARD_BYTES, SHARD_ROWS):
                words = words_of(texts)
                runs = runs_of(words.hashes, words.first, n)
                lists = batch["phrases"].slice(first, len(texts))
                recurring = np.unique(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64)
                letters = spelled(words.hashes)
                _, distinct = np.unique(runs.phrase_hash, return_index=True)
                known = distinct[np.isin(runs.phrase_hash[distinct], recurring)]
                automaton = compiled(letters, runs.phrase[known])
                if automaton is None:
                    continue
                found = np.zeros(len(words.hashes), bool)
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                    if b - a >= n:
                        found[located(automaton, letters[a * LETTERS:b * LETTERS]) + a] = True
                # Words may be spelled alike, so what was located is confirmed by its hash.
                hit = np.flatnonzero(found[runs.phrase])
                hit = hit[np.isin(runs.phrase_hash[hit], recurring)]
                if not len(hit):
                    continue
                text, start, last, sums = runs.text[hit], runs.start[hit], runs.last[hit], Hashes(words.hashes)
                stretch = mixed(sums.of(start, last + n) + (runs.phrase[hit] - start).astype(np.uint64))
                sizes = last - start + 1
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                each = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, sizes)
                yield pa.record_batch(
                    [batch["doc_id"].slice(first, len(texts)).take(pa.array(text)), pa.array(runs.phrase_hash[hit].view(np.int64)),
                     pa.array(stretch.view(np.int64)), pa.array((start - words.first[text]).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sums.of(each, each + n).view(np.int64)))],
                    names=["doc_id", "phrase", "run", "start", "windows"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, phrase long, run long, start int, windows array<long>")


def repeated_places(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, runs (start and number of windows of every located run), firsts (windows that stay)."""
    spark = rows.sparkSession
    occurrences = _phrases(rows, n)
    # Written down, so that the join below starts from two shuffles and a hot phrase can be split.
    recurring = materialise(occurrences.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("phrase"),
                            name="phrases")
    release_shuffles(spark)
    held = occurrences.join(recurring, "phrase", "left_semi").groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases"))
    located = materialise(_located(rows.join(held, "doc_id").select("doc_id", "text", "phrases"), n), name="located")
    release_shuffles(spark)

    place = F.struct("doc_id", "start")
    first_runs = located.groupBy("phrase", "run").agg(F.min(place).alias("place"), F.min_by("windows", place).alias("windows"))
    windows = first_runs.select("phrase", "place.doc_id", "place.start", F.posexplode("windows").alias("at", "window")).select(
        "phrase", "window", "doc_id", (F.col("start") + F.col("at")).alias("start"))
    first_windows = windows.groupBy("phrase", "window").agg(F.min(place).alias("place"))
    firsts = first_windows.select("place.*").groupBy("doc_id").agg(F.collect_list("start").alias("firsts"))
    runs = located.groupBy("doc_id").agg(F.collect_list(F.struct("start", F.size("windows").alias("n"))).alias("runs"))
    out = materialise(runs.join(firsts, "doc_id", "left"), name="places")
    release_shuffles(spark)
    return out


def kept_words(text: bytes, runs: list[dict] | None, firsts: np.ndarray, n: int) -> tuple[int, bytes]:
    """Number of words, and the words that stay joined by spaces."""
    words = text.split()
    if not runs:
        return len(words), b" ".join(words)
    repeat = np.zeros(len(words) + 1, bool)
    for run in runs:
        repeat[run["start"]:run["start"] + run["n"]] = True
    repeat[firsts] = False
    starts = np.flatnonzero(repeat)
    cover = np.zeros(len(words) + n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + n, -1)
    gone = np.cumsum(cover)[:len(words)] > 0
    return len(words), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def remove_repeats(docs: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (or its SHA-256 as kept_sha256) of every document."""
    if n < PHRASE:
        raise ValueError(f"a window has at least {PHRASE} words")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(repeated_places(rows.where("doc_id IS NOT NULL"), n), "doc_id", "left")
    kept = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch["text"]):
                out = []
                for text, runs, firsts in zip(texts, batch["runs"].slice(first, len(texts)), batch["firsts"].slice(first, len(texts))):
                    places = np.asarray(firsts.as_py() or [], np.int64)
                    n_words, stay = kept_words(text, runs.as_py(), places, n)
                    n_kept = stay.count(b" ") + 1 if stay else 0
                    out.append((n_words, n_words - n_kept, hashlib.sha256(stay).hexdigest() if digest else stay.decode("utf-8", "replace")))
                counts, removed, kept_values = zip(*out)
                yield pa.record_batch([batch["doc_id"].slice(first, len(texts)), pa.array(counts, pa.int64()),
                                       pa.array(removed, pa.int64()), pa.array(kept_values, pa.string())],
                                      names=["doc_id", "n_words", "n_removed", kept])

    kind = dict(rows.dtypes)["doc_id"]
    return joined.select("doc_id", "text", "runs", "firsts").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, {kept} string")
