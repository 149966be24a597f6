"""Language identification by the nearest of several centroids per language.

A text becomes a vector of its byte trigrams around letters, hashed into ``DIMS`` places:
logarithmic counts times inverse document frequency, scaled to length one.  Digits and
punctuation count as spaces and letter case of Latin letters is ignored, so decoration
and shouting do not move a text.  Each language is
described by ``CENTROIDS`` centroids, found by clustering the vectors of its sample with
cosine as closeness.  A text gets the language of the nearest centroid, and is rejected
where even that one is farther away than nearly all of its own language's sample.

Learning uses about ``PER_LANGUAGE`` labelled documents of each language, a bound that
holds at every size of corpus: rows are chosen by a hash of their id against the
language's count.  Only these vectors reach the driver.  Prediction is one narrow stage
over whole texts, in blocks of bounded bytes.

Defined cases.  A null text, an empty one or one without any letter is ``und`` with
score 0 and rejected.  Without a single labelled row nothing can be learned: every text
is ``und`` with score 0, and those with letters are not rejected.  Equal closeness goes
to the alphabetically first language.  Repeated rows are judged alike; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.blocks import text_blocks

DIMS = 4096
CENTROIDS = 4
# Labelled documents per language that the centroids are learned from.
PER_LANGUAGE = 400
# A text is rejected below this share of the closeness that its language's least typical
# sample documents have.
REJECT_SHARE, REJECT_QUANTILE = 0.3, 0.01
UNDETERMINED = "und"

# ASCII letters in lower case, other ASCII as spaces, bytes of other letters as they are.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PIECE = 4 << 20


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every trigram; each text counts with a space on either side."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(_LETTERS), np.uint8).astype(np.uint32)
    # Capital letters of the Latin-1 supplement, two bytes each in UTF-8.
    capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[1:] += 32 * capital.astype(np.uint32)
    codes = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:] if len(data) > 2 else np.zeros(0, np.uint32)
    last = np.cumsum(lengths + 1) - 1  # where a window would reach into the next text
    inside = np.ones(len(data), bool)
    inside[last] = False
    around_letter = (data[1:-1] != 32)[inside[:len(codes)]]
    codes = codes[inside[:len(codes)]][around_letter]
    rows = np.repeat(np.arange(len(texts)), lengths)[:len(around_letter)][around_letter]
    return rows, (codes * np.uint32(2654435761)) >> np.uint32(20)


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed trigrams, one row per text; very long texts are counted piece by piece."""
    counts = np.zeros((len(texts), DIMS), np.float32)
    short = [i for i, t in enumerate(texts) if len(t) <= _PIECE]
    if short:
        rows, places = _trigrams([texts[i] for i in short])
        counts[short] = np.bincount(rows * DIMS + places, minlength=len(short) * DIMS).reshape(-1, DIMS)
    for i in set(range(len(texts))) - set(short):
        for at in range(0, len(texts[i]), _PIECE):
            rows, places = _trigrams([texts[i][max(0, at - 2):at + _PIECE]])
            counts[i] += np.bincount(places, minlength=DIMS)
    return counts


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row per centroid
    owner: np.ndarray  # index of a centroid's language
    least: np.ndarray  # closeness below which a language's texts are rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and rejections of texts that hold a letter."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        close = self.vectors(trigram_counts(texts)) @ self.centroids.T
        best = self.owner[np.argmax(close, axis=1)]
        score = np.clip(close.max(axis=1), 0, 1).astype(np.float64)
        return [self.languages[i] for i in best], score, score < self.least[best]


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
    return (rows / np.maximum(norm, 1e-12)[:, None]).astype(np.float32)


def _cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Centroids of length one by cosine k-means, started from far-apart rows."""
    centroids = _unit(rows.mean(axis=0, keepdims=True))
    while len(centroids) < min(k, len(rows)):
        centroids = np.vstack([centroids, rows[np.argmin((rows @ centroids.T).max(axis=1))]])
    for _ in range(10):
        nearest = np.argmax(rows @ centroids.T, axis=1)
        centroids = _unit(np.stack([rows[nearest == c].mean(axis=0) if (nearest == c).any() else centroids[c]
                                    for c in range(len(centroids))]))
    return centroids


def learn(labels: list[str], counts: np.ndarray) -> Model:
    languages = sorted(set(labels))
    idf = (np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors, label = _unit(np.log1p(counts) * idf), np.asarray(labels)
    centroids, owner, least = [], [], []
    for i, language in enumerate(languages):
        own = vectors[label == language]
        found = _cluster(own, CENTROIDS)
        centroids.append(found)
        owner += [i] * len(found)
        least.append(REJECT_SHARE * float(np.quantile((own @ found.T).max(axis=1), REJECT_QUANTILE)))
    return Model(languages, idf, np.vstack(centroids) if centroids else np.zeros((0, DIMS), np.float32),
                 np.asarray(owner, int), np.asarray(least))


def held_out(id_col: str) -> Column:
    """A fifth of all documents, by id; never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from labelled documents that are not held out."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
                        & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                                                    F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return learn([], np.zeros((0, DIMS), np.float32))
    chance = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, PER_LANGUAGE / n))) for k, n in sorted(counts.items())))
    sample = usable.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < chance * (1 << 20))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_blocks(batch["text"]):
                rows = trigram_counts(texts)
                yield pa.record_batch([batch["lang"].slice(first, len(texts)), batch["id"].slice(first, len(texts)).cast(pa.string()),
                                       pa.array([np.flatnonzero(r).astype(np.int32) for r in rows], pa.list_(pa.int32())),
                                       pa.array([r[r > 0] for r in rows], pa.list_(pa.float32()))],
                                      names=["lang", "id", "places", "counts"])

    learned = sample.mapInArrow(vectors, "lang string, id string, places array<int>, counts array<float>").collect()
    learned.sort(key=lambda r: (r["lang"], r["id"]))
    matrix = np.zeros((len(learned), DIMS), np.float32)
    for row, r in zip(matrix, learned):
        row[r["places"]] = r["counts"]
    told = matrix.any(axis=1)  # a text without letters says nothing about its language
    return learn([r["lang"] for r, t in zip(learned, told) if t], matrix[told])


def _judged(batch: pa.RecordBatch, text_col: str, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of every row."""
    languages, scores, rejected = [], [], []
    letters = pc.fill_null(pc.match_substring_regex(batch[text_col].cast(pa.large_string()), r"\p{L}"), False)
    letters = np.asarray(letters.to_numpy(zero_copy_only=False), bool)
    for first, texts in text_blocks(batch[text_col]):
        has = letters[first:first + len(texts)]
        found, score, reject = model.predict(texts)
        languages += [name if ok else UNDETERMINED for name, ok in zip(found, has)]
        scores.append(np.where(has, score, 0.0))
        rejected.append(np.where(has, reject, True))
    if not languages:
        return [], np.zeros(0), np.zeros(0, bool)
    return languages, np.concatenate(scores), np.concatenate(rejected)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores, rejected = _judged(batch, "text", shared.value)
            yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(languages, pa.string()),
                                   pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                                  names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that ``identify`` rejects; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~_judged(batch, text_col, shared.value)[2].astype(bool)))

    return docs.mapInArrow(keep, docs.schema)
