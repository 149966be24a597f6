"""An inverted index over the words of all contents, so that a later search need not scan them.

Layout under one folder that the cluster shares, all Parquet:

* ``words``     (word, token, n_files): every distinct word with its hash;
* ``postings``  (token, key) in hash buckets of the token, sorted by token;
* ``texts``     (key, content) in hash blocks of the key, sorted by key;
* ``about``     one row: numbers of buckets and blocks, name and type of the key, name of the content.  Written last, so
  that an index whose driver was lost half way cannot be opened.

A word is a longest run of ``[a-z0-9_]`` of the lower-cased content.  A phrase cut at other characters gives pieces:
one with text of the phrase on both sides is a whole word, one at an end of the phrase is an end, a start or any part
of a word.  A search matches the pieces with the word list, takes for each search the piece whose words stand in
the fewest files, reads the buckets of their postings and then the blocks that those files lie in, and verifies all phrases
on the texts.  Hashes may collide and pieces may stand far apart, which costs a look at a text and no row.

Defined cases.  A null content is not indexed and no search finds it; an empty one has no words.  A search with no piece, say
of punctuation alone, cannot use the index and scans all blocks.  Contents of any length are indexed whole.  Columns
other than the two named are not kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.catalog import Rule
from keysift.functions.bloom import bits_for, bloom_filter, may_hold
from keysift.functions.text import sql_text
from keysift.operators.candidates import requested_searches, visits_of
from keysift.plans.durable import materialise, release_shuffles

_PARTS_OF_BUCKET = 8
_ABOUT = "n_buckets int, n_blocks int, key string, key_type string, content string"

Piece = tuple[str, bool, bool]


def pieces(phrase: str) -> list[Piece]:
    """(text, starts a word, ends a word) of every run of word characters in a phrase."""
    lowered = phrase.lower()
    return [(m.group(), m.start() > 0, m.end() < len(lowered)) for m in re.finditer("[a-z0-9_]+", lowered)]


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int")


def _holds(piece: Piece) -> str:
    """SQL: does ``word`` hold the piece as the phrase asks?"""
    text, starts, ends = piece
    if starts and ends:
        return f"word = {sql_text(text)}"
    name = "startswith" if starts else "endswith" if ends else "contains"
    return f"{name}(word, {sql_text(text)})"


def build_phrase_index(files: DataFrame, path: str, key: str = "file_id", content: str = "content", n_buckets: int = 64,
                       n_blocks: int = 64) -> PhraseIndex:
    """Index ``files`` (unique ``key``) under ``path``, which must be new.

    Choose ``n_blocks`` so that a block has some hundred MB: a search reads whole blocks.
    Texts are shuffled once, to their blocks.  A frequent word's postings are dealt to several tasks of its bucket.
    """
    spark, path = files.sparkSession, path.rstrip("/")
    rows = files.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.col(content).alias("content"))
    (rows.withColumn("block", _block(n_blocks)).repartition("block").sortWithinPartitions("block", "key")
     .write.partitionBy("block").parquet(f"{path}/texts"))
    release_shuffles(spark)
    kind = dict(rows.dtypes)["key"]
    texts = spark.read.schema(f"key {kind}, content string, block int").parquet(f"{path}/texts")
    split = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9_]+"), F.lit(0)))
    held = texts.select("key", F.explode(split).alias("word"))
    held.groupBy("word").agg(F.count(F.lit(1)).alias("n_files")).select(
        "word", F.xxhash64("word").alias("token"), "n_files").write.parquet(f"{path}/words")
    release_shuffles(spark)
    posted = held.select(F.xxhash64("word").alias("token"), "key")
    part = F.pmod(F.xxhash64("key"), F.lit(_PARTS_OF_BUCKET))
    (posted.withColumn("bucket", F.pmod("token", F.lit(n_buckets)).cast("int")).repartition("bucket", part)
     .sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings"))
    about = spark.createDataFrame([(n_buckets, n_blocks, key, kind, content)], _ABOUT)
    about.coalesce(1).write.parquet(f"{path}/about")
    return PhraseIndex(spark, path)


class PhraseIndex:
    """Searches in what ``build_phrase_index`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")
        self._n_buckets, self._n_blocks, self._key, self._type, self._content = self._read("about", _ABOUT).first()

    def _read(self, name: str, schema: str) -> DataFrame:
        return self._spark.read.schema(schema).parquet(f"{self._path}/{name}")

    def texts(self) -> DataFrame:
        return self._read("texts", f"key {self._type}, content string, block int")

    def words(self) -> DataFrame:
        return self._read("words", "word string, token bigint, n_files bigint")

    def postings(self) -> DataFrame:
        return self._read("postings", f"token bigint, key {self._type}, bucket int")

    def search(self, secret_ids: Sequence[str] = ("ALL",), rules: Sequence[Rule] | None = None) -> DataFrame:
        """(query_ord, secret_id, key): the rows of ``candidate_visits`` over the indexed files."""
        searches = requested_searches(secret_ids, rules)
        pieces_of = {i: {p for phrase in rule.phrases for p in pieces(phrase)} for i, rule in searches}
        indexed = [(i, rule) for i, rule in searches if pieces_of[i]]
        scanned = [(i, rule) for i, rule in searches if not pieces_of[i]]
        found = visits_of(self._named(self.texts()), scanned, self._key, self._content)
        if indexed:
            found = found.unionByName(visits_of(self._named(self._candidates([pieces_of[i] for i, _ in indexed])),
                                                indexed, self._key, self._content))
        return found

    def _named(self, texts: DataFrame) -> DataFrame:
        return texts.select(F.col("key").alias(self._key), F.col("content").alias(self._content))

    def _candidates(self, searches: Sequence[Iterable[Piece]]) -> DataFrame:
        """Texts of all files that may match one of the searches, each given by its pieces."""
        listed = sorted({p for wanted in searches for p in wanted})
        cases = ", ".join(f"CASE WHEN {_holds(p)} THEN {n} END" for n, p in enumerate(listed))
        matched = materialise(self.words().select("token", "n_files", F.explode(F.expr(f"array_compact(array({cases}))")).alias("piece")),
                              name="pieces")
        cost = {listed[r["piece"]]: r["n"] for r in matched.groupBy("piece").agg(F.sum("n_files").alias("n")).collect()}  # a row per piece
        chosen = {min(wanted, key=lambda p: (cost.get(p, 0), p)) for wanted in searches}
        numbers = [n for n, p in enumerate(listed) if p in chosen]
        tokens = matched.where(F.col("piece").isin(numbers)).select("token").distinct()

        postings = self.postings()
        postings = postings.where(F.col("bucket").isin(self._buckets(tokens)))
        files = materialise(postings.join(tokens, "token", "left_semi").select("key").distinct(), name="postings")
        blocks = [r["block"] for r in files.select(_block(self._n_blocks).alias("block")).distinct().collect()]  # at most n_blocks
        texts, bits = self.texts().where(F.col("block").isin(blocks)), bits_for(files.count())
        if bits is not None:
            texts = texts.where(may_hold(bloom_filter(files, "key", bits), F.col("key"), bits))
        return texts.join(files, "key", "left_semi")

    def _buckets(self, tokens: DataFrame) -> list[int]:
        """The buckets the tokens fall into, at most ``n_buckets``."""
        bucket = F.pmod("token", F.lit(self._n_buckets)).cast("int").alias("b")
        return [r["b"] for r in tokens.select(bucket).distinct().collect()]
