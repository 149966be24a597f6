"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from keysift.llm import (bitplanes, bpe, collocations, content_sort, conversations, cover_tree, decontaminate, jaccard_regions, langid, ownership,
                         packing, repeats, warc)
from keysift.llm.word_ids import word_encoder
from keysift.llm.workers import ship

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.byte_tokens(F.col("text")),
                        ids=packing.byte_ids(F.col("text")))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ownership.secret_spans(docs, repo=F.concat_ws("/", "source", "lang"), owner="source").drop("found")


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")

    def encoder():
        words = word_encoder(path)
        return words.ids, words.width

    manifest = bitplanes.write_shards(_table(spark, sf_dir, "documents"), encoder, end_id=1)
    return bitplanes.read_shards(spark, manifest)


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_groups(_table(spark, sf_dir, "documents"))


def op8_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_regions.near_duplicates(_table(spark, sf_dir, "documents"), percent=90, n_words=3)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), digest=True)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(spark, warc.write_archives(_table(spark, sf_dir, "pages")))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault in one row of four, chosen by a checksum of its place; ``present`` is false where a row goes."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", as_text("conv_id"), as_text("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(as_text("role")).alias("role"), text.alias("text"),
                       (fault != 0).alias("present"), F.explode(copies).alias("copy"))


def op11_interval_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_summary(damaged(_table(spark, sf_dir, "conversations")), F.col("present"))


def op12_benchmark_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_pair_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_packing, op2_secret_ownership, op3_cover_tree, op4_language, op5_transducer, op6_bit_planes, op7_content_sort,
        op8_jaccard_regions, op9_repeated_passages, op10_warc, op11_interval_repair, op12_benchmark_prefixes, op13_pair_tiles, pipeline)


def _with_package(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _with_package(f) for f in _ALL}


_WHITE = r"'[\x20\x09-\x0D]'"

_OP7 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), {_WHITE}, '', 'g') AS content
           FROM documents),
     g AS (SELECT content, count(*) AS group_size, first(doc_id ORDER BY length(raw) DESC, doc_id) AS keep_id
           FROM t GROUP BY content)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.content) AS text_sha256
FROM t JOIN g USING (content)"""

_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

_OP10 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     g AS (SELECT payload, max(page_id) AS first_id FROM p WHERE octet_length(payload) >= 1000 GROUP BY payload)
SELECT page_id, octet_length(p.payload) AS payload_bytes, sha1(p.payload) AS payload_digest,
       CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload)"""

# The checksum by its polynomial, then the cheapest edits turn by turn over the pattern's states (0: nothing, 1: s, 2: u, 3: a).
_OP11 = r"""
WITH RECURSIVE
     crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
                        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
     keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                      concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k
               FROM conversations),
     summed AS (SELECT keyed.*, xor(4294967295, list_reduce(
                    list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
                    lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]))) % 20 AS fault FROM keyed, crc),
     damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                        CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                        unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
                 FROM summed WHERE fault <> 0),
     placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                       row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
                       regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM damaged),
     judged AS (SELECT *, left(role, 1) AS x, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd'
                       WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM placed),
     steps AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) s(p, x, q)),
     ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'),
                                   (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')) v(p, q, c, e)),
     edits AS (SELECT conv_id, i, p.p, p.p AS q, 2 AS c, 'D' AS e, '' AS put FROM judged, (SELECT DISTINCT p FROM ins) p
               UNION ALL
               SELECT conv_id, i, p, q, CASE f WHEN 't' THEN 5 ELSE 0 END, 'K', role || ':' || text
               FROM judged JOIN steps USING (x) WHERE f NOT IN ('b', 'd')
               UNION ALL
               SELECT conv_id, i, p, q, CASE f WHEN 't' THEN 6 ELSE 1 END, 'R',
                      CASE s.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
               FROM judged, steps s WHERE f NOT IN ('b', 'd') AND s.x <> 's'),
     best(conv_id, i, q, w) AS (
         SELECT conv_id, CAST(0 AS BIGINT), q, {'c': CAST(c AS BIGINT), 'e': e,
                'r': list_transform(range(len(e)), lambda k: CASE WHEN (k % 2 = 0) THEN 'user:' ELSE 'assistant:' END)}
         FROM (SELECT DISTINCT conv_id FROM damaged) c, ins WHERE p = 0
         UNION ALL
         SELECT b.conv_id, b.i + 1, n.q, min({'c': b.w.c + t.c + n.c, 'e': b.w.e || t.e || n.e,
                'r': b.w.r || CASE WHEN t.e = 'D' THEN [] ELSE [t.put] END || list_transform(range(len(n.e)), lambda k:
                         CASE WHEN (k % 2 = 0) = (t.q <> 2) THEN 'user:' ELSE 'assistant:' END)})
         FROM best b JOIN edits t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i + 1 = t.i AND b.q = t.p JOIN ins n ON n.p = t.q
         GROUP BY b.conv_id, b.i, n.q),
     ended AS (SELECT b.conv_id, min(b.w) AS w
               FROM best b JOIN (SELECT conv_id, max(i) AS i FROM judged GROUP BY conv_id) l
                    ON b.conv_id IS NOT DISTINCT FROM l.conv_id AND b.i = l.i
               WHERE b.q IN (0, 3) GROUP BY b.conv_id),
     pairs AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM judged),
     counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
                       count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
                       count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal
                FROM pairs GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.e, '') AS audit,
       sha256(coalesce(array_to_string(w.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
     LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     v AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT len(win) AS size FROM v),
     places AS (SELECT row, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
     found AS (SELECT p.row, p.i, p.size, v.item_id FROM places p JOIN v ON list_slice(p.w, p.i, p.i + p.size - 1) = v.win),
     hit AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS word FROM found) GROUP BY row),
     items AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
               FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)"""

_OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
     p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
     n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
     g AS (SELECT lang, list_slice(w, i, i + m - 1) AS g FROM (
               SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
     f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 30),
     cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
     s AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, len(c.g))),
     best AS (SELECT lang, g, a, unnest(min({'score': score, 'k': k, 'l': l, 'r': r})) FROM s GROUP BY lang, g, a),
     parts AS (SELECT lang, list_slice(g, i, i + m - 1) AS g, max(f) AS most FROM (
                   SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE len(g) > m)
               GROUP BY 1, 2),
     stay AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN parts q ON q.lang = b.lang AND q.g = b.g
              WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    sql = {"op7_content_sort": _OP7, "op3_cover_tree": _OP3, "op10_warc": _OP10, "op11_interval_repair": _OP11, "op12_benchmark_prefixes": _OP12, "op13_pair_tiles": _OP13}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
