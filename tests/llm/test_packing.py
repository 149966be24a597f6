import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keysift.llm import packing as P


def padded(lengths, counts, ends):
    return sum(c * min(e for e in ends if e >= n) for n, c in zip(lengths, counts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, k):
    lengths, counts = zip(*sorted(histogram.items()))
    ends = P.optimal_boundaries(lengths, counts, k)
    assert len(ends) <= k and ends[-1] == lengths[-1] and ends == sorted(set(ends))
    best = min(padded(lengths, counts, [*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
    assert padded(lengths, counts, ends) == best


def packed(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 0, "b") for i, t in rows], "doc_id long, text string, piece int, batch_id string").repartition(3)
    return [r.asDict() for r in P.pack(docs, P.byte_tokens(F.col("text")), **options).collect()]


def check(rows, out, max_len, budget):
    want = {}
    for i, t in rows:
        n = len((t or "").encode()) + 1
        for piece in range(-(-n // max_len)):
            key = (i, piece, min(max_len, n - piece * max_len))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in out:
        key = (r["doc_id"], r["piece"], r["n_tokens"])
        got[key] = got.get(key, 0) + 1
        assert r["n_tokens"] <= r["bucket_len"]
    assert got == want
    batches = {}
    for r in out:
        batches.setdefault(r["batch_id"], []).append(r)
    short = {}
    for rows_of in batches.values():
        length = {r["bucket_len"] for r in rows_of}
        assert len(length) == 1 and sorted(r["place"] for r in rows_of) == list(range(len(rows_of)))
        room = max(1, budget // length.copy().pop())
        assert len(rows_of) <= room
        if len(rows_of) < room:
            short[length.pop()] = short.get(rows_of[0]["bucket_len"], 0) + 1
    assert all(n == 1 for n in short.values())  # only a bucket's last batch may have room left
    lengths, counts = zip(*sorted({n: sum(c for (_, _, m), c in want.items() if m == n) for _, _, n in want}.items()))
    return lengths, counts


def test_pack(spark):
    rows = [(i, "x" * (i * 7 % 90)) for i in range(700)] + [(900, None), (901, ""), (902, "é" * 500), (1, "x"), (1, "x"), (None, "y")]
    out = packed(spark, rows, max_len=64, n_buckets=4, token_budget=256)
    lengths, counts = check(rows, out, 64, 256)
    assert sorted({r["bucket_len"] for r in out}) == P.optimal_boundaries(lengths, counts, 4)


def test_one_length_in_a_third_of_all_rows(spark):
    rows = [(i, "y" * (20 if i % 3 == 0 else i % 200)) for i in range(3000)]
    check(rows, packed(spark, rows, max_len=8192, n_buckets=8, token_budget=1000), 8192, 1000)


def test_nothing(spark):
    assert packed(spark, []) == []


def test_sequences_carry_their_ids(spark):
    rows = [(i, "aé😀 " * (i % 40)) for i in range(300)] + [(900, None), (901, ""), (902, "z" * 1000), (1, "aé😀 ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS total", "3 AS piece")
    out = P.pack(docs, P.byte_tokens(F.col("text")), max_len=64, n_buckets=4, token_budget=256, ids=P.byte_ids(F.col("text"))).collect()
    assert all(len(r["ids"]) == r["n_tokens"] for r in out)
    joined = {}
    for r in sorted(out, key=lambda r: r["piece"]):
        if r["doc_id"] != 1:
            joined[r["doc_id"]] = joined.get(r["doc_id"], b"") + bytes(r["ids"])
    assert joined == {i: (t or "").encode() + P.END_BYTE for i, t in rows if i != 1}
    assert sorted(bytes(r["ids"]) for r in out if r["doc_id"] == 1) == ["aé😀 ".encode() + P.END_BYTE] * 2
    check(rows, out, 64, 256)


def test_ids_of_several_bytes(spark):
    docs = spark.createDataFrame([(1, bytes(range(40)))], "doc_id long, raw binary")
    out = P.pack(docs, F.lit(10).cast("long"), max_len=4, ids=F.col("raw"), id_bytes=4).orderBy("piece").collect()
    assert [bytes(r["ids"]) for r in out] == [bytes(range(0, 16)), bytes(range(16, 32)), bytes(range(32, 40))]
