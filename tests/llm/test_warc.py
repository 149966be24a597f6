import gzip
import hashlib

import pytest

from keysift.llm import warc as A
from keysift.llm.files import open_file

BIG, BIG2 = "<p>" + "é" * 700, "<p>" + "z" * 30_000
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a b\r\n/x", None), (5, "u", ""), (6, "u", "small"),
        (7, "u", "small"), (8, "u", BIG2), (9, "u", BIG2), (9, "u", BIG2), (10, "u", "x" * 1000), (11, "u", "x" * 1000), (12, "u", "x" * 999),
        (13, "u", "x" * 999), (-5, "u", BIG)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "d") for i, u, h in rows], "page_id long, url string, html string, n int, digest string").repartition(3)


def brute(rows):
    largest = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            largest[h] = max(largest.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = largest.get(h)
        again = first is not None and i != first
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 37, 500, 1 << 23])
def test_every_record_is_read_once_for_any_ranges(spark, size):
    archives = A.write_archives(pages(spark, ROWS))
    if size == 1:
        archives = archives.where("n_bytes < 4000")
        n = archives.agg({"n_records": "sum"}).first()[0] or 0
        assert A.read_archives(spark, archives, size).count() == n
    else:
        assert sorted(map(tuple, A.read_archives(spark, archives, size).collect()), key=str) == brute(ROWS)


def test_a_payload_in_a_third_of_all_pages(spark):
    rows = [(i, "u", BIG if i % 3 == 0 else f"{i}" * 400) for i in range(300)]
    got = A.read_archives(spark, A.write_archives(pages(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_no_pages_and_no_ids(spark):
    assert A.read_archives(spark, A.write_archives(pages(spark, []))).count() == 0
    got = A.read_archives(spark, A.write_archives(pages(spark, [(None, "u", BIG), (None, None, None), (4, "u", BIG)]))).collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == [
        ("4", "response", "None"), ("None", "response", "None"), ("None", "revisit", "4")]


@pytest.mark.parametrize("size", [5000, 1 << 23])
def test_very_long_urls(spark, size):
    digits = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(3200))
    rows = [(1, "u", "a"), (2, " " * 200_000, "b"), (3, "data:," + digits, BIG), (4, "http://a/" + "é" * 100_000, BIG), (5, "u", "c")]
    assert sorted(map(tuple, A.read_archives(spark, A.write_archives(pages(spark, rows)), size).collect()), key=str) == brute(rows)


def test_fewer_records_than_written_are_an_error_unless_damaged(spark, tmp_path):
    members = [A._member(A._record(i, "u", b"x" * 50, None)) for i in range(4)]
    path = tmp_path / "a.warc.gz"

    def read(data, n_records):
        path.write_bytes(data)
        archives = spark.createDataFrame([(f"file://{path}", len(data), n_records)], "uri string, n_bytes long, n_records long")
        return sorted(r.page_id for r in A.read_archives(spark, archives, 100).collect())

    assert read(b"".join(members), 4) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="fewer records"):
        read(members[0] + gzip.compress(b"WARC/1.1 not a record") + members[2], 3)
    assert read(members[0] + members[1][:40] + b"\0" + members[1][41:] + members[2], 3) == [0, 2]


def test_archives_are_gzip_members_of_the_format(spark):
    archive = A.write_archives(pages(spark, ROWS)).orderBy("n_records", ascending=False).first()
    with open_file(archive.uri) as file:
        data = file.read()
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == archive.n_records and text.endswith(b"\r\n\r\n")


def test_damage_and_false_magic_are_passed_over(tmp_path):
    good = [A._member(A._record(i, "u", b"x" * 50, None)) for i in range(4)]
    stray = b"\x1f\x8b\x08" + b"\0" * 30 + gzip.compress(b"not a record") + b"\x1f\x8b"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(stray + good[0] + stray + good[1] + good[2][:-20] + stray + good[3])
    with open_file(f"file://{path}") as file:
        whole = [r.fields["x-page-id"] for r in A.RangeReader(file, 0, file.size()).records()]
        parts = [r.fields["x-page-id"] for at in range(0, file.size(), 64) for r in A.RangeReader(file, at, at + 64).records()]
    assert whole == parts == ["0", "1", "3"]
