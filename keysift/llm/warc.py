"""WARC archives: written with duplicates as revisit records, read in byte ranges.

Writing.  Payloads of at least ``LEAST_BYTES`` are grouped by digest with partial
counts; the row with the largest id is the response of its group and the others become
revisit records that refer to it.  Only ids and digests move for that.  Each task writes
one archive, a gzip member per record.

Reading.  An archive is cut into byte ranges of fixed size, one task each.  A task looks
for gzip magic from the start of its range on and accepts a place only if what
decompresses there begins with a whole WARC header.  From there it decodes member after
member; it owns the records that start inside its range and reads past its end to
finish the last.  So every record is read once, and ranges need no index.  Damage inside
a member is passed over by looking for the next accepted place.  Records read are counted
by archive; one that is not damaged and gives fewer than were written is an error.

Defined cases.  A null payload is empty.  Rows repeated with the same id and payload are
all responses if theirs is the largest id.  A null id is written without an id field
and comes back null; it counts as smaller than any other.  No rows give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.files import new_file, open_file
from keysift.plans.durable import materialise, scratch_dir

LEAST_BYTES = 1000
RANGE_BYTES = 8 << 20
_READ = 1 << 18
_MAGIC = b"\x1f\x8b\x08"
# Fixed values of the format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
# So much of a header is decompressed at a time.  Headers hold URLs and have no largest size.
_HEADER_STEP = 1 << 16


def _urn(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=page_id % (1 << 128))}>"


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", _DATE),
              ("WARC-Record-ID", _urn(page_id) if page_id is not None else f"<{uuid.uuid4().urn}>"),
              ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    block = http + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    header = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return header + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row; the manifest of archives: uri, n_bytes, n_records."""
    spark = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"))
    large = rows.select("page_id", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("digest")).where(
        F.col("n") >= LEAST_BYTES)
    # Written down, so that the join below starts from two shuffles and a hot payload can be split.
    groups = materialise(large.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
                         .where("n > 1"), name="groups")
    # Ids only: the payloads meet this list by their own id, which no group shares.
    revisits = (large.join(groups.select("digest", "first_id"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
                .select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "first_id").distinct())
    typed = rows.withColumn("digest", F.when(F.octet_length("payload") >= LEAST_BYTES, F.sha2("payload", 256))).join(
        revisits, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out, size, n = None, None, 0, 0
        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "payload", "first_id"))):
                if out is None:
                    uri, out = new_file(folder, ".warc.gz")
                data = _member(_record(*(v.as_py() for v in row)))
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.record_batch([[uri], [size], [n]], names=["uri", "n_bytes", "n_records"])

    written = typed.select("page_id", "url", "payload", "first_id").mapInArrow(
        write, "uri string, n_bytes long, n_records long")
    return materialise(written, name="archives")


@dataclass(frozen=True)
class Record:
    start: int
    fields: dict[str, str]
    block: bytes


class RangeReader:
    """The records of one archive that start in [begin, end)."""

    def __init__(self, file, begin: int, end: int):
        self._file, self._end, self._size = file, min(end, file.size()), file.size()
        self._at, self._data = begin, b""  # _data holds the bytes from _at on

    def _fill(self, n: int) -> None:
        """Hold at least n bytes from the current place, as far as the file goes."""
        while len(self._data) < n and self._at + len(self._data) < self._size:
            at = self._at + len(self._data)
            self._data += self._file.read_at(min(max(_READ, n - len(self._data)), self._size - at), at)

    def _skip(self, n: int) -> None:
        self._at, self._data = self._at + n, self._data[n:]

    def _find(self) -> bool:
        """Move to the next gzip magic inside the range."""
        while self._at < self._end:
            self._fill(_READ)
            found = self._data.find(_MAGIC)
            if found >= 0:
                self._skip(found)
                return self._at < self._end
            self._skip(max(1, len(self._data) - len(_MAGIC) + 1))
        return False

    def _accepted(self) -> bool:
        """Whether a member starts here whose text begins with a whole header."""
        unpack, text, at = zlib.decompressobj(31), bytearray(), 0
        try:
            while not unpack.eof:
                piece = unpack.unconsumed_tail
                if not piece:
                    self._fill(at + 4096)
                    piece = self._data[at:at + 4096]
                    at += len(piece)
                if not piece:
                    break
                searched = max(0, len(text) - 3)
                text += unpack.decompress(piece, _HEADER_STEP)
                if len(text) >= len(VERSION) and not text.startswith(b"WARC/1."):
                    return False
                end = text.find(b"\r\n\r\n", searched)
                if end >= 0:
                    return parse_header(bytes(text[:end])) is not None
        except zlib.error:
            pass
        return False

    def _decode(self) -> tuple[bytes, int] | None:
        """The whole member here and its length in the file; None if it is damaged."""
        unpack, parts, at = zlib.decompressobj(31), [], 0
        try:
            while not unpack.eof:
                self._fill(at + 1)
                piece = self._data[at:at + _READ]
                if not piece:
                    return None
                parts.append(unpack.decompress(piece))
                at += len(piece)
        except zlib.error:
            return None
        return b"".join(parts), at - len(unpack.unused_data)

    def records(self) -> Iterator[Record]:
        while self._find():
            member = self._decode() if self._accepted() else None
            parsed = parse_record(member[0]) if member else None
            if parsed is None:
                self._skip(1)
                continue
            yield Record(self._at, *parsed)
            self._skip(member[1])

    def intact(self) -> bool:
        """Whether whole gzip members follow one another from here to the end of the file."""
        while self._at < self._size:
            member = self._decode()
            if member is None:
                return False
            self._skip(member[1])
        return True


def parse_header(header: bytes) -> dict[str, str] | None:
    """Fields by lower-case name; None unless it is a record's header with a length."""
    lines = header.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if fields.get("content-length", "").isdigit() else None


def parse_record(text: bytes) -> tuple[dict[str, str], bytes] | None:
    end = text.find(b"\r\n\r\n")
    fields = parse_header(text[:end]) if end >= 0 else None
    if fields is None:
        return None
    block = text[end + 4:end + 4 + int(fields["content-length"])]
    return (fields, block) if len(block) == int(fields["content-length"]) else None


def _row(record: Record) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record as it was read."""
    fields = record.fields
    head, _, payload = record.block.partition(b"\r\n\r\n")
    number = lambda name: int(fields[name]) if name in fields else None
    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "revisit":
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        return number("x-page-id"), size, stated, "revisit", number("x-refers-to-page-id")
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"payload of record at {record.start} does not match its digest")
    return number("x-page-id"), len(payload), digest, fields["warc-type"], None


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in ``archives`` (uri, n_bytes).

    Where ``archives`` states ``n_records`` too, undamaged archives that give fewer are an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin in zip(batch["uri"].to_pylist(), batch["begin"].to_pylist()):
                with open_file(uri) as file:
                    rows = [(uri, *_row(r)) for r in RangeReader(file, begin, begin + range_bytes).records()]
                if rows:
                    yield pa.record_batch(
                        [pa.array(c, t) for c, t in zip(
                            zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                        names=["uri", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    size = F.lit(range_bytes)
    ranges = archives.where("n_bytes > 0").select("uri", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("n_bytes") - 1, size.cast("long"))).alias("begin"))
    spread = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uri", "begin")
    found = spread.mapInArrow(
        read, "uri string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    if "n_records" in archives.columns:
        found = materialise(found, name="records")
        _check_counts(archives, found)
    return found.drop("uri")


def _check_counts(archives: DataFrame, found: DataFrame) -> None:
    """Raise if an archive without damage gave fewer records than it states."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, n_bytes in zip(batch["uri"].to_pylist(), batch["n_bytes"].to_pylist()):
                with open_file(uri) as file:
                    if file.size() == n_bytes and RangeReader(file, 0, n_bytes).intact():
                        yield pa.record_batch([[uri]], names=["uri"])

    stated = archives.groupBy("uri").agg(F.max("n_bytes").alias("n_bytes"), F.sum("n_records").alias("n_records"))
    read = found.groupBy("uri").agg(F.count(F.lit(1)).alias("n_read"))
    short = stated.join(read, "uri", "left").where(F.col("n_records") > F.coalesce("n_read", F.lit(0)))
    lost = short.select("uri", "n_bytes").mapInArrow(check, "uri string").first()
    if lost is not None:
        raise ValueError(f"{lost.uri} is not damaged and gave fewer records than were written")
