"""Token ids in files of shuffled planes.

A shard holds the ids of consecutive documents, in blocks of ``BLOCK_IDS``.  The ids of a
block are transposed into planes, either the n-th bytes or the n-th bits of all its ids,
and each plane is compressed with zstandard by itself: high bytes of token ids are far
more regular than low ones.  Behind the blocks stand the sizes of the documents and the
chunk index, so that a reader fetches any block without the others.

    magic "KSPL" + version, then per block its compressed planes one after the other;
    documents: Arrow table (doc_id, n_tokens); index: JSON; then the two lengths (u64) and "KSPL".

Documents are sorted by id across shards with a range partitioning, each shard is
written by one task as the texts come, and a manifest with one row per shard gives the
place of its first id.  Reading takes one task per shard, block by block.

Defined cases.  A null text is empty and still gets the end id.  Documents with equal
ids follow each other ordered by text; null ids come first.  No rows give no files.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.llm.blocks import text_blocks
from keysift.llm.files import new_file, open_file
from keysift.plans.durable import materialise, scratch_dir

MAGIC = b"KSPL"
VERSION = 1
BLOCK_IDS = 1 << 16
LEVEL = 1

Encode = Callable[[list[bytes]], list[bytes]]


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The n-th bytes (or bits) of all ids, one byte string per n."""
    width = ids.dtype.itemsize
    rows = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, width)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(plane, bitorder="little").tobytes() for plane in rows.T]
    return [plane.tobytes() for plane in rows.T]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool = False) -> np.ndarray:
    if bits:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        rows = np.packbits(rows, axis=1, bitorder="little")
    else:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(rows).view(f"<u{width}").reshape(-1)[:n]


class ShardWriter:
    """Writes one shard; holds one block and the documents' sizes in memory."""

    def __init__(self, folder: str, width: int, bits: bool):
        self.uri, self._out = new_file(folder, ".planes")
        self._width, self._bits, self._waiting, self._bytes = width, bits, [], 0
        self._at, self._index, self._sizes, self._ids = len(MAGIC) + 1, [], [], []
        self._compressor = zstandard.ZstdCompressor(level=LEVEL)
        self._out.write(MAGIC + bytes([VERSION]))

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        """Documents in order, with their ids as little-endian bytes."""
        self._ids.append(doc_ids)
        self._sizes += [len(i) // self._width for i in ids]
        self._waiting += ids
        self._bytes += sum(map(len, ids))
        block = BLOCK_IDS * self._width
        if self._bytes >= block:
            data = b"".join(self._waiting)
            whole = len(data) - len(data) % block
            for at in range(0, whole, block):
                self._block(data[at:at + block])
            self._waiting, self._bytes = [data[whole:]], len(data) - whole

    def _block(self, data: bytes) -> None:
        planes = [self._compressor.compress(p) for p in to_planes(np.frombuffer(data, f"<u{self._width}"), self._bits)]
        self._out.write(b"".join(planes))
        self._index.append([self._at, len(data) // self._width, [len(p) for p in planes]])
        self._at += sum(map(len, planes))

    def close(self) -> tuple[str, int]:
        """(uri, ids written)."""
        if self._bytes:
            self._block(b"".join(self._waiting))
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.chunked_array(self._ids), "n_tokens": pa.array(self._sizes, pa.int64())})
        with pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        documents = self._compressor.compress(sink.getvalue().to_pybytes())
        index = json.dumps({"width": self._width, "bits": self._bits, "blocks": self._index}).encode()
        self._out.write(documents + index + struct.pack("<QQ", len(documents), len(index)) + MAGIC)
        self._out.close()
        return self.uri, sum(self._sizes)


class ShardReader:
    """Reads a shard through its chunk index."""

    def __init__(self, uri: str):
        self._file = open_file(uri)
        size, tail = self._file.size(), struct.calcsize("<QQ") + len(MAGIC)
        n_documents, n_index, magic = struct.unpack("<QQ4s", self._file.read_at(tail, size - tail))
        if magic != MAGIC or self._file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a file of planes: {uri}")
        index = json.loads(self._file.read_at(n_index, size - tail - n_index))
        packed = self._file.read_at(n_documents, size - tail - n_index - n_documents)
        self.documents = pa.ipc.open_file(zstandard.ZstdDecompressor().decompress(packed)).read_all()
        self.blocks, self._width, self._bits = index["blocks"], index["width"], index["bits"]

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        data, planes, unpack = self._file.read_at(sum(sizes), at), [], zstandard.ZstdDecompressor()
        for size in sizes:
            planes.append(unpack.decompress(data[:size]))
            data = data[size:]
        return from_planes(planes, n, self._width, self._bits)

    def texts(self) -> Iterator[np.ndarray]:
        """The ids of each document as u32, holding a document and a block at most."""
        blocks, rest = iter(range(len(self.blocks))), np.zeros(0, "<u4")
        for n in self.documents["n_tokens"].to_pylist():
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.block(next(blocks)).astype("<u4"))
                have += len(parts[-1])
            joined = np.concatenate(parts) if len(parts) > 1 else rest
            yield joined[:n]
            rest = joined[n:]

    def close(self) -> None:
        self._file.close()


def write_shards(docs: DataFrame, encoder: Callable[[], tuple[Encode, int]], end_id: int, bits: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending id order; the manifest: shard, uri, start, n_tokens.

    ``encoder()`` gives, inside a task, the function from UTF-8 texts to little-endian ids
    and their width in bytes.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "planes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode, width), writer = encoder(), None
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            for first, texts in text_blocks(batch["text"]):
                writer = writer or ShardWriter(folder, width, bits)
                writer.add(batch["doc_id"].slice(first, len(texts)), [ids + end for ids in encode(texts)])
        if writer:
            uri, n = writer.close()
            shard = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.record_batch([shard, [uri], [n]], names=["shard", "uri", "n_tokens"])

    ordered = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    shards = materialise(ordered.mapInArrow(write, "shard int, uri string, n_tokens long"), name="manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(spark: SparkSession, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist()):
                reader = ShardReader(uri)
                sizes = reader.documents["n_tokens"].to_numpy()
                crc = [zlib.crc32(ids.tobytes()) for ids in reader.texts()]
                reader.close()
                yield pa.record_batch(
                    [reader.documents["doc_id"].combine_chunks(), start + np.cumsum(sizes) - sizes, sizes, pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uri")
    return spread.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
