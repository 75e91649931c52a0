"""Token ids in sorted-string-table shards, with lookup by binary search.

A shard holds documents in ascending key order. Layout of the file:

    block*   zstandard frame of entries; an entry is varint(shared key bytes), varint(rest of the key),
             varint(value bytes), the rest of the key, the value (ids as uint16, or uint32)
    index    per block: first key (8 bytes), offset (u64), length (u32)
    bloom    bit array of the keys
    footer   index offset, blocks, bloom offset, bloom bytes, documents, ids (u64 each),
             id width, hashes (u32 each) and the mark MSST0001

A key is the document's identifier as a big-endian 64-bit integer with the sign flipped, so
bytes sort as numbers do. Rows that repeat an identifier stay, in the order of their text.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.llm.encoding import encoder
from matchspark.llm.text import crc_of_ids
from matchspark.session import qualified, scratch_path

MARK = b"MSST0001"
FOOTER = struct.Struct("<6Q2I8s")
ENTRY = struct.Struct("<8sQI")
BLOCK = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Bytes of texts that a task encodes at a time, and the rest of the text that reaches it.
TEXT_BYTES = 20_000_000


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; plain paths are local ones (``write_shards`` gives every path its scheme)."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def key_of(doc_id: int) -> bytes:
    return struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def bloom_spots(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes documents that come in ascending key order; memory holds one block and the keys."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.keys, self.ids = [], [], 0

    def add(self, doc_id: int, value: bytes) -> None:
        key = key_of(doc_id)
        if not self.block:
            self.first, self.last = key, b""
        shared = next((i for i in range(len(self.last)) if self.last[i] != key[i]), len(self.last))
        self.block += varint(shared) + varint(8 - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK:
            self.flush()

    def write(self, data: bytes) -> int:
        start, self.at = self.at, self.at + len(data)
        self.sink.write(data)
        return start

    def flush(self) -> None:
        if self.block:
            data = zstandard.compress(bytes(self.block), 1)
            self.index.append(ENTRY.pack(self.first, self.write(data), len(data)))
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index_at = self.write(b"".join(self.index))
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[bloom_spots(key, bits)] = True
        data = np.packbits(bloom, bitorder="little").tobytes()
        bloom_at = self.write(data)
        self.write(FOOTER.pack(index_at, len(self.index), bloom_at, len(data), len(self.keys), self.ids, self.width, BLOOM_HASHES, MARK))


class Shard:
    """A shard opened for reading: the footer, index and filter are read, blocks only as needed."""

    def __init__(self, path: str):
        system, inner = store(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        self.index_at, blocks, bloom_at, bloom_bytes, self.documents, self.ids, self.width, self.hashes, mark = FOOTER.unpack(
            self.file.read_at(FOOTER.size, size - FOOTER.size)
        )
        if mark != MARK:
            raise ValueError(f"{path} is no shard")
        rows = self.file.read_at(blocks * ENTRY.size, self.index_at)
        self.index = list(ENTRY.iter_unpack(rows))
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(bloom_bytes, bloom_at), np.uint8), bitorder="little")
        self.bits = max(64, BLOOM_BITS * self.documents)

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length = self.index[block]
        data, at, key = zstandard.decompress(self.file.read_at(length, offset)), 0, b""
        while at < len(data):
            numbers = []
            for _ in range(3):
                n = shift = 0
                while True:
                    byte = data[at]
                    at += 1
                    n |= (byte & 127) << shift
                    shift += 7
                    if byte < 128:
                        break
                numbers.append(n)
            shared, rest, size = numbers
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def decode(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for block in range(len(self.index)):
            for key, value in self.entries(block):
                yield id_of(key), self.decode(value)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every row with this identifier: filter, binary search, then one block or more."""
        key = key_of(doc_id)
        if not all(self.bloom[i] for i in bloom_spots(key, self.bits)):
            return []
        firsts, found = [x[0] for x in self.index], []
        block = max(0, bisect_right(firsts, key) - 1)
        while block > 0 and firsts[block] == key:
            block -= 1
        while block < len(self.index) and firsts[block] <= key:
            found += [self.decode(v) for k, v in self.entries(block) if k == key]
            block += 1
        return found


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (doc_id, text) in slices of about ``TEXT_BYTES``."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(total // TEXT_BYTES)) + 2
    for start, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
        if start < end:
            yield batch.slice(start, end - start)


def shard_writer(path: str, tokenizer: str, end_id: int):
    """A mapInArrow function over rows (doc_id, text) sorted by doc_id: one shard for each task.

    A retried or repeated attempt writes a file of its own name; the row that the attempt
    returns names it, so only files of attempts that count are read.
    """
    import uuid

    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, first = encoder(tokenizer), None, None
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for doc_id, value in zip(ids, encode.batch(texts), strict=True):
                    if writer is None:
                        name, first = f"{path}/shard-{uuid.uuid4().hex}.sst", doc_id
                        system, inner = store(name)
                        system.create_dir(inner.rpartition("/")[0], recursive=True)
                        sink = system.open_output_stream(inner)
                        writer = ShardWriter(sink, 2)
                    writer.add(doc_id, value + end)
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "first": first, "documents": len(writer.keys), "ids": writer.ids}], schema=schema)

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``docs (doc_id, text, ...)`` into shards below ``path``; return one row a shard.

    Rows: ``path, first, documents, ids, start`` (ids of all shards before it). Null texts
    are empty ones; rows without doc_id take no part; an empty table gives no shard. The
    manifest is written to ``path`` too, so reading starts from what is on disk.
    """
    path = qualified(docs.sparkSession, path)
    rows = docs.where("doc_id is not null").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = rows.mapInArrow(shard_writer(f"{path}/shards", tokenizer, end_id), "path string, first long, documents long, ids long")
    shards.write.parquet(f"{path}/manifest")
    return manifest(docs.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a written folder with the ids that stand before each; one row a file."""
    rows = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("first", "path").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, ids in Shard(path):
                    rows.append((doc_id, start, len(ids), crc_of_ids(ids)))
                    start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spark = shards.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return shards.select("path", "start").repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write all documents and return what the files hold of each."""
    return read_shards(write_shards(docs, path or scratch_path(docs.sparkSession, "sstable"), tokenizer, end_id))
