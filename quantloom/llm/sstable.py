"""Sorted-string tables of token ids: prefix-compressed blocks, sparse block index, Bloom filter, footer.

File: blocks | index | Bloom filter | footer. A block is entries (varint shared key bytes, varint other key
bytes, varint value bytes, key, value) and a CRC-32. The index holds each block's last key and place. Keys
order as the documents' identifiers do: nothing for a null, else 0x01 and the identifier, sign bit flipped,
big-endian. A value is the document's ids as little-endian integers of 2 bytes where the vocabulary has no
larger id, else 4; the footer tells the width.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .word_ids import encoder

BLOCK_BYTES = 64 << 10
SHARD_BYTES = 32 << 20
#: Text bytes that are encoded at once, and ids that are read back at once: sorting fills the heap of an executor here, so
#: that its Python workers have less room than elsewhere.
TEXT_BYTES, READ_IDS = 2 << 20, 1 << 18
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QIQIQQI8s")  # index place and size, filter place and size, entries, ids, width, magic


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys must come in ascending order (equal keys may follow each other)."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.place = self.entries = self.ids = 0
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, self.place, len(data)))
            self.sink.write(data)
            self.place += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", p, n) for k, p, n in self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.sink.write(index + packed + FOOTER.pack(self.place, len(index), self.place + len(index), len(packed), self.entries, self.ids, self.width, MAGIC))


class Reader:
    """Reads one shard: get(doc_id) by Bloom filter, binary search in the index and one block; scan() in order."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        self.size = self.file.size()
        at = FOOTER.unpack(self._read(self.size - FOOTER.size, FOOTER.size))
        if at[-1] != MAGIC:
            raise ValueError(f"{path} is no table of token ids")
        self.entries, self.ids, self.width = at[4:7]
        self.bloom = np.frombuffer(self._read(at[2], at[3]), np.uint8)
        data, pos, self.last_keys, self.places = self._read(at[0], at[1]), 0, [], []
        while pos < len(data):
            n, pos = _read_varint(data, pos)
            self.last_keys.append(data[pos : pos + n])
            self.places.append(struct.unpack_from("<QI", data, pos + n))
            pos += n + 12

    def _read(self, place: int, n: int) -> bytes:
        return self.file.read_at(n, place)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._read(*self.places[i])
        body = data[:-4]
        if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key = 0, b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + n]
            at += n

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype(np.uint32)

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.places)):
            for key, value in self._block(i):
                yield id_of(key), self._ids(value)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document (of the first of several with this identifier), or None."""
        key, bits = key_of(doc_id), len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits)):
            return None
        i = bisect.bisect_left(self.last_keys, key)
        if i < len(self.places):
            for k, value in self._block(i):
                if k == key:
                    return self._ids(value)
        return None

    def close(self) -> None:
        self.file.close()


def write_tables(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every whole text (null: empty), appends end_id, and writes range-partitioned shards below path.

    Returns the manifest, itself stored there: shard, file, first_id, last_id, entries, start (ids in all
    shards before) and ids. Documents are in ascending order of (identifier, text), null identifiers first;
    repeated rows are entries of their own. A shard's file has a fixed name and content and takes its place
    by a rename, so that a task run twice does no harm. An empty table gives an empty manifest. The range
    bounds come from Spark's sampled sort ranges, so that only equal identifiers can crowd into one shard."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // shard_bytes))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        coder = encoder(vocabulary)
        width = 2 if max(coder.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name, writer, sink, first, last = f"{root}/shard-{shard:06d}.sst", None, None, None, None
        own = f"{name}.{context.taskAttemptId()}.tmp"
        for batch in common.chunks(batches, "text", TEXT_BYTES):
            offsets, ids = coder.encode(batch.column("text"))
            if writer is None:
                sink = fs.open_output_stream(own)
                writer, first = Writer(sink, width), batch.column("doc_id")[0].as_py()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                writer.add(key_of(doc_id), np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)))
                last = doc_id
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(own, name)
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": f"shard-{shard:06d}.sst", "first_id": first, "last_id": last, "entries": writer.entries, "ids": writer.ids}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("entries", pa.int64()), ("ids", pa.int64())]))

    ranged.mapInArrow(write, "shard int, file string, first_id long, last_id long, entries long, ids long").write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a shard; its start is a running sum over the shards, which are few."""
    rows = spark.read.schema("shard int, file string, first_id long, last_id long, entries long, ids long").parquet(f"{path}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")).withColumn("path", F.concat(F.lit(f"{path}/"), "file"))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Every entry, read back from the files: doc_id, start, n_tokens, and the ids as little-endian 4-byte integers."""
    shards = manifest(spark, path).select("path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(name)
                yield from _batches(reader, start)
                reader.close()

    return shards.repartition(max(1, shards.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _batches(reader: Reader, start: int) -> Iterator[pa.RecordBatch]:
    """A shard's entries in batches that end once they hold READ_IDS ids."""
    rows, held = [], 0
    for doc_id, ids in reader.scan():
        rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
        start += len(ids)
        held += len(ids)
        if held >= READ_IDS:
            yield _rows(rows)
            rows, held = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def lookup(ids: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The stored ids of the asked identifiers (a row for each asked row, repeated ones too; ids null where there is none).

    Of several stored entries of one identifier it is that of the least text. A null identifier finds nothing, stored
    or not.

    Each asked identifier goes to the shard whose key range may hold it; there, Bloom filter and index find
    its block. Only the manifest, a row a shard, is broadcast."""
    spark = ids.sparkSession
    shards = manifest(spark, path).select("path", "first_id", "last_id").where(F.col("last_id").isNotNull())
    asked = ids.select(F.col(id_col).cast("long").alias("doc_id"))
    bounds = [(r.path, r.first_id, r.last_id) for r in shards.orderBy("last_id", "path").collect()]
    lasts = [b[2] for b in bounds]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        for batch in batches:
            out, keys = [], batch.column("doc_id").to_pylist()
            for k in keys:
                got = None
                if k is not None and (i := bisect.bisect_left(lasts, k)) < len(bounds):
                    if (name := bounds[i][0]) not in readers:
                        if len(readers) > 32:
                            readers.popitem()[1].close()
                        readers[name] = Reader(name)
                    got = readers[name].get(k)
                out.append(None if got is None else got.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return asked.sortWithinPartitions("doc_id").mapInArrow(find, "doc_id long, ids binary")
