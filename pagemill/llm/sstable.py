"""Token ids of documents in sorted-string-table shards, for look-up by document id.

A shard is one file, written by one task over a range of ids in ascending order:

    block*  index  bloom  footer

* A block holds entries (key, value), compressed as a whole. A key is stored as the length it shares with the key before
  it in the block and the rest of its bytes; a value is the token ids as little-endian unsigned 32-bit numbers.
* The index has, for each block, its last key, place, size, and the number of ids before it in the shard.
* The Bloom filter has 10 bits a key and 7 probes.
* The footer has the places of index and filter, the numbers of entries and ids, and a magic number.

Keys order as bytes: 0 and the id with its sign bit flipped, big-endian; a null id is the byte 1, so it comes last.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written
from .tokens import SegmentEncoder

MAGIC = 0x50_4D_53_53_54_30_30_31
FOOTER = struct.Struct("<7Q")
BLOCK_BYTES = 64 << 10
#: A shard is closed when its blocks hold this much (uncompressed), so a reader's memory has a bound.
SHARD_BYTES = 16 << 20
#: Wanted keys that a look-up takes to a shard at once.
LOOKUP_KEYS = 10_000
LOOKUP_SHARDS = 200_000
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x01" if doc_id is None else b"\x00" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key == b"\x01" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


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


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
    step = h >> np.uint64(33) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + step[:, None] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Collects entries in key order; finish() gives the file's bytes."""

    def __init__(self):
        self.out, self.block, self.last = io.BytesIO(), bytearray(), b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = self.ids_before = self.held = 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        shared = next((k for k, (a, b) in enumerate(zip(self.last, key, strict=False)) if a != b), min(len(self.last), len(key))) if self.block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // 4
        self.held += len(value)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.index.append((self.last, self.out.tell(), len(data), self.ids_before))
            self.out.write(data)
            self.block, self.ids_before = bytearray(), self.ids

    def finish(self) -> bytes:
        self._close_block()
        at_index = self.out.tell()
        for key, place, size, before in self.index:
            self.out.write(_varint(len(key)) + key + _varint(place) + _varint(size) + _varint(before))
        at_bloom = self.out.tell()
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        if self.keys:
            bloom[_probes(self.keys, bits).ravel()] = 1
        self.out.write(np.packbits(bloom, bitorder="little").tobytes())
        self.out.write(FOOTER.pack(at_index, at_bloom, bits, len(self.index), len(self.keys), self.ids, MAGIC))
        return self.out.getvalue()


class Shard:
    """Reads a shard's bytes: all entries in order, or one key's values by Bloom filter and binary search."""

    def __init__(self, data: bytes):
        self.data = data
        self.at_index, self.at_bloom, self.bits, n_blocks, self.n_keys, self.n_ids, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.blocks, at = [], self.at_index
        for _ in range(n_blocks):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            before, at = _read_varint(data, at)
            self.blocks.append((key, place, size, before))

    def block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids before it in the shard, value) of a block's entries."""
        _, place, size, before = self.blocks[k]
        data = zstandard.ZstdDecompressor().decompress(self.data[place : place + size])
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            value = data[at + own : at + own + length]
            at += own + length
            yield key, before, value
            before += length // 4

    def entries(self) -> Iterator[tuple[bytes, int, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        at = _probes([key], self.bits)[0]
        return all(self.data[self.at_bloom + int(p) // 8] >> int(p) % 8 & 1 for p in at)

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key: as many as it was written with (repeated ids may go on over several blocks)."""
        found: list[bytes] = []
        if not self.may_hold(key):
            return found
        k = bisect_left(self.blocks, key, key=lambda b: b[0])
        while k < len(self.blocks):
            found += [value for own, _, value in self.block(k) if own == key]
            if self.blocks[k][0] != key:
                break
            k += 1
        return found


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> tuple[str, DataFrame]:
    """Write the ids of all docs (a null text: only end_id) to a new folder of shards in ascending id order.

    Returns the folder and a table of the shards: shard, first_id, last_id, n_docs, n_ids. Texts are range-partitioned by id
    (null last, equal ids by text); each task encodes and writes its range, rolling to a new shard at SHARD_BYTES. A
    shard is written under a name of its own and then moved to its final one, so a task that runs again only replaces
    files by the same. The files go through pyarrow's file systems, by the scheme of the folder
    (hdfs needs its native library on the workers).
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = SegmentEncoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        store, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))  # Spark's names of that store
        store.create_dir(root, recursive=True)
        part, shards, writer = TaskContext.get().partitionId(), [], None

        def close() -> None:
            name = f"part-{part:06d}-{len(shards):06d}.sst"
            with store.open_output_stream(hidden := f"{root}/_{name}.{uuid.uuid4().hex}") as f:
                f.write(writer.finish())
            store.move(hidden, f"{root}/{name}")
            shards.append((name, id_of(writer.keys[0]), id_of(writer.keys[-1]), len(writer.keys), writer.ids))

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), encoder.encode_all(b.column(1), end), strict=True):
                writer = writer or ShardWriter()
                writer.add(key_of(key), ids)
                if writer.held >= SHARD_BYTES:
                    close()
                    writer = None
        if writer:
            close()
        if shards:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*shards, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "first_id", "last_id", "n_docs", "n_ids"])

    order = [F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(*order[:1]).sortWithinPartitions(*order)
    return folder, written(ranged.mapInArrow(run, "shard string, first_id long, last_id long, n_docs long, n_ids long"), "manifest")


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files themselves; start: ids of all before it."""
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not each document
    bases = shards.select("shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(id_of(key), before, len(value) // 4, zlib.crc32(value)) for key, before, value in Shard(data.as_py()).entries()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["shard", "doc_id", "before", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    rows = named.mapInArrow(run, "shard string, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, wanted: DataFrame, shards: DataFrame) -> DataFrame:
    """wanted (doc_id long) -> (doc_id, ids array<int>), a row for each document of each distinct wanted id (null among them).

    shards: the table that write_shards gave. It tells by first and last id which shards may hold an id, so no other file is
    opened; within a shard the Bloom filter and a binary search of the block index leave one block to unpack. A shard's
    wanted keys come in groups of about LOOKUP_KEYS, so a task holds few of them. Up to LOOKUP_SHARDS shards, their ranges
    (two numbers and a name each) are sent to all tasks; more are joined by range.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, keys in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                shard = Shard(data.as_py())
                rows = [(id_of(k), np.frombuffer(v, "<u4").astype(np.int32).tolist()) for k in keys for v in shard.get(k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    place = lambda c: F.coalesce(c, F.lit((1 << 63) - 1))
    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), place(F.col("doc_id").cast("long")).alias("at")).distinct()
    bounds = shards.select("shard", place(F.col("first_id")).alias("first"), place(F.col("last_id")).alias("last"))
    if bounds.count() <= LOOKUP_SHARDS:
        table = sorted((r["first"], r["last"], r["shard"]) for r in bounds.collect())  # a row for each file
        first, last = (np.array([t[k] for t in table], np.int64) for k in (0, 1))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(1).to_numpy()
                low, high = np.searchsorted(last, at, "left"), np.searchsorted(first, at, "right")
                rows = [(key, table[k][2]) for key, x, y in zip(b.column(0).to_pylist(), low.tolist(), high.tolist(), strict=True) for k in range(x, y)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "shard"])

        hits = ids.mapInArrow(placed, "doc_id long, shard string")
    else:
        hits = ids.join(bounds, F.col("at").between(F.col("first"), F.col("last"))).select("doc_id", "shard")
    # the key of an id: 0, then the id with its sign flipped, big-endian
    key = F.when(F.col("doc_id").isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))))
    parts = hits.groupBy("shard").agg(F.ceil(F.count("*") / LOOKUP_KEYS).alias("parts"))
    asked = hits.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), key.alias("key"))
    asked = asked.groupBy("shard", "part").agg(F.collect_list("key").alias("keys"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    return files.join(asked, "shard").select("content", "keys").mapInArrow(find, "doc_id long, ids array<int>")
