r"""Token ids in sorted-string-table shards.

Shard layout (all integers little-endian)::

    block*   entries: u16 shared, u16 unshared, u32 count of ids, unshared key bytes, ids as u16 or u32;
             each block is zstd-compressed (or raw) and followed by nothing
    bloom    the filter's bits
    index    per block: u16 key length, first key, u64 offset, u32 stored length, u32 raw length
    footer   struct FOOTER: offsets and lengths of bloom and index, entries, ids, hashes, id width, codec, magic

Keys sort bytewise: a null doc_id is the empty key, others are 8 bytes big-endian with the sign bit flipped.
Within a block a key stores only what it does not share with the key before it. ``get`` asks the Bloom filter,
finds the block by binary search in the sparse index and scans that block.

Writers put a shard under a temporary name and rename it when complete, so a repeated or speculative task
leaves one whole file of the same content. Files go to the shared folder.

Edge cases: null text is empty (its only id is the end id); repeated doc_ids are kept as separate entries, ordered
by content digest; an empty table makes no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import scratch_dir, table, tokenizer_path
from tidelog.llm.tokens import encoder

BLOCK_BYTES = 64 * 1024
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQIIII")
MAGIC = 0x53535431
END_ID = 1


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def filesystem(uri: str):
    """(file system, path) of a URI that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, sink, wide: bool, codec: str = "zstd"):
        import zstandard

        self.sink, self.dtype, self.codec = sink, np.dtype("<u4" if wide else "<u2"), codec
        self.pack = zstandard.ZstdCompressor(level=1).compress if codec == "zstd" else bytes
        self.block, self.size, self.last, self.first = [], 0, b"", None
        self.index, self.keys, self.at, self.ids = [], [], 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers. Keys come in ascending order."""
        shared = 0
        if self.first is None:
            self.first = key
        else:
            for x, y in zip(self.last, key, strict=False):
                if x != y:
                    break
                shared += 1
        n = len(ids) // 4
        body = ids if self.dtype.itemsize == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.block += [struct.pack("<HHI", shared, len(key) - shared, n), key[shared:], body]
        self.size += 8 + len(body)
        self.last, self.ids = key, self.ids + n
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            stored = self.pack(raw)
            self.sink.write(stored)
            self.index.append((self.first, self.at, len(stored), len(raw)))
            self.at += len(stored)
            self.block, self.size, self.last, self.first = [], 0, b"", None

    def close(self) -> None:
        self._end_block()
        bits = max(64, (len(self.keys) * BLOOM_BITS_PER_KEY + 7) // 8 * 8)
        bloom = np.zeros(bits, dtype=bool)
        for k in self.keys:
            bloom[_probes(k, bits)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QII", o, s, r) for k, o, s, r in self.index)
        self.sink.write(packed + index)
        self.sink.write(FOOTER.pack(self.at, len(packed), self.at + len(packed), len(index), len(self.keys), self.ids, BLOOM_HASHES, self.dtype.itemsize, self.codec == "zstd", MAGIC))


class ShardReader:
    def __init__(self, source):
        import zstandard

        self.f = source
        size = source.size()
        source.seek(size - FOOTER.size)
        bo, bn, io, n, self.entries, self.ids, self.hashes, width, codec, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.dtype = np.dtype("<u4" if width == 4 else "<u2")
        self.unpack = zstandard.ZstdDecompressor().decompress if codec else bytes
        source.seek(bo)
        self.bloom = source.read(bn)
        raw, self.index, p = source.read(n), [], 0
        while p < len(raw):
            k = struct.unpack_from("<H", raw, p)[0]
            self.index.append((raw[p + 2 : p + 2 + k], *struct.unpack_from("<QII", raw, p + 2 + k)))
            p += 18 + k
        self.first_keys = [x[0] for x in self.index]

    def _block(self, i: int):
        _, offset, stored, _ = self.index[i]
        self.f.seek(offset)
        raw, p, key = self.unpack(self.f.read(stored)), 0, b""
        while p < len(raw):
            shared, unshared, n = struct.unpack_from("<HHI", raw, p)
            p += 8
            key = key[:shared] + raw[p : p + unshared]
            p += unshared
            end = p + n * self.dtype.itemsize
            yield key, np.frombuffer(raw[p:end], self.dtype).astype("<u4")
            p = end

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _probes(key, len(self.bloom) * 8))

    def get(self, key: bytes) -> np.ndarray | None:
        """The first entry of ``key``, or None."""
        if not self.index or not self.may_hold(key):
            return None
        i = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while i < len(self.index) and self.first_keys[i] <= key:
            for k, ids in self._block(i):
                if k == key:
                    return ids
            i += 1
        return None


def write_shards(docs: DataFrame, out_uri: str, vocabulary: str, end_id: int = END_ID, rows_per_shard: int = 20_000, codec: str = "zstd") -> DataFrame:
    """Write the shards; returns (shard, path, entries, ids, first_key). Shards are range-partitioned by doc_id, so reading them in order of first_key gives ascending doc_id."""
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(vocabulary).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = src.count()
    shards = max(1, -(-n // rows_per_shard), min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)))

    def run(batches):
        first, writer, sink = None, None, None
        system, root = filesystem(out_uri)
        name = f"{root}/_{uuid.uuid4().hex}"
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                system.create_dir(root, recursive=True)
                sink = system.open_output_stream(name)
                writer = ShardWriter(sink, wide, codec)
                first = key_of(b.column(0)[0].as_py())
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = encoder(vocabulary).encode(part.column(1).cast(pa.binary()).to_pylist(), end_id)
                for d, x in zip(part.column(0).to_pylist(), ids, strict=True):
                    writer.add(key_of(d), x)
        if writer is not None:
            writer.close()
            sink.close()
            path = f"{root}/shard-{first.hex() or 'null'}.sst"
            system.move(name, path)
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "entries": pa.array([len(writer.keys)], pa.int64()), "ids": pa.array([writer.ids], pa.int64()), "first_key": pa.array([first], pa.binary())})

    ordered = src.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return ordered.mapInArrow(run, "path string, entries bigint, ids bigint, first_key binary")


def read_shards(shards: DataFrame, out_uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry, read from the files. ``shards``: path and before, the ids in earlier shards."""

    def run(batches):
        system, _ = filesystem(out_uri)
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = ([], [], [], [])
                with system.open_input_file(path) as f:
                    for key, ids in ShardReader(f):
                        for o, x in zip(out, (id_of(key), before, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                            o.append(x)
                        before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("path", "before").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_sstable(spark, sf_dir: str) -> DataFrame:
    out = f"{scratch_dir(spark)}/sst-{uuid.uuid4().hex}"
    written = write_shards(table(spark, sf_dir, "documents"), out, tokenizer_path())
    # One row per shard: a small list (rows / rows_per_shard), kept on the driver as the table's manifest.
    manifest = written.toPandas().sort_values("first_key")
    manifest["before"] = manifest["ids"].cumsum() - manifest["ids"]
    rows = [(str(p), int(x)) for p, x in zip(manifest["path"], manifest["before"], strict=True)]
    shards = spark.createDataFrame(rows, "path string, before bigint")
    return read_shards(shards.repartition(max(1, len(rows))) if len(rows) > 1 else shards, out)
