"""Write batches: ordered entries that get consecutive sequence numbers."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.model import DELETION, VALUE
from tidelog.scratch import materialize


class WriteBatch:
    """Puts and deletes in order. The encoded form is a header (u64 first seq, u32 count) and tagged entries."""

    def __init__(self):
        self.entries: list[tuple[int, bytes, bytes | None]] = []
        self.seq = 0

    def add(self, key: bytes, value: bytes) -> "WriteBatch":
        self.entries.append((VALUE, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> "WriteBatch":
        self.entries.append((DELETION, bytes(key), None))
        return self

    def clear(self) -> None:
        self.entries.clear()

    def __len__(self) -> int:
        return len(self.entries)

    def __iter__(self):
        return iter(self.entries)

    def encode(self, seq: int | None = None) -> bytes:
        from tidelog.functions.codec import varint

        out = struct.pack("<QI", self.seq if seq is None else seq, len(self.entries))
        for kind, key, value in self.entries:
            out += bytes([kind]) + varint(len(key)) + key
            if kind:
                out += varint(len(value)) + value
        return out

    @classmethod
    def decode(cls, raw: bytes) -> "WriteBatch":
        from tidelog.functions.codec import read_varint

        self = cls()
        self.seq, n = struct.unpack_from("<QI", raw)
        p = 12
        for _ in range(n):
            kind = raw[p]
            k, p = read_varint(raw, p + 1)
            key, p = raw[p : p + k], p + k
            if kind:
                k, p = read_varint(raw, p)
                self.add(key, raw[p : p + k])
                p += k
            else:
                self.delete(key)
        return self

    def rows(self, base: int) -> list[tuple]:
        return [(key, base + 1 + i, kind, value) for i, (kind, key, value) in enumerate(self.entries)]

    def to_df(self, spark: SparkSession, base: int) -> DataFrame:
        from tidelog.model import KV_LOG

        return spark.createDataFrame([(bytearray(k), s, t, None if v is None else bytearray(v)) for k, s, t, v in self.rows(base)], KV_LOG)


def assign_seq(entries: DataFrame, base: int, order: str) -> DataFrame:
    """Entry number i (from 0) of the batch gets seq base + 1 + i.

    Numbers are exact and distributed: rows are range-partitioned by ``order``, partitions are counted, and each row
    gets its partition's offset and its place in it. No task holds more than its partition.
    """
    spark = entries.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = entries.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id())
    dealt = materialize(dealt, "batch")  # counted and read again: the ranges, found by sampling, must not change
    part = F.shiftright("__id", 33)
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    return dealt.withColumn("__p", part).join(first, "__p").withColumn("seq", F.lit(base + 1) + F.col("__before") + place).drop("__id", "__p", "__before")


def explode_batches(batches: DataFrame) -> DataFrame:
    """batches: (base, entries: array<struct<kind, key, value>>) -> log rows, one seq after another."""
    return batches.select("base", F.posexplode("entries").alias("i", "e")).select("e.key", (F.col("base") + 1 + F.col("i")).alias("seq"), "e.kind", "e.value")
