"""Key and block codecs. Column forms where built-in functions can say it; Arrow UDFs for the rest."""

from __future__ import annotations

import struct
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

MASK_DELTA = 0xA282EAD8
FRAME, HEADER = 32768, 7


def internal_key_hex(key: Column, seq: Column, kind: Column) -> Column:
    """Key and big-endian tag as hex; bytewise order of the tag is by seq."""
    return F.concat(F.hex(key), F.lpad(F.hex(seq * 256 + kind), 16, "0"))


def encode_internal_key(key: bytes, seq: int, kind: int) -> bytes:
    return key + struct.pack("<Q", seq << 8 | kind)


def parse_internal_key(raw: bytes) -> tuple[bytes, int, int]:
    """(key, seq, kind); any kind other than 0 reads as a value."""
    if len(raw) < 8:
        raise ValueError("an internal key has 8 bytes at least")
    tag = struct.unpack("<Q", raw[-8:])[0]
    return raw[:-8], tag >> 8, 1 if tag & 0xFF else 0


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, p: int = 0) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[p]
        n |= (b & 0x7F) << shift
        p, shift = p + 1, shift + 7
        if b < 0x80:
            return n, p


def varint_length(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def encode_memtable_key(key: bytes, seq: int, kind: int, value: bytes) -> bytes:
    return varint(len(key) + 8) + encode_internal_key(key, seq, kind) + varint(len(value)) + value


def parse_memtable_key(raw: bytes) -> tuple[bytes, int, int, bytes]:
    n, p = read_varint(raw)
    key, seq, kind = parse_internal_key(raw[p : p + n])
    m, q = read_varint(raw, p + n)
    return key, seq, kind, raw[q : q + m]


def shortest_separator(a: bytes, b: bytes) -> bytes:
    """A short s with a <= s < b (a itself if they are equal)."""
    if a == b:
        return a
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    # raise the first byte of a that leaves room below b
    for i in range(n, len(a)):
        if a[i] < 0xFF and (i > n or n >= len(b) or a[i] + 1 < b[i]):
            s = a[:i] + bytes([a[i] + 1])
            if s < b:
                return s
    return a + b"\x00" if a + b"\x00" < b else a


def shortest_successor(a: bytes) -> bytes:
    """A short s with a <= s."""
    for i, x in enumerate(a):
        if x != 0xFF:
            return a[:i] + bytes([x + 1])
    return a + b"\x00"


@pandas_udf(T.BinaryType())
def separator(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else shortest_separator(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)])


@pandas_udf(T.BinaryType())
def successor(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else shortest_successor(bytes(x)))


@lru_cache(1)
def _cksum_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_cksum(raw: bytes) -> int:
    """CRC-32 as POSIX cksum computes it over the bytes alone (polynomial 04C11DB7, not reflected, complemented)."""
    t, c = _cksum_table(), 0
    for b in raw:
        c = (c << 8 ^ t[c >> 24 ^ b]) & 0xFFFFFFFF
    return c ^ 0xFFFFFFFF


@pandas_udf(T.LongType())
def cksum(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else crc32_cksum(bytes(x))).astype("Int64")


def mask_crc(c: Column) -> Column:
    """Rotate a 32-bit checksum right by 15 and add a constant."""
    c = c.cast("bigint")
    return (F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17).bitwiseAND(F.lit(0xFFFFFFFF))) + F.lit(MASK_DELTA)).bitwiseAND(F.lit(0xFFFFFFFF))


def unmask_crc(m: Column) -> Column:
    r = (m.cast("bigint") - F.lit(MASK_DELTA)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(r, 17).bitwiseOR(F.shiftleft(r, 15).bitwiseAND(F.lit(0xFFFFFFFF)))


def frame_count(size: Column) -> Column:
    """Frames of a record that starts on a block boundary; an empty record has none."""
    return F.ceil(size / (FRAME - HEADER)).cast("bigint")


KIND = {"full": 1, "first": 2, "middle": 3, "last": 4}


def frame_record(record: bytes, room: int = FRAME) -> bytes:
    """A record as frames in blocks of ``room`` bytes: u32 masked checksum, u16 length, u8 kind, then the data. An empty record has none."""
    parts = [record[i : i + room - HEADER] for i in range(0, len(record), room - HEADER)]
    out = b""
    for i, part in enumerate(parts):
        kind = "full" if len(parts) == 1 else "first" if i == 0 else "last" if i == len(parts) - 1 else "middle"
        c = crc32_cksum(bytes([KIND[kind]]) + part)
        masked = ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF
        out += struct.pack("<IHB", masked, len(part), KIND[kind]) + part
    return out


def unframe_record(raw: bytes) -> bytes | None:
    """The record in ``raw``; None if it is cut short or a checksum does not fit."""
    out, p, kind = b"", 0, 0
    while p + HEADER <= len(raw):
        masked, n, kind = struct.unpack_from("<IHB", raw, p)
        part = raw[p + HEADER : p + HEADER + n]
        r = (masked - MASK_DELTA) & 0xFFFFFFFF
        if len(part) < n or crc32_cksum(bytes([kind]) + part) != (r >> 17 | r << 15) & 0xFFFFFFFF:
            return None
        if (kind in (KIND["full"], KIND["first"])) != (p == 0):
            return None
        out, p = out + part, p + HEADER + n
    return out if p == len(raw) and (kind in (KIND["full"], KIND["last"]) or not raw) else None


def to_frames(records: DataFrame, key: str, body: str) -> DataFrame:
    """One row per frame: key, no, type (full, first, middle, last), data."""
    room = FRAME - HEADER
    n = frame_count(F.octet_length(body))
    rows = records.where(F.octet_length(body) > 0).withColumn("n", n).select(key, "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("no"), body)
    kind = F.when(F.col("n") == 1, "full").when(F.col("no") == 0, "first").when(F.col("no") == F.col("n") - 1, "last").otherwise("middle")
    return rows.select(key, "no", kind.alias("type"), F.substring(F.col(body), F.col("no") * room + 1, F.lit(room)).alias("data"))


def from_frames(frames: DataFrame, key: str) -> DataFrame:
    """Records put together again; records without a last frame (a torn tail) are left out."""
    parts = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "type", "data"))).alias("f"))
    whole = F.try_element_at("f", F.lit(1))["type"].isin("full", "first") & F.try_element_at("f", F.lit(-1))["type"].isin("full", "last") & (F.try_element_at("f", F.lit(-1))["no"] == F.size("f") - 1)
    hexes = F.transform("f", lambda x: F.hex(x["data"]))
    return parts.where(whole).select(key, F.unhex(F.array_join(hexes, "")).alias("data"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two binaries."""
    x, y = F.hex(a), F.hex(b)
    n = F.least(F.octet_length(a), F.octet_length(b))
    step = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(x, i * 2 - 1, F.lit(2)) == F.substring(y, i * 2 - 1, F.lit(2))), i).otherwise(acc))
    return F.when(n > 0, step).otherwise(0)


def prefix_delta(rows: DataFrame, interval: int = 16, group: list[str] | None = None) -> DataFrame:
    """Adds shared (with the key before; 0 at each restart) and unshared, in key order within each group."""
    w = Window.partitionBy(*(group or [])).orderBy("key")
    rows = rows.withColumn("__n", F.row_number().over(w) - 1).withColumn("__p", F.lag("key").over(w))
    shared = F.when((F.col("__n") % interval == 0) | F.col("__p").isNull(), 0).otherwise(shared_prefix(F.col("__p"), F.col("key")))
    return rows.withColumn("shared", shared).withColumn("unshared", F.octet_length("key") - F.col("shared")).drop("__n", "__p")
