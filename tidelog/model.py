"""Data model: schemas, order-preserving key encoders, status codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETION, VALUE = 0, 1
MAX_SEQ = (1 << 56) - 1
LEVELS = 7

KV_LOG = "key binary, seq bigint, kind tinyint, value binary"
FILES = "level int, file_id bigint, size bigint, smallest_key binary, smallest_seq bigint, largest_key binary, largest_seq bigint, allowed_seeks bigint"


class Status(Exception):
    """An error with a code; its text is ``code: [message]``."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: [{message}]")
        self.code, self.message = code, message


def status_of(error: BaseException) -> Status:
    """Operating-system errors by code."""
    names = {FileNotFoundError: "NotFound", FileExistsError: "AlreadyExists", PermissionError: "PermissionDenied", InterruptedError: "Interrupted", EOFError: "UnexpectedEof", ValueError: "InvalidData"}
    code = next((c for t, c in names.items() if isinstance(error, t)), "IOError")
    return error if isinstance(error, Status) else Status(code, str(error))


@dataclass
class Options:
    """Settings of a store. Keys are ordered bytewise; another order is an encoding of the key, named by ``comparator``, which is
    checked at open. ``bloom_bits`` 0: no filters. ``level0_trigger``: so many level-0 tables ask for a compaction."""

    comparator: str = "bytewise"
    create_if_missing: bool = True
    error_if_exists: bool = False
    write_buffer_size: int = 4 << 20
    max_file_size: int = 2 << 20
    compression: str = "none"
    bloom_bits: int = 10
    level0_trigger: int = 4

    @classmethod
    def for_test(cls) -> "Options":
        return cls(write_buffer_size=1 << 14)


def encode_long(c: Column) -> Column:
    """Bigint -> 8 bytes whose bytewise order is the numeric one (sign bit flipped, big-endian)."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def decode_long(c: Column) -> Column:
    n = F.conv(F.hex(c), 16, -10).cast("bigint")
    return n.bitwiseXOR(F.lit(-(1 << 63)))


def encode_text(c: Column) -> Column:
    return c.cast("binary")


def encode_timestamp(c: Column) -> Column:
    return encode_long(F.unix_micros(c.cast("timestamp")))
