"""The visible state of a change log as of a sequence number, and reads of it.

view(S): for each key the entry with the greatest seq <= S, if it is a value. Conditions on the key and on seq
commute with it and reach the scan; conditions on values do not and stay above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import VALUE


def newest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The newest entry of each key, deletions included. A partial top-1 runs before the shuffle."""
    if as_of is not None:
        log = log.where(F.col("seq") <= as_of)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return log.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def view(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return newest(log, as_of).where(F.col("kind") == VALUE).select("key", "seq", "value")


def view_by_max(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The same as ``view``, as an aggregate."""
    if as_of is not None:
        log = log.where(F.col("seq") <= as_of)
    top = log.groupBy("key").agg(F.max_by(F.struct("seq", "kind", "value"), "seq").alias("e"))
    return top.where(F.col("e.kind") == VALUE).select("key", "e.seq", "e.value")


def get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    return view(log.where(F.col("key") == F.lit(key)), as_of)


def get_tristate(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """For each key: FOUND with its value, DELETED, or ABSENT."""
    hit = newest(_asked(log, keys), as_of).select("key", "seq", "kind", "value")
    state = F.when(F.col("kind").isNull(), "ABSENT").when(F.col("kind") == VALUE, "FOUND").otherwise("DELETED")
    return keys.join(hit, "key", "left").select("key", state.alias("state"), F.when(F.col("kind") == VALUE, F.col("value")).alias("value"))


def multi_get(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """keys: column key. The log is cut down to the keys asked for before anything else happens to it."""
    return keys.join(view(_asked(log, keys), as_of), "key", "left")


def _asked(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The entries of some keys; the planner broadcasts these, or filters the scan by them, if they are few."""
    return log.join(keys.select("key").distinct(), "key", "left_semi")


def history(log: DataFrame, key=None) -> DataFrame:
    """All versions, by key and then newest first."""
    rows = log if key is None else log.where(F.col("key") == F.lit(key))
    return rows.orderBy("key", F.desc("seq"))


def layered_get(layers: list[DataFrame], as_of: int | None = None) -> DataFrame:
    """The first layer that knows a key decides, newest entry first; layers are ordered newest to oldest. Adds src."""
    rows = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("src", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    if as_of is not None:
        rows = rows.where(F.col("seq") <= as_of)
    rank = F.row_number().over(Window.partitionBy("key").orderBy("src", F.desc("seq")))
    return rows.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def merge(sources: list[DataFrame]) -> DataFrame:
    """k-way ordered merge; entries that two sources hold are both kept."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    return rows.orderBy("key", F.desc("seq"))


def prefix_range(prefix: bytes) -> tuple[bytes, bytes | None]:
    """[prefix, successor): a range that reaches the scan, where a prefix test on binary would not."""
    p = bytearray(prefix)
    while p and p[-1] == 0xFF:
        p.pop()
    if not p:
        return prefix, None
    p[-1] += 1
    return prefix, bytes(p)


def with_prefix(df: DataFrame, prefix, column: str = "key") -> DataFrame:
    """Rows whose key starts with ``prefix`` (bytes, or text for text keys)."""
    if isinstance(prefix, str):
        lo, hi = prefix_range(prefix.encode())
        lo, hi = lo.decode(), hi.decode() if hi is not None else None
    else:
        lo, hi = prefix_range(prefix)
    c: Column = F.col(column) >= F.lit(lo)
    return df.where(c if hi is None else c & (F.col(column) < F.lit(hi)))


def contains_prefix(df: DataFrame, prefix) -> bool:
    return not with_prefix(df, prefix).isEmpty()
