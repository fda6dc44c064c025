"""Snapshots: pinned sequence numbers, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.view import view


class Snapshot:
    """A pinned sequence number; released by ``release`` or at the end of a with-block."""

    def __init__(self, registry: "SnapshotList", handle: int, seq: int):
        self._registry, self.handle, self.seq = registry, handle, seq

    def release(self) -> None:
        self._registry.live.pop(self.handle, None)

    def __enter__(self) -> "Snapshot":
        return self

    def __exit__(self, *_) -> None:
        self.release()


class SnapshotList:
    def __init__(self):
        self.live: dict[int, int] = {}
        self._next = 1

    def take(self, seq: int) -> Snapshot:
        handle, self._next = self._next, self._next + 1
        self.live[handle] = seq
        return Snapshot(self, handle, seq)

    def empty(self) -> bool:
        return not self.live

    def oldest(self) -> int:
        return min(self.live.values(), default=0)

    def newest(self) -> int:
        return max(self.live.values(), default=0)

    def horizon(self, last_sequence: int) -> int:
        """What compaction must keep: the oldest live snapshot, or everything now visible."""
        return self.oldest() if self.live else last_sequence


def diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """(key, old_value, new_value, change) with change INSERT, DELETE, UPDATE or SAME.

    One pass: both states of a key come from one aggregation, so the log is read and shuffled once.
    """
    both = log.where(F.col("seq") <= max(old, new)).groupBy("key").agg(
        F.max_by(F.struct("kind", "value", "seq"), F.when(F.col("seq") <= old, F.col("seq"))).alias("a"),
        F.max_by(F.struct("kind", "value", "seq"), F.when(F.col("seq") <= new, F.col("seq"))).alias("b"),
    )
    a, b = F.coalesce(F.col("a.kind") == 1, F.lit(False)), F.coalesce(F.col("b.kind") == 1, F.lit(False))
    change = F.when(~a, "INSERT").when(~b, "DELETE").when(F.col("a.value").eqNullSafe(F.col("b.value")), "SAME").otherwise("UPDATE")
    return both.where(a | b).select("key", F.when(a, F.col("a.value")).alias("old_value"), F.when(b, F.col("b.value")).alias("new_value"), change.alias("change"))


def diff_by_join(log: DataFrame, old: int, new: int) -> DataFrame:
    """The same as ``diff``, as an outer join of two views."""
    a = view(log, old).select("key", F.col("value").alias("old_value"), F.lit(1).alias("__a"))
    b = view(log, new).select("key", F.col("value").alias("new_value"), F.lit(1).alias("__b"))
    change = F.when(F.col("__a").isNull(), "INSERT").when(F.col("__b").isNull(), "DELETE").when(F.col("old_value").eqNullSafe(F.col("new_value")), "SAME").otherwise("UPDATE")
    return a.join(b, "key", "full_outer").withColumn("change", change).drop("__a", "__b")
