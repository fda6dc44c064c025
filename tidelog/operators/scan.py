"""Ordered scans, seeks and a cursor over a view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import VALUE
from tidelog.operators.view import view


def scan(log: DataFrame, as_of: int | None = None, lo=None, hi=None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Visible entries with lo <= key <= hi, ordered; the bounds apply below the view and reach the scan."""
    if lo is not None:
        log = log.where(F.col("key") >= F.lit(lo))
    if hi is not None:
        log = log.where(F.col("key") <= F.lit(hi))
    out = view(log, as_of).orderBy(F.desc("key") if reverse else F.asc("key"))
    return out.limit(limit) if limit is not None else out


def _nearest(log: DataFrame, as_of: int | None, reverse: bool = False, take: int = 64, most: int = 4096) -> DataFrame:
    """The first visible entry by key (last, if ``reverse``) as a table of one row or none.

    Each try is a bounded top-k (no shuffle: every partition hands on ``take`` rows) in order of key and then newest
    first, so a key's first row is its newest. Where all of them are deleted, the next try goes on behind the last key.
    """
    if as_of is not None:
        log = log.where(F.col("seq") <= as_of)
    order, rows, found = F.desc("key") if reverse else F.asc("key"), [], None
    rest = log.select("key", "seq", "kind", "value")
    while found is None:
        rows, seen = rest.orderBy(order, F.desc("seq")).limit(take).collect(), None
        for r in rows:
            if r["key"] != seen and r["kind"] == VALUE:
                found = r
                break
            seen = r["key"]
        if len(rows) < take:
            break
        end = F.lit(rows[-1]["key"])
        rest = rest.where(F.col("key") < end if reverse else F.col("key") > end)
        take = min(most, 8 * take)
    schema = log.select("key", "seq", "value").schema
    return log.sparkSession.createDataFrame([] if found is None else [(found["key"], found["seq"], found["value"])], schema)


def seek(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """The first visible entry at or after ``key``."""
    return _nearest(log.where(F.col("key") >= F.lit(key)), as_of)


def prev(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    """The last visible entry before ``key``."""
    return _nearest(log.where(F.col("key") < F.lit(key)), as_of, True)


def after(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    return _nearest(log.where(F.col("key") > F.lit(key)), as_of)


def first(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return _nearest(log, as_of)


def last(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return _nearest(log, as_of, True)


class Cursor:
    """A position in a view. Invalid before the first step; a step off either end makes it invalid; a step forward
    when invalid goes to the first entry. Each move is one bounded query; ``fetch`` reads many entries with one."""

    def __init__(self, log: DataFrame, as_of: int | None = None):
        self.log, self.as_of, self.row = log, as_of, None

    def _to(self, df: DataFrame) -> bool:
        self.row = df.first()
        return self.row is not None

    def valid(self) -> bool:
        return self.row is not None

    def current(self) -> tuple | None:
        return (self.row["key"], self.row["value"]) if self.row else None

    def advance(self) -> bool:
        return self._to(after(self.log, self.row["key"], self.as_of) if self.row else first(self.log, self.as_of))

    def next(self) -> tuple | None:
        return self.current() if self.advance() else None

    def prev(self) -> bool:
        return self._to(prev(self.log, self.row["key"], self.as_of)) if self.row else False

    def seek(self, key) -> bool:
        return self._to(seek(self.log, key, self.as_of))

    def seek_to_first(self) -> bool:
        return self._to(first(self.log, self.as_of))

    def seek_to_last(self) -> bool:
        return self._to(last(self.log, self.as_of))

    def reset(self) -> None:
        self.row = None

    def fetch(self, n: int) -> list[tuple]:
        """The next n entries; the cursor ends on the last of them."""
        lo = self.row["key"] if self.row else None
        log = self.log if lo is None else self.log.where(F.col("key") > F.lit(lo))
        rows = scan(log, self.as_of, limit=n).collect()
        self.row = rows[-1] if rows else None
        return [(r["key"], r["value"]) for r in rows]

    def __iter__(self):
        """Everything from the start, partition by partition."""
        for r in scan(self.log, self.as_of).toLocalIterator(prefetchPartitions=True):
            yield r["key"], r["value"]
