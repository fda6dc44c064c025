"""Compaction: dropping entries that no live view can see, and choosing what to compact.

A row goes iff a newer row of its key has seq <= horizon, or it is a deletion with seq <= horizon and no deeper
file covers its key. The newer row is looked up among all input rows, dropped ones included.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import DELETION, LEVELS

MIB = 1 << 20


def mark(log: DataFrame, horizon: int, deeper: DataFrame | None = None) -> DataFrame:
    """Adds reason: shadowed, tombstone or null (kept). deeper: FILES rows below the output level; None if none."""
    newer = F.lag("seq").over(Window.partitionBy("key").orderBy(F.desc("seq")))
    rows = log.withColumn("__newer", newer)
    if deeper is None:
        base = F.lit(True)
    else:
        spans = deeper.select("smallest_key", "largest_key").distinct()
        gone = rows.where((F.col("kind") == DELETION) & (F.col("seq") <= horizon)).select("key").distinct()
        covered = gone.join(F.broadcast(spans) if _small(spans) else spans, (F.col("key") >= F.col("smallest_key")) & (F.col("key") <= F.col("largest_key")), "left_semi").withColumn("__deeper", F.lit(True))
        rows = rows.join(covered, "key", "left")
        base = F.col("__deeper").isNull()
    reason = F.when(F.col("__newer") <= horizon, "shadowed").when((F.col("kind") == DELETION) & (F.col("seq") <= horizon) & base, "tombstone")
    return rows.withColumn("reason", reason).drop("__newer", "__deeper")


def _small(files: DataFrame, most: int = 50_000) -> bool:
    """File lists are broadcast only when counted to be small."""
    return files.limit(most + 1).count() <= most


def compact(log: DataFrame, horizon: int, deeper: DataFrame | None = None) -> DataFrame:
    """The rows that ``mark`` keeps, without a window: every row above the horizon, and of those up to it the newest of each key.

    The newest is a partial aggregate, so a key with very many versions is no single task's work.
    """
    rest = [c for c in log.columns if c != "key"]
    newest = log.where(F.col("seq") <= horizon).groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("e"))
    newest = newest.select(*[F.col("key") if c == "key" else F.col(f"e.`{c}`").alias(c) for c in log.columns])
    kept = newest.where(F.col("kind") != DELETION)
    if deeper is not None:
        spans, gone = deeper.select("smallest_key", "largest_key").distinct(), newest.where(F.col("kind") == DELETION)
        kept = kept.unionByName(gone.join(F.broadcast(spans) if _small(spans) else spans, (F.col("key") >= F.col("smallest_key")) & (F.col("key") <= F.col("largest_key")), "left_semi"))
    return log.where(F.col("seq") > horizon).unionByName(kept)


def gc_stats(log: DataFrame, horizon: int, deeper: DataFrame | None = None) -> DataFrame:
    return mark(log, horizon, deeper).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def file_meta(log: DataFrame, file_id: str = "file_id", level: str = "level") -> DataFrame:
    """FILES rows of a log whose rows say which file holds them."""
    size = F.sum(F.octet_length("key") + F.lit(8) + F.coalesce(F.octet_length("value"), F.lit(0)))
    low, high = F.min(F.struct(F.col("key"), (-F.col("seq")).alias("s"))), F.max(F.struct(F.col("key"), (-F.col("seq")).alias("s")))
    agg = log.groupBy(F.col(level).alias("level"), F.col(file_id).alias("file_id")).agg(size.cast("bigint").alias("size"), low.alias("lo"), high.alias("hi"), F.count("*").alias("entries"))
    return agg.select("level", "file_id", "size", F.col("lo.key").alias("smallest_key"), (-F.col("lo.s")).alias("smallest_seq"), F.col("hi.key").alias("largest_key"), (-F.col("hi.s")).alias("largest_seq"), seek_budget(F.col("size")).alias("allowed_seeks"), "entries")


def cut_tables(rows: DataFrame, file_id: str, most: int | None, bounds: list[bytes] = ()) -> DataFrame:
    """Tables of files whose rows are sorted by key: file_id, place in the file (from 0), size, smallest_key, largest_key, entries.

    A table ends at every multiple of ``most`` bytes, with the key that reaches it, and at every bound (``most`` None: one table a file).
    Keys are not split, and are added up before the running sums, so that versions of one key are no single task's work.
    """
    size = F.sum(F.octet_length("key") + F.lit(8) + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint").alias("size")
    if most is None:
        tables = rows.groupBy(F.col(file_id).alias("file_id")).agg(size, F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.count("*").alias("entries"))
        return tables.select("file_id", F.lit(0).alias("place"), "size", "smallest_key", "largest_key", "entries")
    keys = rows.groupBy(F.col(file_id).alias("file_id"), "key").agg(size, F.count("*").alias("entries"))
    keys = keys.withColumn("__cut", place(list(bounds), "binary", F.col("key"), before=True))
    before = F.sum("size").over(Window.partitionBy("file_id", "__cut").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    keys = keys.withColumn("__slice", F.floor(F.coalesce(before, F.lit(0)) / most))
    tables = keys.groupBy("file_id", "__cut", "__slice").agg(F.sum("size").alias("size"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.sum("entries").alias("entries"))
    order = Window.partitionBy("file_id").orderBy("smallest_key")
    return tables.select("file_id", (F.row_number().over(order) - 1).alias("place"), "size", "smallest_key", "largest_key", "entries")


def place(sorted_values: list, kind: str, c: Column, before: bool = False) -> Column:
    """How many of ``sorted_values`` are at or before ``c`` (``before``: only those before it): a binary search in a literal array.

    ``kind``: binary, or file (pairs of a number and a key, by ``struct(file, key)``).
    """
    n = len(sorted_values)
    if not n:
        return F.lit(0)
    literal = {"binary": lambda v: f"X'{v.hex()}'", "file": lambda v: f"struct({v[0]}L AS file, X'{v[1].hex()}' AS key)"}[kind]
    values = F.expr(f"array({', '.join(map(literal, sorted_values))})")

    def step(at, _):
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        value = F.get(values, middle)
        right = value < c if before else value <= c
        on = F.when(right, F.struct((middle + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), middle.alias("hi")))
        return F.when(at["lo"] < at["hi"], on).otherwise(at)

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.array_repeat(F.lit(0), n.bit_length() + 1), start, step, lambda at: at["lo"])


def overlaps(files: DataFrame) -> DataFrame:
    """overlaps: pairs of tables of one level below the first whose key ranges meet, by one sort and not pair by pair.

    Of tables in order of their smallest key, each meets all before it but those that end before it starts.
    """
    ends = files.where("level > 0").select("level", F.explode(F.array(F.struct(F.col("smallest_key").alias("key"), F.lit(0).alias("end")), F.struct(F.col("largest_key").alias("key"), F.lit(1).alias("end")))).alias("e")).select("level", "e.*")
    # At the same key starts come first: tables that share one key meet.
    order = Window.partitionBy("level").orderBy("key", "end").rowsBetween(Window.unboundedPreceding, -1)
    open_now = F.sum(F.when(F.col("end") == 0, 1).otherwise(-1)).over(order)
    met = ends.withColumn("__open", F.coalesce(open_now, F.lit(0))).where("end = 0")
    return met.agg(F.coalesce(F.sum("__open"), F.lit(0)).cast("bigint").alias("overlaps"))


def seek_budget(size: Column) -> Column:
    return F.greatest(F.floor(size / 16384), F.lit(100)).cast("bigint")


def overlapping(files: DataFrame, lo=None, hi=None) -> DataFrame:
    """Files that overlap [lo, hi]; a missing bound is open."""
    keep = F.lit(True)
    if lo is not None:
        keep = keep & (F.col("largest_key") >= F.lit(lo))
    if hi is not None:
        keep = keep & (F.col("smallest_key") <= F.lit(hi))
    return files.where(keep)


def files_for_key(files: DataFrame, key) -> DataFrame:
    """Files that may hold a key in the order they are asked: level 0 newest first, then by level."""
    order = F.when(F.col("level") == 0, -F.col("file_id")).otherwise(F.col("file_id"))
    return overlapping(files, key, key).withColumn("__o", order).orderBy("level", "__o").drop("__o")


def find_file(files: DataFrame, key) -> DataFrame:
    """Of a sorted level, the first file whose largest key is at or after ``key``."""
    return files.where(F.col("largest_key") >= F.lit(key)).orderBy("largest_key").limit(1)


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def level_score(files: DataFrame) -> DataFrame:
    """Level 0: files / 4; levels 1 to 5: bytes / 10^level MiB."""
    score = F.when(F.col("level") == 0, F.col("n_files") / 4.0).otherwise(F.col("bytes") / (F.pow(F.lit(10.0), F.col("level")) * MIB))
    return level_stats(files).where(F.col("level") < LEVELS - 1).withColumn("score", score)


def key_range(files: DataFrame) -> DataFrame:
    return files.agg(F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"))


def approx_offset(files: DataFrame) -> DataFrame:
    """Bytes of the files before each one, by level and key."""
    w = Window.partitionBy("level").orderBy("smallest_key", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))


@dataclass
class Plan:
    """A chosen compaction: its level, the input files at that level and the next, and the files two below."""

    level: int
    inputs: list
    below: list
    grandparents: list = field(default_factory=list)

    def trivial(self, max_file_size: int) -> bool:
        """One file with nothing below it, and no more than ten files' worth beneath that, moves without being rewritten."""
        return len(self.inputs) == 1 and not self.below and sum(f["size"] for f in self.grandparents) <= 10 * max_file_size

    def bounds(self, max_file_size: int) -> list[bytes]:
        """Keys at which output files end, so that none meets more than ten files' worth two levels down."""
        out, seen = [], 0
        for f in self.grandparents:
            seen += f["size"]
            if seen > 10 * max_file_size:
                out.append(f["largest_key"])
                seen = 0
        return out


class Picker:
    """Decisions over the file list (metadata, held by the driver like any manifest). Each level is sorted once; below the first its files
    are disjoint, so that those of a range are found by bisection."""

    def __init__(self, files: list, max_file_size: int = 2 << 20, level0_trigger: int = 4):
        self.files, self.max_file, self.trigger = files, max_file_size, level0_trigger
        self._levels: list[list] = [[] for _ in range(LEVELS)]
        for f in sorted(files, key=self._order):
            self._levels[f["level"]].append(f)
        self._bytes = [sum(f["size"] for f in row) for row in self._levels]

    @staticmethod
    def _order(f: dict) -> tuple:
        return f["smallest_key"], f["file_id"]

    def level(self, n: int) -> list:
        return self._levels[n]

    def move(self, f: dict) -> None:
        """The file is one level further down from now on."""
        n, row = f["level"], self._levels[f["level"]]
        del row[bisect_left(row, self._order(f), key=self._order)]
        insort(self._levels[n + 1], f | {"level": n + 1}, key=self._order)
        self._bytes[n] -= f["size"]
        self._bytes[n + 1] += f["size"]

    def overlap(self, n: int, lo=None, hi=None) -> list:
        """Overlapping files; at level 0 the range widens until it is stable, for its files overlap one another."""
        row = self.level(n)
        if n:
            first = 0 if lo is None else bisect_left(row, lo, key=lambda f: f["largest_key"])
            return row[first : len(row) if hi is None else bisect_right(row, hi, key=lambda f: f["smallest_key"])]
        while True:
            hit = [f for f in row if (lo is None or f["largest_key"] >= lo) and (hi is None or f["smallest_key"] <= hi)]
            if not hit:
                return hit
            low, high = min(f["smallest_key"] for f in hit), max(f["largest_key"] for f in hit)
            if (lo is None or low >= lo) and (hi is None or high <= hi):
                return hit
            lo, hi = None if lo is None else min(lo, low), None if hi is None else max(hi, high)

    def overlaps(self, n: int, lo, hi) -> bool:
        return bool(self.overlap(n, lo, hi)) if n else any(f["largest_key"] >= lo and f["smallest_key"] <= hi for f in self.level(n))

    def scores(self) -> dict[int, float]:
        out = {0: len(self.level(0)) / self.trigger}
        return out | {n: self._bytes[n] / (10**n * MIB) for n in range(1, LEVELS - 1)}

    def memtable_level(self, lo, hi, most: int = 2) -> int:
        """How deep a new table may go: not past an overlap, nor above 10 files' worth two levels down."""
        if self.overlaps(0, lo, hi):
            return 0
        n = 0
        while n < most:
            if self.overlaps(n + 1, lo, hi):
                break
            if n + 2 < LEVELS and sum(f["size"] for f in self.overlap(n + 2, lo, hi)) > 10 * self.max_file:
                break
            n += 1
        return n

    def expand(self, level: int, inputs: list) -> Plan:
        """Add the next level's overlap, then more of this level if that draws in nothing further below and stays bounded."""

        def span(files):
            return min(f["smallest_key"] for f in files), max(f["largest_key"] for f in files)

        below = self.overlap(level + 1, *span(inputs))
        lo, hi = span(inputs + below)
        if below:
            more = self.overlap(level, lo, hi)
            size = sum(f["size"] for f in below) + sum(f["size"] for f in more)
            if len(more) > len(inputs) and size < 25 * self.max_file:
                again = self.overlap(level + 1, *span(more))
                if len(again) == len(below):
                    inputs, below = more, again
                    lo, hi = span(inputs + below)
        grand = self.overlap(level + 2, lo, hi) if level + 2 < LEVELS else []
        return Plan(level, inputs, below, grand)

    def pick(self, pointers: dict[int, bytes] | None = None) -> Plan | None:
        """The level of the highest score, if it is 1 or more, from where the last compaction of it ended."""
        scores = self.scores()
        level = max(scores, key=lambda n: (scores[n], n))
        if scores[level] < 1:
            return None
        files, at = self.level(level), (pointers or {}).get(level)
        if level == 0 or at is None:
            start = next((f for f in files if at is None or f["largest_key"] > at), files[0])
        else:
            start = files[bisect_right(files, at, key=lambda f: f["largest_key"]) % len(files)]
        inputs = self.overlap(0, start["smallest_key"], start["largest_key"]) if level == 0 else [start]
        return self.expand(level, inputs)

    def pick_range(self, level: int, lo=None, hi=None) -> Plan | None:
        inputs = self.overlap(level, lo, hi)
        return self.expand(level, inputs) if inputs else None

    def is_base_level(self, key, below: int) -> bool:
        return not any(f["level"] > below and f["smallest_key"] <= key <= f["largest_key"] for f in self.files)
