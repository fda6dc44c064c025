"""Best-fit packing of token sequences by linear grouping.

Only the histogram of piece lengths (one row per length, at most ``limit`` of them) comes to the driver; the plan
it makes is a list of runs "m sequences, each with pieces of these lengths", whose size depends on the number of
lengths and not of documents:

1. Large lengths are sorted and cut into groups of equal cardinality; each is rounded up to its group's maximum.
2. For the few rounded sizes, configurations are chosen one after another: a bounded subset-sum over the sizes
   that remain, through the largest of them, finds the fullest configuration, used as often as counts allow.
3. Actual lengths take the places of the rounded ones, which leaves slack.
4. Small pieces go, longest first, where they leave the least room; new sequences open only when none has room.

Then every piece gets its place by its rank among pieces of its length. Ranks are counted in buckets, so that a
length which a third of all pieces share is spread over tasks.

Edge cases: null text is empty (one piece with the end id alone); documents longer than ``limit`` are cut and no
others; repeated rows and null ids are packed as separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, table, tokenizer_path
from tidelog.llm.tokens import encoder

LIMIT, END_ID = 4096, 1
#: Lengths over LIMIT / LARGE count as large; they are cut into GROUPS groups.
LARGE, GROUPS = 8, 256


def token_pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian u32)."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                rows, pieces, starts, lengths, crcs, blobs = [], [], [], [], [], []
                for i, x in enumerate(encoder(vocabulary).encode(part.column(1).cast(pa.binary()).to_pylist(), end_id)):
                    for p, at in enumerate(range(0, len(x), 4 * limit)):
                        y = x[at : at + 4 * limit] if len(x) > 4 * limit else x
                        rows.append(i)
                        pieces.append(p)
                        starts.append(at // 4)
                        lengths.append(len(y) // 4)
                        crcs.append(zlib.crc32(y))
                        if with_ids:
                            blobs.append(y)
                cols = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(blobs, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def _groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Equal-cardinality groups of (length, count), longest first."""
    total, out, room = sum(counts.values()), [], 0
    size = max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            take = min(left, room)
            out[-1].append((length, take))
            left, room = left - take, room - take
    return out


def _fullest(sizes: list[int], left: list[int], limit: int) -> list[int]:
    """How many of each size make the fullest configuration that holds the largest size left."""
    top = max((s, i) for i, s in enumerate(sizes) if left[i])[1]
    made = np.full(limit + 1, -1, dtype=np.int32)  # which size completed this sum first
    made[sizes[top]] = top
    for i in sorted((i for i in range(len(sizes)) if left[i]), key=lambda i: -sizes[i]):
        s, had = sizes[i], left[i] - (i == top)
        reach = made >= 0
        for _ in range(min(had, limit // s)):
            new = np.zeros(limit + 1, dtype=bool)
            new[s:] = reach[:-s]
            new &= made < 0
            if not new.any():
                break
            made[new] = i
            reach = new
    at, out = int(np.flatnonzero(made >= 0)[-1]), [0] * len(sizes)
    while at > 0:
        i = int(made[at])
        out[i] += 1
        at -= sizes[i]
    return out


def plan(histogram: dict[int, int], limit: int = LIMIT, large: int = LARGE, groups: int = GROUPS) -> list[tuple[int, list[int]]]:
    """Runs (m, lengths): m sequences that each hold pieces of these lengths."""
    runs = [(n, [limit]) for length, n in histogram.items() if length == limit and n]
    big = {x: n for x, n in histogram.items() if limit // large < x < limit and n}
    small = {x: n for x, n in histogram.items() if x <= limit // large and x < limit and n}
    queues = _groups(big, groups)
    sizes, left = [q[0][0] for q in queues], [sum(n for _, n in q) for q in queues]
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    keys: list[int] = []

    def put(m: int, lengths: list[int]) -> None:
        slack = limit - sum(lengths)
        if slack not in open_:
            open_[slack] = []
            bisect.insort(keys, slack)
        open_[slack].append((m, lengths))

    def take(i: int, m: int) -> list[tuple[int, int]]:
        """The next m actual lengths of group i, as runs."""
        got = []
        while m:
            length, n = queues[i][0]
            k = min(m, n)
            got.append((length, k))
            m -= k
            queues[i][0] = (length, n - k)
            if n == k:
                queues[i].pop(0)
        return got

    while any(left):
        config = _fullest(sizes, left, limit)
        m = min(left[i] // a for i, a in enumerate(config) if a)
        slots = [take(i, m) for i, a in enumerate(config) for _ in range(a)]
        for i, a in enumerate(config):
            left[i] -= m * a
        while m:  # cut where any slot changes its length
            k = min(s[0][1] for s in slots)
            put(k, [s[0][0] for s in slots])
            m -= k
            for s in slots:
                s[0] = (s[0][0], s[0][1] - k)
                if not s[0][1]:
                    s.pop(0)
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            at = bisect.bisect_left(keys, length)
            if at == len(keys):
                q = limit // length
                m = max(1, n // q)
                have, slack = (m, []), limit
            else:
                slack = keys[at]
                have = open_[slack].pop()
                if not open_[slack]:
                    del open_[slack]
                    keys.pop(at)
            q = min(slack // length, n)
            m = min(have[0], n // q)
            put(m, have[1] + [length] * q)
            if have[0] > m and have[1]:
                put(have[0] - m, have[1])
            n -= m * q
    return runs + [r for rs in open_.values() for r in rs]


def _places(runs: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each run and length in it: first rank, first sequence, places per sequence, and their offsets."""
    rows, base, used = [], 0, {}
    for m, lengths in runs:
        at, spots = 0, {}
        for x in lengths:
            spots.setdefault(x, []).append(at)
            at += x
        for x, offsets in spots.items():
            rows.append((x, used.get(x, 0), base, offsets))
            used[x] = used.get(x, 0) + m * len(offsets)
        base += m
    rows.sort(key=lambda r: (r[0], r[1]))
    flat = np.array([o for r in rows for o in r[3]], dtype=np.int32)
    each = np.array([len(r[3]) for r in rows], dtype=np.int32)
    return {
        "key": np.array([(r[0] << 44) + r[1] for r in rows], dtype=np.int64),
        "rank": np.array([r[1] for r in rows], dtype=np.int64),
        "base": np.array([r[2] for r in rows], dtype=np.int64),
        "each": each,
        "at": np.cumsum(each) - each,
        "flat": flat,
    }


#: Columns of a piece.
PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...). ``pieces`` must be materialised: it is read three times.

    Further columns may have any name.
    """
    spark, given = pieces.sparkSession, pieces.columns
    pieces = pieces.toDF(*[c if c in PIECE else f"__{i}" for i, c in enumerate(given)])  # no name can clash with those added here
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    per = materialize(keyed.groupBy("length", "__b").agg(F.count("*").alias("__n")), "lengths")
    histogram = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("__n")).collect()}
    places = _places(plan(histogram, limit))
    shared = spark.sparkContext.broadcast(places)
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__b")) - F.col("__n")
    first = per.withColumn("__before", before).drop("__n")
    order = Window.partitionBy("length", "__b").orderBy(*[c for c in PIECE if c in pieces.columns])
    ranked = keyed.withColumn("__r", F.row_number().over(order)).join(first, ["length", "__b"]).withColumn("__rank", F.col("__before") + F.col("__r") - 1)

    names = [*pieces.columns, "__sequence", "__offset"]

    def run(batches):
        t = shared.value
        for b in batches:
            length, rank = b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            i = np.searchsorted(t["key"], (length << 44) + rank, side="right") - 1
            k = rank - t["rank"][i]
            seq = t["base"][i] + k // t["each"][i]
            off = t["flat"][t["at"][i] + k % t["each"][i]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(seq), pa.array(off)], names)

    src = ranked.select(*pieces.columns, F.col("length").alias("__length"), "__rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return src.mapInArrow(run, f"{kinds}, __sequence bigint, __offset bigint").toDF(*given, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    return pack(materialize(token_pieces(docs, vocabulary or tokenizer_path(), limit, END_ID, with_ids), "pieces"), limit)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
