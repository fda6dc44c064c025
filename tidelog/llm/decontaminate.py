"""Benchmark decontamination by winnowing.

Fingerprints are 5-word hashes; each window of 9 consecutive ones (13 words) keeps its minimum. Two texts that
share 13 consecutive words share that minimum, so no shared span is missed. The benchmark's minima are kept in
a bitmap of fixed size (``BITS``): it has no false negatives and its size does not depend on the benchmark.
Document windows that pass it are extended to their full content by a 128-bit digest, which is joined with
the benchmark's windows: that join decides. Items of 1 to 12 words are one window each, found by the same
two steps with the whole item as its only fingerprint.

Edge cases: null or empty text has no words (all counts 0, not contaminated). Benchmark rows with a null
item_id or without words take no part; repeated item_ids count once. Repeated documents and documents with a
null doc_id each get their own row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, salted_join, table, words_of

K, W = 5, 9
SPAN = K + W - 1
BITS = 1 << 25
#: A document is contaminated from one hit word in so many on.
SHARE = 20
_MUL = np.random.default_rng(5).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _grams(c: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of each run of ``n`` words."""
    m = len(c) - n + 1
    h = np.full(m, salt, dtype=np.uint64)
    for j in range(n):
        h += c[j : j + m] * _MUL[j]
    return _mix(h)


def window_minima(c: np.ndarray) -> np.ndarray:
    """The winnowing minimum of each run of 13 words."""
    h = _grams(c, K, 0)
    h2 = np.minimum(h[:-1], h[1:])
    h4 = np.minimum(h2[:-2], h2[2:])
    h8 = np.minimum(h4[:-4], h4[4:])
    return np.minimum(h8[: len(h) - 8], h[8:])


def _marks(words: list[bytes], n: int) -> np.ndarray:
    c = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    return window_minima(c) if n == SPAN else _grams(c, n, n)


def _digest(words: list[bytes], s: int, n: int) -> bytes:
    return hashlib.md5(b" ".join(words[s : s + n])).digest()


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, n, mark, digest): every window of every item."""

    def run(batches):
        for b in batches:
            out = ([], [], [], [])
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ws = words_of(raw)
                if not ws:
                    continue
                n = min(SPAN, len(ws))
                marks = _marks(ws, n).view(np.int64).tolist()
                out[0].extend([i] * len(marks))
                out[1].extend([n] * len(marks))
                out[2].extend(marks)
                out[3].extend(_digest(ws, s, n) for s in range(len(marks)))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["item_id", "n", "mark", "digest"])

    src = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    kind = src.schema["item_id"].dataType.simpleString()
    return src.mapInArrow(run, f"item_id {kind}, n int, mark bigint, digest binary")


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The marks as a bitmap of BITS bits (its set words only come to the driver: BITS / 64 at most), and the window lengths."""
    cell = F.pmod(F.col("mark"), F.lit(BITS))
    rows = windows.groupBy((cell / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))).alias("v")).toPandas()
    bits = np.zeros(BITS // 64, dtype=np.int64)
    bits[rows["w"].to_numpy(dtype=np.int64)] = rows["v"].to_numpy(dtype=np.int64)
    return bits.view(np.uint8), sorted(r[0] for r in windows.select("n").distinct().collect())


def candidates(docs: DataFrame, bits: np.ndarray, lengths: list[int], keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words, and the windows of each document that pass the bitmap: array of (s, n, digest)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        bitmap = np.frombuffer(shared.value, dtype=np.uint8)
        kind = pa.struct([("s", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())])
        for b in batches:
            n_words, found = [], []
            for raw in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist():
                ws = words_of(raw)
                n_words.append(len(ws))
                hits = []
                for n in lengths:
                    if len(ws) >= n:
                        cell = _marks(ws, n) & np.uint64(BITS - 1)
                        ok = (bitmap[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1
                        hits += [{"s": s, "n": n, "digest": _digest(ws, s, n)} for s in np.flatnonzero(ok).tolist()]
                found.append(hits)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n_words, pa.int64()), pa.array(found, pa.list_(kind))], [*keep, "n_words", "found"])

    src = docs.select(*keep, "text")
    kinds = "".join(f"`{c}` {src.schema[c].dataType.simpleString()}, " for c in keep)
    return src.mapInArrow(run, f"{kinds}n_words bigint, found array<struct<s:int,n:int,digest:binary>>")


def _hits(docs: DataFrame, items: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """``keep`` columns, n_words and found of each document beside a row number rid; and, of each rid with a hit, n_hit, its longest window, spans and item_ids."""
    windows = materialize(benchmark_windows(items), "windows")
    bits, lengths = _bitmap(windows)
    base = materialize(candidates(docs, bits, lengths, keep).withColumn("rid", F.monotonically_increasing_id()), "found")
    cand = base.where(F.size("found") > 0).select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    known = materialize(windows.select("n", "digest").distinct(), "digests")
    hits = materialize(salted_join(cand, known, ["n", "digest"], "inner", 8), "hits")
    # Runs of hit words: a window opens one if it starts after every earlier one's end.
    spans = hits.select("rid", "s", "n", (F.col("s") + F.col("n")).alias("e")).distinct()
    by_start = Window.partitionBy("rid").orderBy("s", "e")
    reach = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    runs = spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("rid", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("longest"))
    spans = runs.groupBy("rid").agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("n_hit"), F.max("longest").alias("longest"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    items_of = windows.select("n", "digest", "item_id").distinct()
    named = salted_join(hits.select("rid", "n", "digest").distinct(), items_of, ["n", "digest"], "inner", 8).select("rid", "item_id").distinct()
    named = named.groupBy("rid").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    return base, spans.join(named, "rid")


def _contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, items: DataFrame, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans.

    contaminated: n_hit > 0 and share * n_hit >= n_words. spans: maximal runs of hit words as (start, end).
    """
    base, per = _hits(docs, items, ["doc_id"])
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return (
        base.drop("found")
        .join(per, "rid", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), "spans")
        .withColumn("contaminated", _contaminated(share))
    )


def decontaminate(docs: DataFrame, items: DataFrame, share: int = SHARE) -> DataFrame:
    """The documents without benchmark text, with all their columns. Each row is judged by itself, whatever its id or that of others.

    A row goes if it holds a window of SPAN words, however long it is, or if it is contaminated by ``share``: items
    shorter than SPAN words can occur by chance, so these count by the share of hit words only.
    """
    plain = docs.toDF(*[c if c == "text" else f"__{i}" for i, c in enumerate(docs.columns)])  # no name can clash with those added here
    base, per = _hits(plain, items, plain.columns)
    suspects = base.where(F.size("found") > 0)
    judged = suspects.select("rid", "n_words").join(per, "rid")
    flagged = judged.where((F.col("longest") >= SPAN) | _contaminated(share)).select("rid")
    kept = base.where(F.size("found") == 0).unionByName(suspects.join(materialize(flagged, "flagged"), "rid", "left_anti"))
    return kept.select(*plain.columns).toDF(*docs.columns)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


#: DuckDB: every 13-word window of every text, joined as lists of words.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
