"""Queries over stores that are built, written, reopened and compacted on the way, with the same results as DuckDB SQL.

The stores are made of orders (key o_custkey, an order of status F deletes, in order of o_orderkey) in the scratch folder.
"""

from __future__ import annotations

import asyncio
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import Options
from tidelog.operators import compaction
from tidelog.operators.batch import WriteBatch, assign_seq
from tidelog.plans.catalogue import TOP, _v, key, plain, query
from tidelog.plans.testlogs import ORDERS_SQL, orders_log
from tidelog.scratch import scratch_dir
from tidelog.sources.store import KVStore
from tidelog.streaming.aio import AsyncStore
from tidelog.streaming.ingest import ingest

SMALL = Options(write_buffer_size=1 << 16, max_file_size=1 << 14)
#: Sequence numbers are consecutive here: each order's is its rank.
LOG = ORDERS_SQL.replace("o_orderkey + 1 AS seq", "row_number() OVER (ORDER BY o_orderkey) AS seq")


def _path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"


def _open(spark: SparkSession, path: str) -> KVStore:
    return KVStore.open(spark, path, SMALL)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return orders_log(spark, d).withColumnRenamed("seq", "ord")


def _load(spark: SparkSession, d: str, path: str, slices: int = 3) -> KVStore:
    """Orders as ``slices`` bulk batches by o_orderkey; the store is reopened after each."""
    rows = _entries(spark, d)
    top = rows.agg(F.max("ord")).first()[0] or 0
    for i in range(slices):
        with _open(spark, path) as s:
            s.bulk_write(rows.where((F.col("ord") > top * i // slices) & (F.col("ord") <= top * (i + 1) // slices)), "ord")
    return _open(spark, path)


@query(f"WITH {LOG}, {_v()} SELECT k, seq, v FROM v")
def kv_store_scan(spark, d):
    return plain(_load(spark, d, _path(spark)).scan())


@query(f"WITH {LOG}, {_v()} SELECT k, seq, v FROM v WHERE k BETWEEN 100 AND 200")
def kv_store_range(spark, d):
    s = _load(spark, d, _path(spark))
    s.compact_range()
    return plain(s.scan(key(100), key(200)))


@query(f"WITH {LOG}, m AS (SELECT *, max(seq) OVER (PARTITION BY k) AS top FROM log) SELECT k, seq, kind, v FROM m WHERE seq = top AND kind = 1")
def kv_store_compacted(spark, d):
    """All entries that are left after everything is compacted."""
    s = _load(spark, d, _path(spark))
    s.compact_range()
    return plain(s.log_df()).withColumn("kind", F.col("kind").cast("int"))


@query("SELECT CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS outside, count(DISTINCT o_custkey) FILTER (WHERE alive) AS entries, true AS several FROM (SELECT o_custkey, last_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) <> 'F' AS alive FROM orders)")
def kv_store_tables(spark, d):
    """Tables after compaction: of one level no two overlap, none is over the size by more than one key's share, and their entries add up."""
    s = _load(spark, d, _path(spark))
    s.compact_range()
    while s.maintain():
        pass
    files = s.files_df()
    outside = files.agg(F.count(F.when(F.col("size") > 4 * SMALL.max_file_size, 1)).alias("outside"), (F.count("*") > 1).alias("several"))
    entries = spark.createDataFrame([(sum(f["entries"] for f in s.files),)], "entries bigint")
    return compaction.overlaps(files).crossJoin(outside).crossJoin(entries)  # three one-row tables


@query(f"WITH {LOG}, h AS (SELECT count(*) // 3 AS s FROM log), u AS (SELECT log.* FROM log, h WHERE seq <= s), {_v(TOP, 'a', 'u')}, {_v(TOP, 'b')} SELECT 'then' AS at, k, seq, v FROM va UNION ALL SELECT 'now' AS at, k, seq, v FROM vb")
def kv_store_snapshot(spark, d):
    """A snapshot that is taken before two thirds of the writes and read after compaction."""
    rows, n = _entries(spark, d), _entries(spark, d).count()
    # The order of the entry at a third: entries are numbered by partitions, where a limit would put a third of them into one task.
    third = assign_seq(rows.select("ord"), 0, "ord").where(F.col("seq") == max(1, n // 3)).first()
    cut = third["ord"] if third else 0
    s = _open(spark, _path(spark))
    s.bulk_write(rows.where(F.col("ord") <= cut), "ord")
    with s.snapshot() as pin:
        s.bulk_write(rows.where(F.col("ord") > cut), "ord")
        s.compact_range()
        return plain(s.scan(snapshot=pin)).withColumn("at", F.lit("then")).unionByName(plain(s.scan()).withColumn("at", F.lit("now")))


_FEW = "few AS (SELECT * FROM orders WHERE o_custkey <= 40)"


def _small_writes(spark, d, path, batches=25):
    """Orders of forty customers as put and delete batches, in order, by a store that is left without being closed."""
    rows = spark.read.parquet(f"{d}/orders.parquet").where("o_custkey <= 40").orderBy("o_orderkey").select("o_custkey", "o_orderstatus", "o_orderpriority").toLocalIterator()
    s, batch = _open(spark, path), WriteBatch()
    for r in rows:
        k = bytes(key(r[0]))
        batch = batch.delete(k) if r[1] == "F" else batch.add(k, r[2].encode())
        if len(batch) == batches:
            s.write(batch)
            batch = WriteBatch()
    s.write(batch)
    return s


_FEWLOG = f"WITH {_FEW}, " + LOG.replace("FROM orders", "FROM few")


@query(f"{_FEWLOG}, {_v()} SELECT k, seq, v FROM v")
def kv_store_replay(spark, d):
    """Batches that no table holds, read back from the log after the writer is gone."""
    path = _path(spark)
    s = _small_writes(spark, d, path)
    s.env.unlock(f"{path}/LOCK")
    return plain(_open(spark, path).scan())


@query(f"{_FEWLOG}, {_v()}, ks AS (SELECT unnest(range(1, 46)) AS k) SELECT ks.k, v FROM ks LEFT JOIN v ON ks.k = v.k")
def kv_store_gets(spark, d):
    s = _small_writes(spark, d, _path(spark))
    s.maintain()
    rows = [(k, s.get(bytes(key(k)))) for k in range(1, 46)]
    return spark.createDataFrame([(k, None if v is None else v.decode()) for k, v in rows], "k bigint, v string")


@query(f"{_FEWLOG}, {_v()}, r AS (SELECT k, v, row_number() OVER (ORDER BY k) AS n, count(*) OVER () AS c FROM v) SELECT 'first' AS step, k, v FROM r WHERE n = 1 UNION ALL SELECT 'next', k, v FROM r WHERE n = 2 UNION ALL SELECT 'last', k, v FROM r WHERE n = c UNION ALL SELECT 'back', k, v FROM r WHERE n = c - 1 UNION ALL SELECT 'seek', k, v FROM (SELECT * FROM r WHERE k >= 20 ORDER BY k LIMIT 1)")
def kv_store_cursor(spark, d):
    s = _small_writes(spark, d, _path(spark))
    s.compact_range()
    c, out = s.cursor(), []
    for step, move in (("first", c.seek_to_first), ("next", c.advance), ("last", c.seek_to_last), ("back", c.prev), ("seek", lambda: c.seek(key(20)))):
        if move():
            k, v = c.current()
            out.append((step, int.from_bytes(bytes(k), "big") - (1 << 63), bytes(v).decode()))
    return spark.createDataFrame(out, "step string, k bigint, v string")


@query(f"{_FEWLOG}, {_v()} SELECT k, v FROM v WHERE k <= 10")
def kv_store_async(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").where("o_custkey <= 10").orderBy("o_orderkey").select("o_custkey", "o_orderstatus", "o_orderpriority").toLocalIterator()

    async def go():
        s = await AsyncStore.open(spark, _path(spark), SMALL)
        for r in rows:
            k = bytes(key(r[0]))
            await (s.delete(k) if r[1] == "F" else s.put(k, r[2].encode()))
        at = await s.get_snapshot()
        await s.put(bytes(key(1)), b"later")
        await s.flush()
        await s.compact_range()
        got = [(k, await s.get_at(at, bytes(key(k)))) for k in range(0, 11)]
        await s.drop_snapshot(at)
        await s.close()
        return got

    return spark.createDataFrame([(k, v.decode()) for k, v in asyncio.run(go()) if v is not None], "k bigint, v string")


@query(f"WITH {LOG}, {_v()} SELECT k, v FROM v")
def kv_store_ingest(spark, d):
    """A stream of order files, each micro-batch one atomic batch; a batch that is run again changes nothing."""
    path = _path(spark)
    src = f"{path}-in"
    rows = _entries(spark, d).cache()
    top = rows.agg(F.max("ord")).first()[0] or 0
    s = _open(spark, path)
    for i in range(2):
        rows.where((F.col("ord") > top * i // 2) & (F.col("ord") <= top * (i + 1) // 2)).coalesce(1).write.mode("append").parquet(src)
        ingest(spark.readStream.schema(rows.schema).parquet(src), s, "ord", f"{path}-checkpoint").awaitTermination()
    before = s.last_sequence
    ingest(spark.readStream.schema(rows.schema).parquet(src), s, "ord", f"{path}-again").awaitTermination()
    if s.last_sequence != before:
        raise AssertionError("a batch was written twice")
    rows.unpersist()
    return plain(s.scan()).select("k", "v")
