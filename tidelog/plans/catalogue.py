"""Named queries over the driver's tables and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.functions.bloom import bloom_by, count_holding
from tidelog.model import decode_long
from tidelog.operators import batch, compaction, manifest, scan, snapshots, view
from tidelog.plans.testlogs import EVENTS_SQL, FILES_SQL, ORDERS_SQL, events_log, orders_files, orders_log, orders_meta

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
V = "v{n} AS (SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM {log} WHERE seq <= {s}) WHERE rn = 1 AND kind = 1)"
TOP = 1 << 55


def _v(s: int = TOP, n: str = "", log: str = "log") -> str:
    return V.format(n=n, s=s, log=log)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def key(n: int):
    """The encoded form of a long, as a literal."""
    return bytearray(((n + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big"))


def plain(df: DataFrame) -> DataFrame:
    """Keys as bigint k, values as text v."""
    out = df
    for old, new in (("key", "k"), ("smallest_key", "smallest"), ("largest_key", "largest")):
        if old in df.columns:
            out = out.withColumn(new, decode_long(F.col(old))).drop(old)
    if "value" in df.columns:
        out = out.withColumn("v", F.col("value").cast("string")).drop("value")
    return out


def ev(spark, d):
    return events_log(spark, d)


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v")
def kv_view_latest(spark: SparkSession, d: str) -> DataFrame:
    return plain(view.view(ev(spark, d)))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v")
def kv_view_latest_max(spark, d):
    return plain(view.view_by_max(ev(spark, d)))


@query(f"WITH {EVENTS_SQL}, {_v(5000)} SELECT k, seq, v FROM v")
def kv_view_as_of(spark, d):
    return plain(view.view(ev(spark, d), 5000))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v WHERE k = 37")
def kv_get(spark, d):
    return plain(view.get(ev(spark, d), key(37)))


@query(f"WITH {EVENTS_SQL}, {_v(5000)} SELECT k, seq, v FROM v WHERE k = 37")
def kv_get_at(spark, d):
    return plain(view.get(ev(spark, d), key(37), 5000))


@query(f"WITH {EVENTS_SQL}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1) SELECT c_custkey AS k, CASE WHEN kind IS NULL THEN 'ABSENT' WHEN kind = 1 THEN 'FOUND' ELSE 'DELETED' END AS state, v FROM customer LEFT JOIN n ON k = c_custkey")
def kv_get_tristate(spark, d):
    keys = spark.read.parquet(f"{d}/customer.parquet").select(_enc("c_custkey").alias("key"))
    return plain(view.get_tristate(ev(spark, d), keys))


def _enc(c):
    from tidelog.model import encode_long

    return encode_long(F.col(c))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT c_custkey AS k, seq, v FROM customer LEFT JOIN v ON k = c_custkey")
def kv_multi_get(spark, d):
    keys = spark.read.parquet(f"{d}/customer.parquet").select(_enc("c_custkey").alias("key"))
    return plain(view.multi_get(ev(spark, d), keys))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k FROM v")
def kv_keys_only(spark, d):
    return plain(view.view(ev(spark, d)).select("key"))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v WHERE k BETWEEN 20 AND 60")
def kv_range_scan(spark, d):
    return plain(scan.scan(ev(spark, d), lo=key(20), hi=key(60)))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v WHERE k >= 20 ORDER BY k LIMIT 10")
def kv_scan_limit(spark, d):
    return plain(scan.scan(ev(spark, d), lo=key(20), limit=10))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v WHERE k >= 37 ORDER BY k LIMIT 1")
def kv_seek(spark, d):
    return plain(scan.seek(ev(spark, d), key(37)))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v WHERE k < 37 ORDER BY k DESC LIMIT 1")
def kv_prev(spark, d):
    return plain(scan.prev(ev(spark, d), key(37)))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v WHERE k > 37 ORDER BY k LIMIT 1")
def kv_advance(spark, d):
    return plain(scan.after(ev(spark, d), key(37)))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v ORDER BY k LIMIT 1")
def kv_first(spark, d):
    return plain(scan.first(ev(spark, d)))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v ORDER BY k DESC LIMIT 1")
def kv_last(spark, d):
    return plain(scan.last(ev(spark, d)))


@query(f"WITH {EVENTS_SQL}, {_v()} SELECT k, seq, v FROM v ORDER BY k DESC")
def kv_reverse_scan(spark, d):
    return plain(scan.scan(ev(spark, d), reverse=True))


@query(f"WITH {EVENTS_SQL} SELECT k, seq, kind, v FROM log ORDER BY k, seq DESC")
def kv_merge_iter(spark, d):
    log = ev(spark, d)
    return plain(view.merge([log.where("seq % 3 = 0"), log.where("seq % 3 = 1"), log.where("seq % 3 = 2")])).withColumn("kind", F.col("kind").cast("int"))


@query(f"WITH {EVENTS_SQL} SELECT k, seq, kind, v FROM log WHERE k = 12")
def kv_history(spark, d):
    return plain(view.history(ev(spark, d), key(12))).withColumn("kind", F.col("kind").cast("int"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#00000001' AND c_name < 'Customer#00000002'")
def kv_prefix_scan(spark, d):
    return view.with_prefix(spark.read.parquet(f"{d}/customer.parquet"), "Customer#00000001", "c_name").select("c_custkey", "c_name")


@query("SELECT conv_id, turn, 1000000 + row_number() OVER (ORDER BY conv_id * 1000 + turn) AS seq FROM conversations")
def kv_batch_seq(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return batch.assign_seq(rows, 1_000_000, "ord").select("conv_id", "turn", "seq")


@query(f"WITH {EVENTS_SQL}, b AS (SELECT o_custkey AS k, 1000000 + row_number() OVER (ORDER BY o_orderkey) AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS kind, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS v FROM orders), u AS (SELECT * FROM log UNION ALL SELECT * FROM b), {_v(log='u')} SELECT k, seq, v FROM v")
def kv_batch_apply(spark, d):
    add = orders_log(spark, d).withColumnRenamed("seq", "ord")
    rows = batch.assign_seq(add, 1_000_000, "ord").select("key", "seq", "kind", "value")
    return plain(view.view(ev(spark, d).unionByName(rows)))


_DIFF = f"WITH {EVENTS_SQL}, {_v(4000, 'a')}, {_v(8000, 'b')} SELECT coalesce(va.k, vb.k) AS k, va.v AS old_v, vb.v AS new_v, CASE WHEN va.k IS NULL THEN 'INSERT' WHEN vb.k IS NULL THEN 'DELETE' WHEN va.v IS NOT DISTINCT FROM vb.v THEN 'SAME' ELSE 'UPDATE' END AS change FROM va FULL JOIN vb ON va.k = vb.k"


def _diff(df):
    return plain(df).select("k", F.col("old_value").cast("string").alias("old_v"), F.col("new_value").cast("string").alias("new_v"), "change")


@query(_DIFF)
def kv_snapshot_diff(spark, d):
    return _diff(snapshots.diff(ev(spark, d), 4000, 8000))


@query(_DIFF)
def kv_snapshot_diff_join(spark, d):
    return _diff(snapshots.diff_by_join(ev(spark, d), 4000, 8000))


@query("SELECT min(event_id + 1) AS oldest, max(event_id + 1) AS newest, count(*) AS n FROM events WHERE event_type = 'signup'")
def kv_oldest_newest_snapshot(spark, d):
    pins = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'signup'")
    return pins.agg(F.min(F.col("event_id") + 1).alias("oldest"), F.max(F.col("event_id") + 1).alias("newest"), F.count("*").alias("n"))


_MARK = ", m AS (SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer FROM log)"
_KEEP = "NOT coalesce(newer <= 8000, false) AND NOT (kind = 0 AND seq <= 8000)"


@query(f"WITH {EVENTS_SQL}{_MARK} SELECT k, seq, kind, v FROM m WHERE {_KEEP}")
def kv_compact_full(spark, d):
    return plain(compaction.compact(ev(spark, d), 8000)).withColumn("kind", F.col("kind").cast("int"))


_DEEP = ", deep AS (SELECT k // 10 AS f, min(k) AS lo, max(k) AS hi FROM log WHERE seq <= 2000 AND k % 20 < 10 GROUP BY 1), up AS (SELECT * FROM log WHERE seq > 2000), m AS (SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer, EXISTS (SELECT 1 FROM deep WHERE k BETWEEN lo AND hi) AS covered FROM up)"


@query(f"WITH {EVENTS_SQL}{_DEEP} SELECT k, seq, kind, v FROM m WHERE NOT coalesce(newer <= 8000, false) AND NOT (kind = 0 AND seq <= 8000 AND NOT covered)")
def kv_compact_base_level(spark, d):
    log = ev(spark, d)
    k = decode_long(F.col("key"))
    deep = log.where((F.col("seq") <= 2000) & (k % 20 < 10)).groupBy(F.floor(k / 10).alias("f")).agg(F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"))
    return plain(compaction.compact(log.where("seq > 2000"), 8000, deep)).withColumn("kind", F.col("kind").cast("int"))


@query(f"WITH {EVENTS_SQL}{_MARK}, c AS (SELECT k, seq, kind, v FROM m WHERE {_KEEP}), {_v(8000, 'a')}, {_v(8000, 'b', 'c')}, {_v(TOP, 'x')}, {_v(TOP, 'y', 'c')} SELECT (SELECT count(*) FROM ((SELECT * FROM va EXCEPT SELECT * FROM vb) UNION ALL (SELECT * FROM vb EXCEPT SELECT * FROM va))) + (SELECT count(*) FROM ((SELECT * FROM vx EXCEPT SELECT * FROM vy) UNION ALL (SELECT * FROM vy EXCEPT SELECT * FROM vx))) AS n_changed")
def kv_compact_preserves(spark, d):
    log = ev(spark, d)
    small = compaction.compact(log, 8000)
    rows = None
    for s in (8000, TOP):
        a, b = view.view(log, s), view.view(small, s)
        part = a.exceptAll(b).unionByName(b.exceptAll(a))
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(F.count("*").alias("n_changed"))


@query(f"WITH {EVENTS_SQL}{_MARK} SELECT CASE WHEN newer <= 8000 THEN 'shadowed' WHEN kind = 0 AND seq <= 8000 THEN 'tombstone' ELSE 'kept' END AS reason, count(*) AS n FROM m GROUP BY 1")
def kv_gc_stats(spark, d):
    return compaction.gc_stats(ev(spark, d), 8000)


@query(f"WITH {FILES_SQL} SELECT level, file_id, size, smallest, largest, entries, greatest(size // 16384, 100) AS allowed_seeks FROM meta")
def kv_file_meta(spark, d):
    return plain(orders_meta(spark, d)).select("level", "file_id", "size", "smallest", "largest", "entries", "allowed_seeks")


@query(f"WITH {FILES_SQL} SELECT level, file_id, smallest, largest FROM meta WHERE NOT (largest < 300) AND NOT (smallest > 450)")
def kv_overlapping_files(spark, d):
    return plain(compaction.overlapping(orders_meta(spark, d), key(300), key(450))).select("level", "file_id", "smallest", "largest")


@query(f"WITH {FILES_SQL} SELECT level, file_id FROM meta WHERE 300 BETWEEN smallest AND largest")
def kv_files_for_key(spark, d):
    return compaction.files_for_key(orders_meta(spark, d), key(300)).select("level", "file_id")


@query(f"WITH {FILES_SQL} SELECT file_id FROM meta WHERE level = 2 AND largest >= 300 ORDER BY largest LIMIT 1")
def kv_find_file(spark, d):
    return compaction.find_file(orders_meta(spark, d).where("level = 2"), key(300)).select("file_id")


@query(f"WITH {FILES_SQL} SELECT level, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM meta GROUP BY level")
def kv_level_stats(spark, d):
    return compaction.level_stats(orders_meta(spark, d))


@query(f"WITH {FILES_SQL} SELECT level, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN level = 0 THEN count(*) / CAST(4 AS DOUBLE) ELSE CAST(sum(size) AS DOUBLE) / (pow(CAST(10 AS DOUBLE), level) * 1048576) END AS score FROM meta GROUP BY level")
def kv_level_score(spark, d):
    return compaction.level_score(orders_meta(spark, d))


@query(f"WITH {FILES_SQL} SELECT min(smallest) AS smallest, max(largest) AS largest FROM meta")
def kv_key_range(spark, d):
    return plain(compaction.key_range(orders_meta(spark, d)))


@query(f"WITH {FILES_SQL} SELECT level, file_id, CAST(coalesce(sum(size) OVER (PARTITION BY level ORDER BY smallest, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM meta")
def kv_approx_offset(spark, d):
    return compaction.approx_offset(orders_meta(spark, d)).select("level", "file_id", "offset")


@query(f"WITH {FILES_SQL} SELECT k, count(DISTINCT file_id) AS n_files FROM fl GROUP BY k HAVING count(DISTINCT file_id) > 1")
def kv_multi_file_keys(spark, d):
    return plain(orders_files(spark, d).groupBy("key").agg(F.countDistinct("file_id").alias("n_files")).where("n_files > 1"))


@query(f"WITH {ORDERS_SQL}, s AS (SELECT *, CASE WHEN seq > 13000 THEN 0 WHEN seq > 11000 THEN 1 WHEN seq > 7000 THEN 2 ELSE 3 END AS src FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, seq DESC) AS rn FROM s) SELECT src, kind, count(*) AS n FROM r WHERE rn = 1 GROUP BY src, kind")
def kv_layered_get(spark, d):
    log = orders_log(spark, d)
    cut = [log.where("seq > 13000"), log.where("seq > 11000 AND seq <= 13000"), log.where("seq > 7000 AND seq <= 11000"), log.where("seq <= 7000")]
    return view.layered_get(cut).groupBy("src", F.col("kind").cast("int").alias("kind")).agg(F.count("*").alias("n"))


def _ops(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select(F.col("event_id").alias("edit_no"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"), (F.col("user_id") % 7).cast("int").alias("level"), F.col("user_id").alias("file_id"), F.octet_length("props").cast("bigint").alias("size"))


_OPS = "ops AS (SELECT event_id AS edit_no, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op, CAST(user_id % 7 AS INTEGER) AS level, user_id AS file_id, CAST(strlen(props) AS BIGINT) AS size FROM events), live AS (SELECT level, file_id, size FROM (SELECT *, row_number() OVER (PARTITION BY level, file_id ORDER BY edit_no DESC) AS rn FROM ops) WHERE rn = 1 AND op = 'add')"


@query(f"WITH {_OPS} SELECT level, file_id, size FROM live")
def kv_manifest_fold(spark, d):
    return manifest.live_files(_ops(spark, d))


@query("SELECT arg_max(user_id, event_id) FILTER (WHERE event_type = 'signup') AS log_id, arg_max(user_id, event_id) FILTER (WHERE event_type = 'click') AS next_id FROM events")
def kv_manifest_scalars(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    edits = rows.select(F.col("event_id").alias("edit_no"), F.when(F.col("event_type") == "signup", F.col("user_id")).alias("log_id"), F.when(F.col("event_type") == "click", F.col("user_id")).alias("next_id"))
    return manifest.fold_scalars(edits, "log_id", "next_id")


_NAMES = "CASE WHEN o_orderkey % 7 = 0 THEN 'MANIFEST-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') WHEN o_orderkey % 7 = 1 THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '.ldb' WHEN o_orderkey % 7 = 2 THEN lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.log' WHEN o_orderkey % 7 = 3 THEN 'LOG.old' WHEN o_orderkey % 7 = 4 THEN 'CURRENT' WHEN o_orderkey % 7 = 5 THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '.dbtmp' ELSE o_orderpriority END"
_PARSED = "names AS (SELECT o_orderkey, " + _NAMES + r" AS name FROM orders), parsed AS (SELECT o_orderkey, name, CASE WHEN name = 'CURRENT' THEN 'current' WHEN name = 'LOCK' THEN 'lock' WHEN name IN ('LOG', 'LOG.old') THEN 'info_log' WHEN regexp_matches(name, '^MANIFEST-[0-9]+$') THEN 'manifest' WHEN regexp_matches(name, '^[0-9]+\.log$') THEN 'log' WHEN regexp_matches(name, '^[0-9]+\.(sst|ldb)$') THEN 'table' WHEN regexp_matches(name, '^[0-9]+\.dbtmp$') THEN 'temp' END AS file_type, TRY_CAST(nullif(regexp_extract(name, '[0-9]+'), '') AS BIGINT) AS num FROM names), ids AS (SELECT o_orderkey, name, file_type, CASE WHEN file_type IS NULL THEN NULL ELSE coalesce(num, 0) END AS file_id FROM parsed)"


def _names(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(_NAMES.replace("VARCHAR", "STRING")).alias("name"))


@query(f"WITH {_PARSED} SELECT o_orderkey, name, file_type, file_id FROM ids")
def kv_parse_file_name(spark, d):
    return manifest.parse_file_names(_names(spark, d))


@query(f"WITH {_PARSED}, {_OPS} SELECT file_type, file_id, count(*) AS n FROM ids WHERE (file_type = 'log' AND file_id < 4000) OR (file_type = 'manifest' AND file_id < 3000) OR (file_type IN ('table', 'temp') AND file_id NOT IN (SELECT file_id FROM live)) GROUP BY 1, 2")
def kv_obsolete_files(spark, d):
    listing = manifest.parse_file_names(_names(spark, d)).select("file_type", "file_id")
    return manifest.obsolete(listing, manifest.live_files(_ops(spark, d)), 4000, 3000).groupBy("file_type", "file_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, upper(hex(CAST(user_id AS VARCHAR))) || lpad(upper(to_hex((event_id + 1) * 256 + 1)), 16, '0') AS ikey FROM events")
def kv_ikey_hex(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", codec.internal_key_hex(F.col("user_id").cast("string").cast("binary"), F.col("event_id") + 1, F.lit(1)).alias("ikey"))


@query("SELECT event_id, ((((event_id * 7919) % 4294967296) >> 15 | ((((event_id * 7919) % 4294967296) << 17) & 4294967295)) + 2726488792) & 4294967295 AS masked FROM events")
def kv_crc_mask(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", codec.mask_crc(F.col("event_id") * 7919 % 4294967296).alias("masked"))


@query("SELECT doc_id, CAST(ceil(strlen(text) / CAST(32761 AS DOUBLE)) AS BIGINT) AS frames FROM documents")
def kv_wal_frames(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", codec.frame_count(F.octet_length("text")).alias("frames"))


@query("SELECT doc_id, strlen(text) AS n_bytes, md5(text) AS digest FROM documents WHERE strlen(text) > 0")
def kv_wal_round_trip(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("body"))
    back = codec.from_frames(codec.to_frames(docs, "doc_id", "body"), "doc_id")
    return back.select("doc_id", F.octet_length("data").cast("bigint").alias("n_bytes"), F.md5("data").alias("digest"))


@query("WITH c AS (SELECT c_nationkey, c_name AS key, lag(c_name) OVER w AS p, row_number() OVER w - 1 AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_name)), s AS (SELECT c_nationkey, key, CASE WHEN n % 16 = 0 OR p IS NULL THEN 0 ELSE (SELECT coalesce(max(i), 0) FROM (SELECT unnest(range(1, least(strlen(key), strlen(p)) + 1)) AS i) WHERE key[1:i] = p[1:i]) END AS shared FROM c) SELECT c_nationkey, key, CAST(shared AS INTEGER) AS shared, CAST(strlen(key) - shared AS INTEGER) AS unshared FROM s")
def kv_shared_prefix(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", F.col("c_name").cast("binary").alias("key"))
    return codec.prefix_delta(rows, 16, ["c_nationkey"]).withColumn("key", F.col("key").cast("string"))


@query("SELECT c_nationkey, c_name AS key FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1 AS n FROM customer) WHERE n % 16 = 0")
def kv_restarts(spark, d):
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", F.col("c_name").alias("key"))
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("key")) - 1
    return rows.withColumn("n", n).where("n % 16 = 0").drop("n")


@query("SELECT doc_id, greatest(floor(strlen(text) * 1000 / 16384), 100)::BIGINT AS budget FROM documents")
def kv_seek_budget(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", compaction.seek_budget(F.octet_length("text").cast("bigint") * 1000).alias("budget"))


@query("SELECT doc_id, CAST(greatest(1, ceil(len(ltrim(bin(n_chars), '0')) / CAST(7 AS DOUBLE))) AS INTEGER) AS n FROM documents")
def kv_varint_length(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", codec.varint_length(F.col("n_chars")).alias("n"))


@query("SELECT CAST(sum(octet_length(encode(CAST(event_id AS VARCHAR))) + 8 + strlen(props)) AS BIGINT) AS bytes, count(*) AS n FROM events")
def kv_memtable_size(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.agg(F.sum(F.octet_length(F.col("event_id").cast("string")) + 8 + F.octet_length("props")).alias("bytes"), F.count("*").alias("n"))


@query()
def kv_separator(spark, d):
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", F.col("c_name").cast("binary").alias("a"))
    pairs = rows.withColumn("b", F.lead("a").over(Window.partitionBy("c_nationkey").orderBy("a"))).where("b IS NOT NULL")
    return pairs.select(F.col("a").cast("string").alias("a"), F.hex(codec.separator("a", "b")).alias("separator"))


@query()
def kv_successor(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.hex(codec.successor(F.col("c_name").cast("binary"))).alias("successor"))


@query()
def kv_bloom_probe(spark, d):
    files = orders_files(spark, d)
    filters = bloom_by(files.select(F.col("file_id"), "key"), "file_id")
    keys = spark.read.parquet(f"{d}/customer.parquet").select(_enc("c_custkey").alias("key"))
    spans = orders_meta(spark, d).select("file_id", "smallest_key", "largest_key").join(filters, "file_id")
    return plain(count_holding(keys, spans))


@query()
def kv_crc32_cksum(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", codec.cksum(F.col("c_name").cast("binary")).alias("crc"))
