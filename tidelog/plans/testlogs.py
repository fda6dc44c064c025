"""Change logs and file lists made of plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import encode_long
from tidelog.operators.compaction import file_meta


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key user_id, one entry per event; an error event deletes."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    return df.select(encode_long(F.col("user_id")).alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(gone, 0).otherwise(1).cast("tinyint").alias("kind"), F.when(~gone, F.col("props").cast("binary")).alias("value"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key o_custkey, one entry per order; status F deletes."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    gone = F.col("o_orderstatus") == "F"
    return df.select(encode_long(F.col("o_custkey")).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.when(gone, 0).otherwise(1).cast("tinyint").alias("kind"), F.when(~gone, F.col("o_orderpriority").cast("binary")).alias("value"))


def orders_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders log as files: level 0 by sequence slices of the newest part, levels 1 and 2 by key ranges of older parts."""
    log = orders_log(spark, sf_dir)
    cust = F.conv(F.substring(F.hex("key"), 3, 14), 16, 10).cast("bigint")
    level = F.when(F.col("seq") > 13000, 0).when(F.col("seq") > 7000, 1).otherwise(2)
    file_id = F.when(level == 0, 100 + F.floor(F.col("seq") / 500)).when(level == 1, 1000 + F.floor(cust / 200)).otherwise(5000 + F.floor(cust / 100))
    return log.withColumn("level", level).withColumn("file_id", file_id.cast("bigint"))


def orders_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_meta(orders_files(spark, sf_dir))


EVENTS_SQL = "log AS (SELECT user_id AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, CASE WHEN event_type <> 'error' THEN props END AS v FROM events)"
ORDERS_SQL = "log AS (SELECT o_custkey AS k, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS kind, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS v FROM orders)"
FILES_SQL = (
    ORDERS_SQL
    + ", fl AS (SELECT *, CASE WHEN seq > 13000 THEN 0 WHEN seq > 7000 THEN 1 ELSE 2 END AS level, CASE WHEN seq > 13000 THEN 100 + seq // 500 WHEN seq > 7000 THEN 1000 + k // 200 ELSE 5000 + k // 100 END AS file_id FROM log)"
    + ", meta AS (SELECT level, file_id, CAST(sum(8 + 8 + coalesce(strlen(v), 0)) AS BIGINT) AS size, min(k) AS smallest, max(k) AS largest, count(*) AS entries FROM fl GROUP BY level, file_id)"
)
