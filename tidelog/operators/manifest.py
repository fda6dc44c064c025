"""Version edits as rows: folding them into the live file list, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE_NAME = r"^(?:(CURRENT|LOCK|LOG|LOG\.old)|MANIFEST-([0-9]+)|([0-9]+)\.(log|sst|ldb|dbtmp))$"


def live_files(ops: DataFrame) -> DataFrame:
    """ops: (edit_no, op 'add' or 'delete', level, file_id, ...). A file is live iff its last operation adds it; within one edit an addition comes last."""
    order = F.struct("edit_no", (F.col("op") == "add").alias("a"))
    rest = [c for c in ops.columns if c not in ("level", "file_id")]
    last = ops.groupBy("level", "file_id").agg(F.max_by(F.struct(*rest), order).alias("e"))
    return last.where(F.col("e.op") == "add").select("level", "file_id", *[F.col(f"e.{c}").alias(c) for c in rest if c not in ("op", "edit_no")])


def fold_scalars(edits: DataFrame, *names: str) -> DataFrame:
    """The last value that an edit gives for each name."""
    return edits.agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("edit_no"))).alias(n) for n in names])


def parse_file_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Adds file_type and file_id (0 for names without a number); null for names that are no file of a store."""
    part = lambda i: F.nullif(F.regexp_extract(column, FILE_NAME, i), F.lit(""))
    kind = (
        F.when(part(1) == "CURRENT", "current").when(part(1) == "LOCK", "lock").when(part(1).isin("LOG", "LOG.old"), "info_log")
        .when(part(2).isNotNull(), "manifest").when(part(4) == "log", "log").when(part(4).isin("sst", "ldb"), "table").when(part(4) == "dbtmp", "temp")
    )
    number = F.when(kind.isNotNull(), F.coalesce(part(2).cast("bigint"), part(3).cast("bigint"), F.lit(0).cast("bigint")))
    return names.withColumn("file_type", kind).withColumn("file_id", number)


def file_name(kind: str, number: int = 0) -> str:
    return {"log": f"{number:06d}.log", "table": f"{number:06d}.ldb", "temp": f"{number:06d}.dbtmp", "manifest": f"MANIFEST-{number:06d}", "current": "CURRENT", "lock": "LOCK", "info_log": "LOG"}[kind]


def obsolete(listing: DataFrame, live: DataFrame, log_id: int, manifest_id: int) -> DataFrame:
    """listing: (file_type, file_id). Older logs and manifests, and tables and temporary files that are not live."""
    old = ((F.col("file_type") == "log") & (F.col("file_id") < log_id)) | ((F.col("file_type") == "manifest") & (F.col("file_id") < manifest_id))
    loose = listing.where(F.col("file_type").isin("table", "temp")).join(live.select("file_id").distinct(), "file_id", "left_anti")
    return listing.where(old).unionByName(loose.select(*listing.columns))
