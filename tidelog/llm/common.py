"""Helpers that the training-data operators share: scratch space, splits, words, salted joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.scratch import discard, materialize, scratch_dir  # noqa: F401

#: UTF-8 byte table: A-Z become a-z, every other ASCII byte outside [0-9a-z] becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: UTF-8 byte table: A-Z become a-z, nothing else changes.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Rows in a batch handed to Python, unless the session names another number: texts can be long.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str) -> Column:
    """Unsigned crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def bounded_sample(rows: DataFrame, key: str, per: int, by: str = "text") -> DataFrame:
    """At most ``per`` rows of each value of ``key`` (few values): those of the smallest hash of ``by``, whole rows.

    The number of distinct ``by`` (to 2 %) gives each value's hash threshold, so that little more than the sample is ever
    shuffled. Rows equal in ``by`` and key count once.
    """
    small_batches(rows.sparkSession)
    h_, r_ = fresh(rows.columns, "h"), fresh(rows.columns, "r")
    h = F.xxhash64(by)
    counts = {r[0]: max(1, r[1]) for r in rows.groupBy(key).agg(F.approx_count_distinct(h, 0.02)).collect() if r[0] is not None}
    within = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, 1.5 * per / n)
        top = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
        within = F.when(F.col(key) == F.lit(value), h <= F.lit(min(top, 2**63 - 1))).otherwise(within)
    few = rows.where(within).withColumn(h_, h).dropDuplicates([h_, key])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(h_))
    return few.withColumn(r_, rank).where(F.col(r_) <= per).drop(h_, r_)


def fresh(columns: list[str], name: str) -> str:
    """``name`` after as many underscores as it takes to be no column's name, whatever its case."""
    taken, name = {c.lower() for c in columns}, f"__{name}"
    while name.lower() in taken:
        name = "_" + name
    return name


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str, salts: int = 16) -> DataFrame:
    """Equi-join where one key may hold a large share of ``big``.

    Rows of ``big`` are dealt over ``salts`` values and ``small`` is repeated once per value, so that a hot
    key meets its partner in ``salts`` tasks. ``small`` has few rows for each key. Keys match null-safely.
    """
    names = [*big.columns, *small.columns]
    salt, other = fresh(names, "salt"), {c: fresh(names, f"right_{i}") for i, c in enumerate(on)}
    right = fresh(names, "right_salt")
    b = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int"))
    s = small.withColumnsRenamed(other).withColumn(right, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = F.col(salt) == F.col(right)
    for c in on:
        cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(other[c]))
    return b.join(s, cond, how).drop(salt, right, *other.values())


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters."""
    return raw.translate(WORD_BYTES).split() if raw else []


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
