"""From documents to packed training sequences: language, near-duplicates, benchmark, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns the columns of
``docs`` (the last: placed token pieces). ``run`` writes each stage's rows as Parquet into the shared folder and
reads them for the next, so a lost executor never repeats an earlier stage.

Edge cases, for each stage: null and empty texts go in the language stage (no language); an empty table passes through as
an empty table; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import id_crc, materialize, table
from tidelog.llm.decontaminate import decontaminate
from tidelog.llm.language import identify, train
from tidelog.llm.neardup import keep_one
from tidelog.llm.packing import pack_documents
from tidelog.llm.pii import redact

#: A text is rejected only if it has no language, or if no learned one has this probability.
MIN_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language. The model learns from rows whose crc32(doc_id) mod 3 is not 1."""
    model = train(docs.where(id_crc("doc_id") % 3 != 1))
    plain = docs.toDF(*[c if c == "text" else f"__{i}" for i, c in enumerate(docs.columns)])  # no name can clash with the result's
    kept = identify(plain, model, plain.columns).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.select(*plain.columns).toDF(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each near-duplicate class."""
    return keep_one(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    return redact(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every token piece."""
    return pack_documents(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]
#: The language and near-duplicate stages learn and sample, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
