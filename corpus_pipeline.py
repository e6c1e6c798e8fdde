"""The corpus pipeline: language, near copies, benchmark passages, personal data, mix.

Each stage takes all that its predecessor kept, and all but the last return the
columns of ``documents``.  Stages are written as Parquet in the shared folder
of the session and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlab.llm import decontaminate, jaccard_join, langid, mixing, pii
from shiftlab.llm.store import written


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language compression can't tell; ``lang`` becomes the one found."""
    known = langid.identify(docs, langid.learn(docs), prefix="_lid_")
    return known.where("NOT _lid_rejected").withColumn("lang", F.col("_lid_lang_pred")).select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one of the least id, rows without id last.

    Ids may repeat or be null: a row is told by id and text.  Documents without
    words are in no group and stay.
    """
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    row = "_near_row"
    while row in docs.columns:
        row += "_"
    first = jaccard_join.first_rows(docs.select("doc_id", "text")).withColumnRenamed("rh", row)
    one = (docs.where(worded).withColumn(row, F.xxhash64("doc_id", "text"))
           .join(first, row, "left_semi").dropDuplicates([row]))
    return one.select(*_columns(docs)).unionByName(docs.where(~worded))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the documents that hold a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies and words."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("mix", mix),
]
#: Compression can't be expressed in SQL; tests hold run() against brute-force near copies and passages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
