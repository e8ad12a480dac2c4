"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept, and returns documents; the last one adds copy and shuffle_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm.common import documents, stored
from lexispark.llm.decontaminate import drop_leaks
from lexispark.llm.lines import drop_lines
from lexispark.llm.mixing import mix
from lexispark.llm.quality import quality_filter
from lexispark.llm.simhash import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing is left."""
    return drop_lines(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to equal weights and shuffled."""
    return mix(docs).select(*COLUMNS, "copy", "shuffle_key")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can express neither the components of near duplicates nor edit distances within bounds.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
