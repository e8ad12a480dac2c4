"""Tables that a job writes for itself, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and one process does all work, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lexispark-scratch-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def written(df: DataFrame, label: str, *partition: str) -> DataFrame:
    """``df`` as files: its lineage is cut, and what reads it twice sees the same rows."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # without a row no file tells it
