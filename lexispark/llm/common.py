"""Helpers shared by the training-data operators.

Every operator selects the columns it needs by name, or carries whole rows in one
struct (``wrapped``), so extra columns of the input, even ones named like working
columns, never meet these.  Two rows are the same document
when ``doc_id`` and ``text`` agree (``keyed``); rows of one ``doc_id`` with
different texts are different documents, in the order of their text hashes.  A
null ``doc_id`` sorts before all others.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word contracts: blank, tab, line feed, VT, FF, CR.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Stands for a null doc_id inside an operator.
NULL_ID = -(2**63)

_LOCAL: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (tests) a temporary
    folder is made, and removed when the process ends; a cluster needs the setting,
    as a machine's own folder would lose what other machines wrote.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lexispark-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and reread it.

    A lost executor then costs a reread of files instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, *keys: str) -> tuple[DataFrame, str]:
    """As ``stored``, in one bucket of ``keys`` for each shuffle partition: joins on exactly these keys then shuffle the other side only.

    Also returns the name of the table, for ``drop_stored``.
    """
    spark = df.sparkSession
    name = f"{label}-{uuid.uuid4().hex}"
    table = name.replace("-", "_")
    df.write.bucketBy(partitions(spark), *keys).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(table, format="parquet")
    return spark.table(table), table


def drop_stored(df: DataFrame, table: str | None = None) -> None:
    """Delete the files behind a table that ``stored`` or ``stored_by`` made and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def wrapped(docs: DataFrame, **working: Column) -> DataFrame:
    """Each whole row in the struct ``_row``, with working columns beside it that no column of the row can clash with."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(name) for name, c in working.items()])


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """_k and _sig, which tell documents apart, and the named columns."""
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_k"), F.xxhash64("text").alias("_sig"), *columns)


def bind(value: Column, body) -> Column:
    """``let x = value in body(x)``: ``value`` is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
