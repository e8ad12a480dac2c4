"""The engine's tables in one folder, and the JSON form of run histories."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import HISTORY_LIMIT
from ..operators import diff
from ..operators.merge import Table
from ..operators.postings import SearchIndex
from ..schema import SCHEMA_VERSION, TABLES

#: Tables with a full-text index, and its columns.
INDEXED = {"document": ("title", "full_text"), "clause": ("clause_number", "title", "full_text")}
HISTORY = "doc_type string, history array<struct<ran_at:timestamp,total:bigint,fetched:bigint,failed:bigint,new_docs:bigint,updated_docs:bigint,orphaned_docs:bigint,moved_docs:bigint,fail_rate:double,duration_ms:bigint>>"


def default_root() -> str:
    """$LEXISPARK_HOME, else the user's data folder."""
    return os.environ.get("LEXISPARK_HOME") or f"{os.environ.get('XDG_DATA_HOME') or os.path.expanduser('~/.local/share')}/lexispark"


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None):
        if root is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a root that all executors share")
        self.spark, self.root = spark, root or default_root()
        self.tables = {n: Table(spark, self.root, n, ddl, keys, SCHEMA_VERSION) for n, (ddl, keys) in TABLES.items()}

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    def index(self, name: str) -> SearchIndex:
        """The full-text index of a table; it catches up with the table whenever it is searched or refreshed."""
        return SearchIndex(self.spark, self.root, f"index/{name}", self[name], INDEXED[name])

    def sync(self) -> None:
        """Bring all indexes up to date, so that no search has to."""
        for name in INDEXED:
            self.index(name).refresh()

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def clear(self) -> None:
        for t in self.tables.values():
            t.clear()

    def append_run(self, run: DataFrame) -> None:
        """Add runs, keeping the latest of each doc_type."""
        t = self["run_history"]
        t.append(run)
        over = t.read().join(diff.last_runs(t.read(), HISTORY_LIMIT).select(*t.keys), t.keys, "left_anti")
        if not over.isEmpty():
            t.delete(over)


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """run_history rows of JSON files; broken files and wrong shapes have no runs."""
    rows = spark.read.schema(HISTORY).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    return rows.filter("doc_type IS NOT NULL AND history IS NOT NULL").select("doc_type", F.inline("history"))


def write_history_json(history: DataFrame, path: str) -> None:
    """One object per doc_type with its latest runs, oldest first."""
    kept = diff.last_runs(history)
    run = F.struct(*[c for c in kept.columns if c != "doc_type"])
    kept.groupBy("doc_type").agg(F.array_sort(F.collect_list(run)).alias("history")).write.mode("overwrite").json(path)
