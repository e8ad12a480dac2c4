"""Stored snapshots with a tree of digests: comparing two reads only what differs.

A snapshot's rows (doc_id, content_hash, title) are dealt to leaves by a hash of the
id, one folder each.  A leaf's digest is the number of its rows and two sums over
their hashes; a node's digest is made of those of its ``FANOUT`` children.  Two
snapshots are compared from the root down, a level at a time and only below nodes
that differ, and rows are read of the leaves that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Files
from . import diff

FANOUT = 16
DIGEST = ("n", "low", "high")


class Snapshot:
    """A snapshot under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, rows: DataFrame, path: str, leaves: int = 4096) -> Snapshot:
        """Store ``rows``; ids are unique.  ``leaves`` is the same for snapshots that are compared."""
        own = cls(rows.sparkSession, path)
        dealt = rows.select("doc_id", "content_hash", "title").withColumn("leaf", F.pmod(F.xxhash64("doc_id"), F.lit(leaves)).cast("int"))
        dealt.repartition("leaf").sortWithinPartitions("leaf", "doc_id").write.partitionBy("leaf").parquet(f"{own.path}/rows")
        Files(own.spark, own.path).write("schema", f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content_hash string, title string, leaf int")
        h = F.xxhash64("doc_id", "content_hash")
        halves = (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))
        level = own._dealt().groupBy(F.col("leaf").cast("long").alias("node")).agg(F.count("*").alias("n"), *[F.sum(x).alias(c) for x, c in zip(halves, DIGEST[1:], strict=True)])
        depth, width = 0, leaves
        level.write.parquet(f"{own.path}/digests/level=0")
        while width > 1:
            below = own.level(depth)
            depth, width = depth + 1, -(-width // FANOUT)
            child = F.xxhash64("node", *DIGEST)  # where in the node counts, too
            up = below.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sum("n").alias("n"), F.sum(child.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(child, 32)).alias("high"))
            up.coalesce(1).write.parquet(f"{own.path}/digests/level={depth}")
        return own

    def _dealt(self) -> DataFrame:
        return self.spark.read.schema(Files(self.spark, self.path).read("schema")).parquet(f"{self.path}/rows")

    def level(self, depth: int) -> DataFrame:
        return self.spark.read.schema("node bigint, n bigint, low bigint, high bigint").parquet(f"{self.path}/digests/level={depth}")

    def rows(self, leaves: list[int] | None = None) -> DataFrame:
        """All rows, or those of some leaves; no other folder is opened."""
        found = self._dealt()
        return (found if leaves is None else found.filter(F.col("leaf").isin(leaves or [-1]))).drop("leaf")

    def depth(self) -> int:
        return sum(n.startswith("level=") for n in Files(self.spark, self.path).names("digests")) - 1


def differing_leaves(a: Snapshot, b: Snapshot) -> list[int]:
    """Leaves whose digests differ, by comparing from the root down; at most the number of leaves."""
    if a.depth() != b.depth():
        raise ValueError("snapshots with different numbers of leaves")
    open_: list[int] | None = None
    for depth in range(a.depth(), -1, -1):
        x, y = (s.level(depth) for s in (a, b))
        if open_ is not None:
            below = [n * FANOUT + i for n in open_ for i in range(FANOUT)]
            x, y = x.filter(F.col("node").isin(below)), y.filter(F.col("node").isin(below))
        named = y.select(F.col("node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in DIGEST])
        same = F.lit(True)
        for c in DIGEST:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        open_ = sorted(r[0] for r in x.join(named, F.col("node") == F.col("_node"), "full_outer").filter(~same).select(F.coalesce("node", "_node")).collect())
        if not open_:
            return []
    return open_


def changed(a: Snapshot, b: Snapshot) -> DataFrame:
    """``diff.changes`` without what stayed the same."""
    leaves = differing_leaves(a, b)
    return diff.changes(a.rows(leaves), b.rows(leaves)).filter("status <> 'same'")
