"""Snapshots of a table, their difference, and run health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as q


def scoped(rows: DataFrame, column: str, values: list[str] | None) -> DataFrame:
    """Rows whose value is in the list; no list or an empty one is no filter."""
    return rows.filter(F.col(column).isin(*values)) if values else rows


def document_snapshot(documents: DataFrame, doc_type: str, taxonomies: list[str] | None = None) -> DataFrame:
    return scoped(documents.filter(F.col("doc_type") == doc_type), "taxonomy", taxonomies).select("doc_id", "content_hash", "title")


def clause_snapshot(clauses: DataFrame, circulars: DataFrame, formal_name: str) -> DataFrame:
    own = clauses.join(circulars.filter(F.col("formal_name") == formal_name).select(F.col("id").alias("circular_id")), "circular_id")
    return own.select(F.col("clause_number").alias("doc_id"), F.sha1(F.col("full_text").cast("binary")).alias("content_hash"), "title")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, status (new, orphaned, updated, same), title of each document of either snapshot.

    A hash that is null on one side is no update.
    """
    b = before.select("doc_id", F.col("content_hash").alias("_h0"), F.col("title").alias("_t0"), F.lit(True).alias("_b"))
    a = after.select("doc_id", F.col("content_hash").alias("_h1"), F.col("title").alias("_t1"), F.lit(True).alias("_a"))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "orphaned").when(F.col("_h0") != F.col("_h1"), "updated").otherwise("same")
    return b.join(a, "doc_id", "full_outer").select("doc_id", status.alias("status"), F.coalesce("_t1", "_t0").alias("title"))


def moved(diff: DataFrame) -> DataFrame:
    """Orphaned documents whose title came back under a new id, each once."""
    new = diff.filter(F.col("status") == "new").select("title").distinct()
    return diff.filter(F.col("status") == "orphaned").join(new, "title", "left_semi")


def summary(before: DataFrame, after: DataFrame, failed: int = 0, total: int | None = None) -> DataFrame:
    """One row: total, failed, new_docs, updated_docs, orphaned_docs, moved_docs, fail_rate."""
    diff = changes(before, after)
    counts = diff.agg(
        F.count_if(F.col("status") != "orphaned").alias("_n"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_docs") for s in ("new", "updated", "orphaned")],
    ).crossJoin(F.broadcast(moved(diff).agg(F.count("*").alias("moved_docs"))))  # one row each
    n = F.lit(total).cast("long") if total is not None else F.col("_n")
    return counts.select(n.alias("total"), F.lit(failed).cast("long").alias("failed"), "new_docs", "updated_docs", "orphaned_docs", "moved_docs", q.ratio(F.lit(failed), n).cast("double").alias("fail_rate"))


def missing_keys(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def outcomes(rows: DataFrame, group: str, ok: Column) -> DataFrame:
    """fetched and failed per group."""
    return rows.groupBy(group).agg(F.count_if(ok).alias("fetched"), F.count_if(~ok).alias("failed"))


def last_runs(history: DataFrame, keep: int = q.HISTORY_LIMIT) -> DataFrame:
    """The latest ``keep`` runs of each doc_type."""
    w = Window.partitionBy("doc_type").orderBy(F.col("ran_at").desc())
    return history.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def last_run(history: DataFrame) -> DataFrame:
    return history.groupBy("doc_type").agg(F.max_by(F.struct(*[c for c in history.columns if c != "doc_type"]), "ran_at").alias("run")).select("doc_type", "run.*")


def medians(history: DataFrame) -> DataFrame:
    """Exact medians of total and fail_rate over the kept runs of each doc_type."""
    return last_runs(history).groupBy("doc_type").agg(F.median("total").alias("median_total"), F.median("fail_rate").alias("median_fail_rate"))


def evaluate(runs: DataFrame, history: DataFrame) -> DataFrame:
    """Each run judged against the history before it is appended: warn, reasons and the ratios behind them."""
    table = runs.sparkSession.createDataFrame(list(q.MIN_FAILURES.items()), "doc_type string, min_failures int")
    j = runs.join(F.broadcast(table), "doc_type", "left").join(medians(history), "doc_type", "left")
    median = F.coalesce("median_total", F.lit(0.0))
    checks = (
        ("fail_rate", q.warn_fail_rate(F.col("failed"), F.col("total"), F.col("min_failures"))),
        ("count_drift", q.warn_drift(F.col("total"), median)),
        ("structural_change", q.warn_structure(F.col("updated_docs"), F.col("total"))),
    )
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    return j.select(
        *runs.columns, (F.size(reasons) > 0).alias("warn"), reasons.alias("reasons"), median.alias("median_total"),
        F.coalesce("median_fail_rate", F.lit(0.0)).alias("median_fail_rate"), q.ratio(F.col("updated_docs"), F.col("total")).alias("update_ratio"),
    )


def freshness(rows: DataFrame, at: str, now: str, by: list[str] | None = None, hint: str = "") -> DataFrame:
    """oldest, newest, n, days, staleness, warning of a timestamp column, for all rows or per group; no row for no rows."""
    found = rows.groupBy(*(by or [])).agg(F.min(at).alias("oldest"), F.max(at).alias("newest"), F.count(at).alias("n")).filter(F.col("n") > 0)
    found = found.withColumn("days", q.days_since(F.col("oldest"), F.lit(now)))
    return found.withColumns({"staleness": q.staleness(F.col("days")), "warning": q.freshness_warning(F.col("days"), hint)})


def stale(rows: DataFrame, at: str, now: str, days: int, order: list[str]) -> DataFrame:
    """Rows older than ``days``, the oldest first."""
    return rows.filter(F.col(at) < F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))).orderBy(at, *order)
