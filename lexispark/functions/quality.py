"""Freshness, content hashes and health rules as Column expressions; ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days from which data is stale, outdated; minimum failures per history; ratios.
STALE_DAYS, OUTDATED_DAYS = 7, 30
MIN_FAILURES = {
    "kaisei": 3, "jimu-unei": 2, "bunshokaitou": 3, "tax-answer": 5, "qa-jirei": 10,
    "tsutatsu-shohi": 8, "tsutatsu-shotoku": 10, "tsutatsu-hojin": 10, "tsutatsu-sozoku": 4,
}
MIN_FAIL_RATE = 0.01
DRIFT_RATIO = 0.2
STRUCTURAL_RATIO = 0.5
HISTORY_LIMIT = 12


def days_since(at: Column, now: Column) -> Column:
    """Whole periods of 24 hours from ``at`` to ``now``, 0 at least, 0 for null."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.coalesce(F.greatest(F.lit(0), F.floor(micros / 86_400_000_000)), F.lit(0)).cast("long")


def staleness(days: Column) -> Column:
    return F.when(days < STALE_DAYS, "fresh").when(days < OUTDATED_DAYS, "stale").otherwise("outdated")


def freshness_warning(days: Column, hint: str) -> Column:
    """Only outdated data warns."""
    return F.when(staleness(days) == "outdated", F.concat(F.lit("outdated: "), days.cast("string"), F.lit(f" days. {hint}")))


def freshness_of(at: Column, now: Column, hint: str = "") -> Column:
    """Struct fetched_at, staleness, days_since, warning of a single row."""
    days = days_since(at, now)
    return F.struct(at.alias("fetched_at"), staleness(days).alias("staleness"), days.alias("days_since"), freshness_warning(days, hint).alias("warning"))


def document_hash(doc_type: Column, doc_id: Column, title: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("\n", doc_type, doc_id, title, text).cast("binary"))


def ordered_hash(order: Column, number: Column, title: Column, text: Column) -> Column:
    """Aggregate: SHA-1 over the clauses of a group in their order."""
    part = F.concat(number, F.lit("\n"), title, F.lit("\n"), text, F.lit("\n---\n"))
    clauses = F.array_sort(F.collect_list(F.struct(order.alias("o"), part.alias("p"))))
    return F.sha1(F.array_join(F.transform(clauses, lambda x: x["p"]), "").cast("binary"))


def ratio(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def warn_fail_rate(failed: Column, total: Column, minimum: Column) -> Column:
    return F.coalesce((failed >= minimum) & (total > 0) & (ratio(failed, total) >= MIN_FAIL_RATE), F.lit(False))


def warn_drift(total: Column, median: Column) -> Column:
    return F.coalesce((median != 0) & (F.abs(total - median) / F.when(median != 0, median) >= DRIFT_RATIO), F.lit(False))


def warn_structure(updated: Column, total: Column) -> Column:
    """More than half updated at once; exactly half does not warn."""
    return F.coalesce((total > 0) & (ratio(updated, total) > STRUCTURAL_RATIO), F.lit(False))
