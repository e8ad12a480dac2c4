"""Keyed lookups, lists of what is there, and capped or ordered picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_key


def given(**values: object) -> Column | None:
    """Conjunction of the equalities whose value is not None; None if there is none."""
    tests = [F.col(c) == F.lit(v) for c, v in values.items() if v is not None]
    return reduce(lambda a, b: a & b, tests) if tests else None


def has_attachment(column: str, wanted: bool | None) -> Column | None:
    """Of a JSON list column: with an element (True), without (False), no test (None)."""
    there = F.col(column).isNotNull() & ~F.trim(F.col(column)).isin("", "[]")
    return None if wanted is None else there if wanted else ~there


def clauses(requests: DataFrame, clause: DataFrame, circulars: DataFrame, section: DataFrame) -> DataFrame:
    """Requests (name, clause) with their clause or nulls; the section's time is an empty string without one."""
    r = requests.withColumn("_number", normalize_key(F.col("clause")))
    full = clause.join(circulars.select(F.col("id").alias("circular_id"), "formal_name", "abbr"), "circular_id")
    full = full.join(section.select("circular_id", "chapter_number", "section_number", "fetched_at"), ["circular_id", "chapter_number", "section_number"], "left")
    hit = full.select("formal_name", "abbr", "clause_number", "source_url", "title", "full_text", "paragraphs", F.coalesce(F.col("fetched_at").cast("string"), F.lit("")).alias("fetched_at"))
    return r.join(hit, (r["name"] == hit["formal_name"]) & (r["_number"] == hit["clause_number"]), "left").drop("_number", "formal_name").withColumn("source", F.when(F.col("clause_number").isNotNull(), "db"))


def with_fallback(requests: DataFrame, stored_rows: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows of the requests, and live rows for requests without one; source says which."""
    hits = stored_rows.join(requests.select(*keys).distinct(), keys, "left_semi").withColumn("source", F.lit("db"))
    rest = requests.select(*keys).distinct().join(hits, keys, "left_anti")
    return hits.unionByName(live.join(rest, keys, "left_semi").withColumn("source", F.lit("live")))


def available_clauses(clause: DataFrame, circulars: DataFrame, name: str, limit: int = 200) -> DataFrame:
    own = clause.join(circulars.filter(F.col("formal_name") == name).select(F.col("id").alias("circular_id")), "circular_id")
    return own.orderBy("id").limit(limit).select("clause_number", "title")


def available_documents(documents: DataFrame, doc_type: str, limit: int = 50) -> DataFrame:
    return documents.filter(F.col("doc_type") == doc_type).orderBy(F.col("issued_at").desc_nulls_last(), F.col("doc_id").desc()).limit(limit).select("doc_id", "title", "issued_at")


def exists(rows: DataFrame, test: Column | None = None) -> bool:
    return not (rows if test is None else rows.filter(test)).isEmpty()


def capped(rows: DataFrame, group: list[str], order: list[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows of each group; 0 or None keeps all."""
    if not n:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def first_per(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return capped(rows, group, order, 1)


def last_seen_label(rows: DataFrame, label: Column, page: str, place: str) -> Column:
    """The latest label at or above a row of its page: carried headings."""
    w = Window.partitionBy(page).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(label, ignorenulls=True).over(w)
