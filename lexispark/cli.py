"""Command line: ``python -m lexispark.cli COMMAND ...``; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import quality
from .operators import diff, ingest, plan
from .plans.api import Engine


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="lexispark")
    top.add_argument("--root", help="folder of the tables")
    top.add_argument("--now", help="time that stamps the run")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest", help="ingest documents from index pages")
    p.add_argument("doc_type")
    p.add_argument("url", nargs="+")
    p.add_argument("--limit", type=int)
    p.add_argument("--taxonomy", action="append")
    p = sub.add_parser("circular", help="ingest a circular from its table of contents")
    p.add_argument("name")
    p.add_argument("abbr")
    p.add_argument("url")
    p.add_argument("--chapter", type=int)
    p = sub.add_parser("search", help="search documents, or circulars without a type")
    p.add_argument("keyword")
    p.add_argument("--doc-type")
    p.add_argument("--taxonomy")
    p.add_argument("--limit", type=int)
    p = sub.add_parser("stale", help="sections older than some days; --apply fetches their circulars again")
    p.add_argument("days", type=int)
    p.add_argument("--name")
    p.add_argument("--apply", action="store_true")
    p = sub.add_parser("everything", help="ingest all circulars and document types of a site")
    p.add_argument("site", help="scheme and host")
    p.add_argument("--limit", type=int)
    p.add_argument("--strict", action="store_true", help="fail if a report warns or a type failed")
    sub.add_parser("runs", help="last run of each type, and its age in days")
    sub.add_parser("log", help="outcomes per topic, and pages without a document")
    p = sub.add_parser("canary", help="fetch and parse one page per kind")
    p.add_argument("target", nargs="*", help="name,kind,url")
    p.add_argument("--site", help="scheme and host whose usual nine pages are read")
    p.add_argument("--strict", action="store_true", help="fail if a page fails")
    return top.parse_args(argv)


def execute(engine: Engine, a: argparse.Namespace) -> DataFrame:
    spark = engine.spark
    if a.command == "ingest":
        found = ingest.documents(engine.run, a.doc_type, spark.createDataFrame([(u,) for u in a.url], "url string"), a.limit, a.taxonomy)
        engine.store.sync()
        return found
    if a.command == "circular":
        found = ingest.circulars(engine.run, spark.createDataFrame([(a.name, a.abbr, a.url)], "formal_name string, abbr string, url string"), a.chapter)
        engine.store.sync()
        return found
    if a.command == "search":
        return engine.search_documents(a.keyword, a.doc_type, a.taxonomy, limit=a.limit) if a.doc_type else engine.search_circulars(a.keyword, limit=a.limit)
    if a.command == "stale":
        found = engine.stale_sections(a.days, a.name)
        if not a.apply:
            return found
        named = found.select("formal_name").distinct().join(engine.store.read("circular"), "formal_name").select("formal_name", "abbr", F.col("source_root_url").alias("url"))
        rows = spark.createDataFrame(named.collect(), named.schema)  # one row per circular
        return found if rows.isEmpty() else ingest.circulars(engine.run, rows)
    if a.command == "runs":
        return diff.last_run(engine.store.read("run_history")).withColumn("days_ago", quality.days_since(F.col("ran_at"), F.lit(engine.now)))
    if a.command == "log":
        return engine.run.logged()
    if a.command == "everything":
        found = ingest.everything(engine.run, a.site, a.limit)
        engine.store.sync()
        return found
    if not a.target and not a.site:
        raise ValueError("name targets or a site")
    targets = spark.createDataFrame([tuple(t.split(",", 2)) for t in a.target], "name string, kind string, url string")
    return ingest.canaries(engine.run, targets.unionByName(plan.canaries(spark, a.site)) if a.site else targets)


def failed(command: str, row: dict) -> bool:
    """Whether a row of the output makes a strict call fail."""
    return not row["ok"] if command == "canary" else bool(row.get("warn")) or row.get("error") is not None


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("lexispark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    bad = 0
    for row in execute(Engine(spark, a.root, a.now), a).toJSON().toLocalIterator():
        print(row)
        bad += getattr(a, "strict", False) and failed(a.command, json.loads(row))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
