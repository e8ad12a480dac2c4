"""Bulk ingest: indexes to links to pages to tables, with change and health reports.

Every step is a table, so a run is a handful of jobs whatever the number of
pages.  New rows are staged and swapped in; failed pages never delete old rows:
what a page gave stays until the page gives something else or no index lists it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality, urls
from ..sources import fetch as source
from ..sources.store import Store
from . import diff, lookup, merge, pages, plan


@dataclass(frozen=True)
class Ingest:
    """How to run: where to store, how to fetch, and the time that stamps it."""

    store: Store
    fetcher: source.Fetcher = source.http_get
    params: source.FetchParams = source.FetchParams()
    now: str | None = None

    def pages(self, targets: DataFrame, label: str) -> DataFrame:
        """Raw pages, fetched once and written to the store, whatever reads them afterwards."""
        path = f"{self.store.root}/raw/{label}-{time.time_ns()}"
        source.fetch(targets, self.fetcher, self.params, self.now).write.parquet(path)
        return self.store.spark.read.parquet(path)

    def log(self, events: DataFrame) -> None:
        """Add events (columns of ``LOG`` but ``at``) to the log of the store as JSON lines."""
        at = F.lit(self.now).cast("timestamp") if self.now else F.current_timestamp()
        events.select(at.alias("at"), "*").write.mode("append").json(f"{self.store.root}/log")

    def logged(self) -> DataFrame:
        """All events of the log."""
        return self.store.spark.read.schema(LOG).json(f"{self.store.root}/log")


LOG = "at timestamp, level string, doc_type string, topic string, url string, message string, fetched bigint, failed bigint"
TOPICS = {"kaisei": urls.revision_taxonomy, "jimu-unei": urls.guideline_taxonomy, "bunshokaitou": urls.reply_taxonomy}


def topic(doc_type: str, url: Column) -> Column:
    """The topic that the URL of a document names."""
    return TOPICS[doc_type](url) if doc_type in TOPICS else urls.first_group(url, FOLDERS[doc_type])


def events(doc_type: str, links: DataFrame, raw: DataFrame, made: DataFrame) -> DataFrame:
    """For each topic how many pages gave a document and how many none (info), and each page that gave none with its reason (error)."""
    good = made.filter(F.col("error").isNull() & (F.col("doc_id") != "")).select(F.col("source_url").alias("url")).distinct().withColumn("_ok", F.lit(True))
    bad = made.filter(F.col("error").isNotNull()).groupBy(F.col("source_url").alias("url")).agg(F.min("error").alias("_parse"))
    pages_ = links.select("url", topic(doc_type, F.col("url")).alias("topic")).join(good, "url", "left").join(raw.select("url", F.col("error").alias("_fetch")), "url", "left").join(bad, "url", "left")
    pages_ = pages_.withColumn("ok", F.coalesce("_ok", F.lit(False)))
    none = F.lit(None)
    per = diff.outcomes(pages_, "topic", F.col("ok")).select(F.lit("info").alias("level"), F.lit(doc_type).alias("doc_type"), "topic", none.cast("string").alias("url"), none.cast("string").alias("message"), "fetched", "failed")
    broken = pages_.filter(~F.col("ok")).select(F.lit("error").alias("level"), F.lit(doc_type).alias("doc_type"), "topic", "url", F.coalesce("_fetch", "_parse", F.lit("no document")).alias("message"), none.cast("bigint").alias("fetched"), none.cast("bigint").alias("failed"))
    return per.unionByName(broken)


def report(run: Ingest, doc_type: str, before: DataFrame, after: DataFrame, total: int, failed: int, began: float, record: bool = True) -> DataFrame:
    """One row of counters and health; appended to the history after it was judged against it."""
    at = F.lit(run.now).cast("timestamp") if run.now else F.current_timestamp()
    row = diff.summary(before, after, failed, total).select(
        F.lit(doc_type).alias("doc_type"), at.alias("ran_at"), "total", F.lit(total - failed).cast("long").alias("fetched"), "failed", "new_docs", "updated_docs", "orphaned_docs", "moved_docs", "fail_rate",
        F.lit(int((time.time() - began) * 1000)).cast("long").alias("duration_ms"),
    )
    spark = run.store.spark
    row = spark.createDataFrame(row.collect(), row.schema)  # one row: fixed before the history changes
    judged = diff.evaluate(row, run.store.read("run_history"))
    judged = spark.createDataFrame(judged.collect(), judged.schema)
    if record:
        run.store.append_run(row)
    return judged


#: Where the URL of a link names its taxonomy.
FOLDERS = {"tax-answer": r"/taxanswer/([^/]+)/", "qa-jirei": r"/shitsugi/([^/]+)/"}


def links_of(run: Ingest, index: DataFrame, kind: str, limit: int | None, taxonomies: list[str] | None) -> DataFrame:
    """Links of index pages; ``limit`` caps the links of each index page, 0 or None keeps all."""
    found = pages.index_links(source.parsed(run.pages(index, f"{kind}-index")), kind)
    if taxonomies:
        if kind in FOLDERS:
            found = found.withColumn("taxonomy", F.regexp_extract("url", FOLDERS[kind], 1))
        found = diff.scoped(found, "taxonomy", taxonomies)
    found = lookup.capped(found, ["page_url"], [F.col("pos")], limit)
    return found.select("url", F.col("title").alias("link_title"), F.col("issued_at").alias("link_issued_at")).dropDuplicates(["url"])


def documents(run: Ingest, doc_type: str, index: DataFrame, limit: int | None = None, taxonomies: list[str] | None = None) -> DataFrame:
    """Ingest one document type from its index pages (column url); returns the report.

    Written replies start from the main index, whose entries are index pages
    per taxonomy.  Capped and scoped runs leave no trace in the history.
    """
    began = time.time()
    if doc_type == "bunshokaitou":
        main = pages.index_links(source.parsed(run.pages(index, "bunshokaitou-main")), "bunshokaitou-main")
        index = diff.scoped(main, "taxonomy", taxonomies).select("url")
    links = links_of(run, index, doc_type, limit, taxonomies)
    raw = run.pages(links, doc_type)
    parsed = source.parsed(raw)
    made = pages.tax_answers(parsed) if doc_type == "tax-answer" else pages.qa_cases(parsed) if doc_type == "qa-jirei" else pages.document_pages(parsed, doc_type)
    made = made.join(links, made["source_url"] == links["url"], "left").withColumn("issued_at", F.coalesce("issued_at", "link_issued_at"))
    path = f"{run.store.root}/raw/{doc_type}-made-{time.time_ns()}"
    made.write.parquet(path)
    made = run.store.spark.read.parquet(path)
    run.log(events(doc_type, links, raw, made))
    good = made.filter(F.col("error").isNull() & (F.col("doc_id") != ""))
    own = run.store["document"]
    before = own.read().filter(F.col("doc_type") == doc_type).select("doc_id", "content_hash", "title")
    own.merge(good)
    total, fetched = links.count(), good.select("source_url").distinct().count()
    listed = run.store["document"].read().filter(F.col("doc_type") == doc_type)
    # what the index no longer lists is orphaned, although its row stays
    after = listed.join(links.select(F.col("url").alias("source_url")), "source_url", "left_semi").select("doc_id", "content_hash", "title")
    return report(run, doc_type, before, after, total, total - fetched, began, record=not limit and not taxonomies)


def circulars(run: Ingest, contents: DataFrame, only_chapter: int | None = None) -> DataFrame:
    """Ingest circulars from their tables of contents (formal_name, abbr, url); returns a report per circular.

    The clauses of a page replace those it gave before.  A listed page that could not
    be read, or has no clause, keeps its old ones; clauses of pages that the contents no
    longer list leave.  A circular whose contents could not be read stays as it is.
    """
    began, spark = time.time(), run.store.spark
    named = contents.select("formal_name", "abbr", "url", F.xxhash64("formal_name").alias("id"))
    toc = source.parsed(run.pages(named, "contents")).join(named, "url")
    entries = pages.contents(toc, urls.toc_style(F.col("formal_name"))).join(named.select("url", F.col("id").alias("circular_id")), "url")
    if only_chapter:
        entries = entries.filter(F.col("chapter_number") == only_chapter)
    entries = entries.drop("url").withColumnRenamed("section_url", "url")
    path = f"{run.store.root}/raw/entries-{time.time_ns()}"
    entries.write.parquet(path)
    entries = spark.read.parquet(path)
    raw = run.pages(entries, "sections")
    clauses = pages.section_clauses(source.parsed(raw))
    placed = clauses.join(entries.select("circular_id", "chapter_number", "section_number", "url"), "url")
    own = placed.select(
        F.xxhash64("circular_id", "clause_number").alias("id"), "circular_id", "clause_number", F.col("url").alias("source_url"), "chapter_number", "section_number", "title", "full_text", "paragraphs", "pos",
    )
    own = merge.latest(own, ["circular_id", "clause_number"], "pos")
    path = f"{run.store.root}/raw/clauses-{time.time_ns()}"
    own.write.parquet(path)
    own = spark.read.parquet(path)
    heads = named.select("id", "formal_name", "abbr", F.col("url").alias("source_root_url"))
    reports, names = [], [r["formal_name"] for r in named.collect()]
    before = {n: diff.clause_snapshot(run.store.read("clause"), run.store.read("circular"), n) for n in names}
    run.store["circular"].merge(heads)
    run.store["chapter"].merge(entries.select("circular_id", F.col("chapter_number").alias("number"), F.col("chapter_title").alias("title")).distinct())
    hashes = own.groupBy("circular_id", "chapter_number", "section_number").agg(quality.ordered_hash(F.col("pos"), F.col("clause_number"), F.col("title"), F.col("full_text")).alias("content_hash"))
    stamped = entries.join(raw.filter("error IS NULL").select("url", "fetched_at"), "url").join(hashes, ["circular_id", "chapter_number", "section_number"], "left")
    run.store["section"].merge(stamped.select("circular_id", "chapter_number", "section_number", F.col("section_title").alias("title"), "url", "fetched_at", "content_hash"))
    scope = entries.select("circular_id", *(["chapter_number"] if only_chapter else [])).distinct()
    unread = entries.select("circular_id", F.col("url").alias("source_url")).distinct().join(own.select("circular_id", "source_url").distinct(), ["circular_id", "source_url"], "left_anti")
    old = run.store["clause"].read()
    lost = old.join(scope, scope.columns, "left_semi").join(unread, ["circular_id", "source_url"], "left_anti")
    run.store["clause"].merge(own, "pos", gone=lost)
    bad = raw.filter("error IS NOT NULL").select("url")
    counts = {r["circular_id"]: (r["n"], r["bad"]) for r in entries.join(bad.withColumn("_b", F.lit(1)), "url", "left").groupBy("circular_id").agg(F.count("*").alias("n"), F.count("_b").alias("bad")).collect()}
    ids = {r["formal_name"]: r["id"] for r in named.collect()}
    kinds = {r["formal_name"]: r["kind"] for r in named.select("formal_name", F.coalesce(urls.baseline_type(F.col("formal_name")), F.concat(F.lit("tsutatsu-"), "formal_name")).alias("kind")).collect()}
    for n in names:
        after = diff.clause_snapshot(run.store.read("clause"), run.store.read("circular"), n)
        total, failed = counts.get(ids[n], (0, 0))
        reports.append(report(run, kinds[n], before[n], after, total, failed, began, record=not only_chapter))
    if not reports:  # no circular: a report without rows
        none = run.store.read("clause").limit(0).select(F.col("clause_number").alias("doc_id"), F.lit("").alias("content_hash"), "title")
        return report(run, "tsutatsu", none, none, 0, 0, began, record=False).limit(0)
    return reduce(DataFrame.unionByName, reports)


def live_documents(run: Ingest, doc_type: str, targets: DataFrame) -> DataFrame:
    """Documents of single pages (column url), read now and merged into the store; pages without one are left out."""
    parsed = source.parsed(run.pages(targets, "live"))
    made = pages.tax_answers(parsed) if doc_type == "tax-answer" else pages.qa_cases(parsed) if doc_type == "qa-jirei" else pages.document_pages(parsed, doc_type)
    good = made.filter(F.col("error").isNull() & (F.col("doc_id") != ""))
    path = f"{run.store.root}/raw/live-made-{time.time_ns()}"
    good.write.parquet(path)
    good = run.store.spark.read.parquet(path)
    run.store["document"].merge(good)
    return good.select(*run.store["document"].read().columns)


def canaries(run: Ingest, targets: DataFrame) -> DataFrame:
    """One row per target (name, kind, url): ok, and why not.

    A circular's page must have a clause, an index (kinds of ``pages.INDEX_LINKS``) a link of its kind, others a title.
    """
    raw = run.pages(targets, "canary")
    read = source.parsed(raw)
    clauses = pages.section_clauses(read).groupBy("url").agg(F.count("*").alias("_clauses"))
    seen = read.select("url", "found", F.col("error").alias("_parse"), pages.page_heading(F.col("blocks")).isNotNull().alias("_title")).join(clauses, "url", "left")
    j = targets.join(raw.select("url", F.col("error").alias("_fetch")), "url", "left").join(seen, "url", "left")
    kinds = read.join(targets.select("url", "kind"), "url")
    listed = reduce(DataFrame.unionByName, [pages.index_links(kinds.filter(F.col("kind") == k).drop("kind"), k).select(F.col("page_url").alias("url"), F.lit(k).alias("kind")) for k in pages.INDEX_LINKS])
    j = j.join(listed.groupBy("url", "kind").agg(F.count("*").alias("_links")), ["url", "kind"], "left")
    enough: Column = F.when(F.col("kind") == "circular", F.coalesce("_clauses", F.lit(0)) > 0).when(F.col("kind").isin(*pages.INDEX_LINKS), F.coalesce("_links", F.lit(0)) > 0).otherwise(F.coalesce("_title", F.lit(False)))
    reason = F.coalesce("_fetch", "_parse", F.when(~enough, F.lit("nothing found")))
    return j.select("name", "kind", "url", reason.isNull().alias("ok"), reason.alias("reason"))


def canary_counts(results: DataFrame) -> DataFrame:
    """ok and failed over the rows of ``canaries``."""
    return results.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def everything(run: Ingest, site: str, limit: int | None = None) -> DataFrame:
    """Ingest all circulars and document types of a site; the reports of all, and a row with the reason in ``error`` for a type that failed as a whole.

    Types are a fixed handful and run one after the other, each over all its pages at
    once; one that fails leaves the others as they are.
    """
    spark = run.store.spark
    steps = [("tsutatsu", lambda: circulars(run, plan.circulars(spark, site)))]
    steps += [(t, lambda t=t: documents(run, t, plan.indexes(spark, site, t), limit)) for t in plan.INDEXES]
    reports = []
    for name, step in steps:
        try:
            reports.append(step().withColumn("error", F.lit(None).cast("string")))
        except Exception as e:  # noqa: BLE001 - the row carries the error
            reports.append(spark.createDataFrame([(name, f"{type(e).__name__}: {e}"[:500])], "doc_type string, error string"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
