"""The engine's questions as methods of one object.

Search and lookup methods take and return tables; each result row carries the
freshness of its data and what it binds.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pdf, text, urls
from ..operators import diff, ingest, lookup, pages, plan, postings, render, search
from ..schema import DOC_TYPES, legal_status
from ..sources import fetch as source
from ..sources.store import Store

TEXT = ("title", "full_text")


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, now: str | None = None, fetcher: source.Fetcher = source.http_get, params: source.FetchParams | None = None):
        self.store = Store(spark, root)
        self.spark, self._now = spark, now
        self.run = ingest.Ingest(self.store, fetcher, params or source.FetchParams(), now)

    @cached_property
    def now(self) -> str:
        """The time that freshness is told against: as given, else that of the first question."""
        return self._now or str(self.spark.sql("SELECT current_timestamp()").first()[0])

    # -- search

    def _binding(self, doc_type: str) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in legal_status(doc_type).items()])

    def _fresh(self, found: DataFrame, rows: DataFrame) -> DataFrame:
        one = diff.freshness(rows, "fetched_at", self.now, hint="ingest again").select(F.struct("oldest", "newest", "n", "days", "staleness", "warning").alias("freshness"))
        return found.join(F.broadcast(one), how="left")  # one row at most

    def search_circulars(self, keyword: str, formal_name: str | None = None, limit: int | None = None) -> DataFrame:
        circulars = self.store.read("circular").select(F.col("id").alias("circular_id"), "formal_name", "abbr")
        rows = self.store.read("clause").join(circulars, "circular_id").drop("paragraphs")
        found = search.scan(rows, keyword, "id", ("clause_number", *TEXT), lookup.given(formal_name=formal_name), limit)
        found = found.select("formal_name", "abbr", "clause_number", "title", "snippet", "source_url", "rank", self._binding("circular").alias("binding"))
        return self._fresh(found, self.store.read("section"))

    def search_documents(self, keyword: str, doc_type: str, taxonomy: str | None = None, has_pdf: bool | None = None, limit: int | None = None) -> DataFrame:
        if doc_type not in DOC_TYPES:
            raise ValueError(f"unknown doc_type {doc_type}")
        rows = self.store.read("document")
        keep = lookup.given(doc_type=doc_type, taxonomy=taxonomy)
        there = F.coalesce(F.size("attached_pdfs"), F.lit(0)) > 0
        keep = keep if has_pdf is None else keep & (there if has_pdf else ~there)
        found = search.scan(rows, keyword, "doc_id", TEXT, keep, limit)
        found = found.select("doc_type", "doc_id", "taxonomy", "title", "issued_at", "source_url", "snippet", "rank", self._binding(doc_type).alias("binding"))
        return self._fresh(found, rows.filter(F.col("doc_type") == doc_type))

    def search_qa(self, keyword: str, topic: str | None = None, **given) -> DataFrame:
        return self.search_documents(keyword, "qa-jirei", topic, **given)

    def search_tax_answers(self, keyword: str, **given) -> DataFrame:
        return self.search_documents(keyword, "tax-answer", **given)

    def search_revisions(self, keyword: str, taxonomy: str | None = None, **given) -> DataFrame:
        return self.search_documents(keyword, "kaisei", taxonomy, **given)

    def search_guidelines(self, keyword: str, taxonomy: str | None = None, **given) -> DataFrame:
        return self.search_documents(keyword, "jimu-unei", taxonomy, **given)

    def search_replies(self, keyword: str, taxonomy: str | None = None, **given) -> DataFrame:
        return self.search_documents(keyword, "bunshokaitou", taxonomy, **given)

    def search_many(self, queries: DataFrame, limit: int = search.LIMIT) -> DataFrame:
        """Queries (query_id, keyword) over all documents at once, by the index kept with the store; key is doc_type and doc_id."""
        index = self.store.index("document")
        return postings.shown(index.search(queries, limit)[0], queries, self.store.read("document"), index.key(), "full_text")

    # -- lookups

    def get_clauses(self, requests: DataFrame, live: bool = False) -> DataFrame:
        """Requests (name or abbreviation, clause): the stored clause, else with ``live`` the one of its page, written back."""
        named = requests.select(F.coalesce(urls.resolve_abbreviation(F.col("name"))["formal_name"], "name").alias("name"), "clause")
        found = lookup.clauses(named, self.store.read("clause"), self.store.read("circular"), self.store.read("section"))
        if not live:
            return found
        missing = found.filter("source IS NULL").select("name", "clause")
        fetched = self._live_clauses(missing)
        self.store["clause"].merge(fetched)
        again = lookup.clauses(missing, self.store.read("clause"), self.store.read("circular"), self.store.read("section"))
        return found.filter("source IS NOT NULL").unionByName(again.withColumn("source", F.when(F.col("source").isNotNull(), "live")))

    def _live_clauses(self, missing: DataFrame) -> DataFrame:
        circular = self.store.read("circular").select(F.col("id").alias("circular_id"), "formal_name", "source_root_url")
        n = text.parse_clause_number(text.normalize_key(F.col("clause")))
        asked = missing.join(circular, F.col("name") == F.col("formal_name")).withColumn("_n", n).filter("_n IS NOT NULL")
        root = F.regexp_replace("source_root_url", r"[^/]*$", "")
        asked = asked.select("circular_id", F.col("_n.chapter").alias("chapter_number"), F.col("_n.section").alias("section_number"), urls.section_url(root, F.col("_n.chapter"), F.col("_n.section")).alias("url")).distinct()
        read = pages.section_clauses(source.parsed(self.run.pages(asked, "live"))).join(asked, "url")
        return read.select(F.xxhash64("circular_id", "clause_number").alias("id"), "circular_id", "clause_number", F.col("url").alias("source_url"), "chapter_number", "section_number", "title", "full_text", "paragraphs")

    def available_clauses_on_miss(self, requests: DataFrame, limit: int = 50) -> DataFrame:
        """For every request (name or abbreviation, clause) that is not stored, clauses of the circular: name, asked, rank, clause_number, title."""
        missed = self.get_clauses(requests).filter("source IS NULL").select("name", F.col("clause").alias("asked")).distinct()
        own = self.store.read("clause").join(self.store.read("circular").select(F.col("id").alias("circular_id"), F.col("formal_name").alias("name")), "circular_id")
        order = Window.partitionBy("name").orderBy("id")
        some = own.select("name", "clause_number", "title", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= limit)
        return missed.join(some, "name").select("name", "asked", "rank", "clause_number", "title")

    def available_clauses(self, name: str, limit: int = 50) -> DataFrame:
        return lookup.available_clauses(self.store.read("clause"), self.store.read("circular"), name, limit)

    def get_documents(self, requests: DataFrame, live: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
        """Documents of the requests (doc_type, doc_id); rows of ``live`` stand in for those not stored."""
        rows = self.store.read("document") if rows is None else rows
        return lookup.with_fallback(requests, rows, rows.limit(0) if live is None else live.select(*rows.columns), ["doc_type", "doc_id"])

    def get_or_fetch(self, doc_type: str, doc_id: str, url: str | None) -> DataFrame:
        """The stored document; with a ``url``, one that is not stored is read from there and written back."""
        asked = self._ask(doc_type, doc_id)
        found = self.get_document(doc_type, doc_id)
        if url is None or not found.isEmpty():
            return found
        return self.get_documents(asked, ingest.live_documents(self.run, doc_type, self.spark.createDataFrame([(url,)], "url string")).filter(F.col("doc_id") == doc_id)).withColumn("source", F.lit("live"))

    def get_qa(self, topic: str, category: str, number: str, site: str | None = None) -> DataFrame:
        """With a ``site`` (scheme and host) a case that is not stored is fetched."""
        if topic not in plan.QA_TOPICS:
            raise ValueError(f"unknown topic {topic}")
        doc_id = f"{topic}/{category.zfill(2)}/{number.zfill(2)}"
        return self.get_or_fetch("qa-jirei", doc_id, site and f"{site}/law/shitsugi/{doc_id}.htm")

    def get_tax_answer(self, number: str, site: str | None = None) -> DataFrame:
        """With a ``site`` (scheme and host) an answer that is not stored is fetched."""
        if number[:1] not in urls.ANSWER_FOLDERS:
            raise ValueError(f"no folder for {number}")
        return self.get_or_fetch("tax-answer", number, site and f"{site}/taxes/shiraberu/taxanswer/{urls.ANSWER_FOLDERS[number[:1]]}/{number}.htm")

    def get_document(self, doc_type: str, doc_id: str) -> DataFrame:
        """One stored document; only its bucket is opened."""
        return self.get_documents(self._ask(doc_type, doc_id), rows=self.store["document"].lookup([(doc_type, doc_id)]))

    def get_revision(self, doc_id: str) -> DataFrame:
        return self.get_document("kaisei", doc_id)

    def get_guideline(self, doc_id: str) -> DataFrame:
        return self.get_document("jimu-unei", doc_id)

    def get_reply(self, doc_id: str) -> DataFrame:
        return self.get_document("bunshokaitou", doc_id)

    def _ask(self, doc_type: str, doc_id: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(doc_type).alias("doc_type"), F.lit(doc_id).alias("doc_id"))

    def available_documents(self, doc_type: str, limit: int = 30) -> DataFrame:
        return lookup.available_documents(self.store.read("document"), doc_type, limit)

    def available_on_miss(self, requests: DataFrame, limit: int = 30) -> DataFrame:
        """For every request (doc_type, doc_id) that is not stored, the latest documents of its type: asked, rank, doc_id, title, issued_at."""
        rows = self.store.read("document")
        missed = requests.select("doc_type", "doc_id").distinct().join(rows, ["doc_type", "doc_id"], "left_anti").withColumnRenamed("doc_id", "asked")
        order = Window.partitionBy("doc_type").orderBy(F.col("issued_at").desc_nulls_last(), F.col("doc_id").desc())
        some = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("doc_type", "rank", "doc_id", "title", "issued_at")
        return missed.join(some, "doc_type").select("doc_type", "asked", "rank", "doc_id", "title", "issued_at")

    def resolve_abbreviations(self, names: DataFrame) -> DataFrame:
        return names.select("abbr", urls.resolve_abbreviation(F.col("abbr")).alias("_r")).select("abbr", "_r.*")

    def inspect_pdfs(self, doc_type: str, doc_id: str) -> DataFrame:
        """The document's files with their kinds, by priority, with reading hints and what the document binds."""
        own = self.get_document(doc_type, doc_id)
        filled = pdf.by_priority(pdf.fill_kinds(F.col("attached_pdfs")))
        return own.select("doc_type", "doc_id", "title", filled.alias("pdfs"), pdf.noted_hints(F.col("attached_pdfs")).alias("hints"), self._binding(doc_type).alias("binding"))

    def stale_sections(self, days: int, formal_name: str | None = None) -> DataFrame:
        circulars = self.store.read("circular").select(F.col("id").alias("circular_id"), "formal_name")
        rows = self.store.read("section").join(circulars, "circular_id")
        test = lookup.given(formal_name=formal_name)
        return diff.stale(rows if test is None else rows.filter(test), "fetched_at", self.now, days, ["formal_name", "chapter_number", "section_number"])

    # -- renderings

    def document_markdown(self, found: DataFrame) -> DataFrame:
        """doc_type, doc_id, markdown of found documents: cases and answers with their sections, others with their facts and files."""
        c, at = F.col, F.col("fetched_at").cast("string")
        parts = text.sections(c("full_text"))
        part = lambda h: F.coalesce(F.get(F.filter(parts, lambda s: s["heading"] == h), 0)["paragraphs"], F.array().cast("array<string>"))
        case = render.qa_case(c("title"), part("照会要旨"), part("回答要旨"), part("関係法令通達"), c("source_url"), at)
        answer = render.tax_answer(c("doc_id"), c("title"), c("issued_at"), c("taxonomy"), parts, c("source_url"), at)
        other = render.document(c("title"), c("taxonomy"), c("issued_at"), c("issuer"), c("full_text"), pdf.fill_kinds(F.coalesce("attached_pdfs", F.array().cast(f"array<{pdf.PDF}>"))), c("source_url"), at)
        md = F.when(c("doc_type") == "qa-jirei", case).when(c("doc_type") == "tax-answer", answer).otherwise(other)
        return found.select("doc_type", "doc_id", md.alias("markdown"))

    def section_markdown(self, name: str, chapter: int, section: int) -> DataFrame:
        """name, chapter_number, section_number, markdown: a section with all its clauses in the order of their numbers."""
        at = ["circular_id", "chapter_number", "section_number"]
        own = self.store.read("circular").filter(F.col("formal_name") == name).select(F.col("id").alias("circular_id"), "formal_name")
        heads = self.store.read("section").filter((F.col("chapter_number") == chapter) & (F.col("section_number") == section)).join(own, "circular_id")
        titles = self.store.read("chapter").select("circular_id", F.col("number").alias("chapter_number"), F.col("title").alias("_chapter"))
        places = F.transform(F.regexp_extract_all("clause_number", F.lit(r"(\d+)")), lambda x: x.cast("long"))
        clauses = self.store.read("clause").join(heads.select(*at), at).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(places.alias("n"), "clause_number", "title", "paragraphs"))).alias("_clauses"))  # one page
        found = heads.join(clauses, at, "left").join(titles, ["circular_id", "chapter_number"], "left")
        body = F.coalesce(F.col("_clauses"), F.array().cast(clauses.schema["_clauses"].dataType))
        md = render.section_page(F.coalesce("title", F.lit("")), F.col("_chapter"), body, F.col("url"), F.col("fetched_at").cast("string"))
        return found.select(F.col("formal_name").alias("name"), "chapter_number", "section_number", md.alias("markdown"))

    def hits_markdown(self, found: DataFrame) -> DataFrame:
        """rank, markdown: a list line for each row of a search."""
        return found.select("rank", render.search_hit(F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")), F.col("source_url")).alias("markdown"))

    def clause_markdown(self, found: DataFrame) -> DataFrame:
        c = F.col
        return found.select("name", "clause", render.clause_page(c("clause_number"), c("title"), c("paragraphs"), c("source_url"), c("fetched_at")).alias("markdown"))
