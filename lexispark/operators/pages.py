"""Raw pages to rows.

One Python step, batched by Arrow, turns a page's HTML into a flat stream of
blocks (headings, paragraphs, list items) with their links made absolute.  All
that pages mean is then said in Column expressions over these blocks, so that
pages are never shuffled by parsing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, pdf, text, urls
from ..functions.binding import bind

BLOCK = "struct<tag:string,cls:string,style:string,align:string,header:boolean,text:string,strong:string,links:array<struct<url:string,text:string>>>"
PARSED = f"page_title string, found boolean, blocks array<{BLOCK}>, error string"
BLOCK_TYPE = pa.struct([
    ("tag", pa.string()), ("cls", pa.string()), ("style", pa.string()), ("align", pa.string()), ("header", pa.bool_()), ("text", pa.string()), ("strong", pa.string()),
    ("links", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string())]))),
])

BLOCK_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th div article section main blockquote caption".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP_TAGS = frozenset("script style noscript template".split())
# The body's id, classes that are navigation, paragraphs that are navigation.
BODY_ID = "bodyArea"
SKIP_CLASSES = frozenset(("breadcrumb", "page-top-link", "contents-feedback", "surbey-link"))
SKIP_TEXTS = ("ページの先頭へ戻る", "法令等")
#: Parts for each core, so that none waits long for the last.
TASKS_A_CORE = 4
SJIS = ("shift_jis", "shift-jis", "sjis", "x-sjis", "windows-31j", "ms_kanji")


def normalize_charset(name: Column) -> Column:
    c = F.lower(F.trim(name))
    return F.when(c.isin(*SJIS), "shift_jis").when(c == "utf8", "utf-8").otherwise(c)


def detect_charset(content_type: Column, head: Column) -> Column:
    """From the header, else from a meta element in the first 1024 characters, else Shift_JIS."""
    rx = r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_-]+)"
    meta = F.regexp_extract(F.substring(head, 1, 1024), r"(?i)<meta[^>]+charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)
    return normalize_charset(F.coalesce(text.found(F.regexp_extract(F.coalesce(content_type, F.lit("")), rx, 1)), text.found(meta), F.lit("shift_jis")))


# Plain tags, which most are: their attributes stand in double quotes, without references.
PLAIN_START = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z-]+="[^"&]*")*)>')
PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
PLAIN_ATTRIBUTE = re.compile(r' ([a-zA-Z-]+)="([^"&]*)"')
#: What these hold is read in another way.
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes noscript plaintext xmp".split())
CLOSED_BY_OWN = frozenset("p li td th dt dd".split())


class BlockReader(HTMLParser):
    """Streams a page into blocks; text belongs to the innermost open block."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.title, self.found = url, "", False
        #: tag, block, and whether the element is skipped, the body, the page header
        self.open: list[tuple[str, dict | None, bool, bool, bool]] = []
        self.count: dict[str, int] = {}  # of the open tags
        self.inner: list[dict] = []  # the open blocks
        self.out: list[dict] = []
        self.skipping, self.inside, self.header = 0, 0, 0
        self.link: dict | None = None
        self.strong: list[dict] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted

    def parse_starttag(self, i: int) -> int:
        m = PLAIN_START.match(self.rawdata, i)
        tag = m[1].lower() if m else ""
        if not m or tag in RAW_TAGS:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [(k.lower(), v) for k, v in PLAIN_ATTRIBUTE.findall(m[2])] if m[2] else [])
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = None if self.cdata_elem else PLAIN_END.match(self.rawdata, i)
        if not m or m[1].lower() in RAW_TAGS:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID_TAGS:
            return
        count = self.count
        if tag in BLOCK_TAGS and (count.get("p") or count.get(tag)):
            names = [x[0] for x in self.open]
            if "p" in names and tag != "p" and not set(names[names.index("p") :]) & {"li", "td"}:
                self.close_to("p")
            elif tag in CLOSED_BY_OWN and tag in names and not (tag == "li" and set(names[len(names) - 1 - names[::-1].index(tag) :]) & {"ul", "ol"}):
                self.close_to(tag)
        a = {k: v or "" for k, v in attrs}
        classes = a["class"].split() if "class" in a else ()
        skipped, body, head = tag in SKIP_TAGS or not SKIP_CLASSES.isdisjoint(classes), a.get("id") == BODY_ID, "page-header" in classes
        self.skipping += skipped
        if body:
            if not self.found:
                self.out.clear()  # what stood before the body
            self.found = True
            self.inside += 1
        self.header += head
        block = None
        if tag in BLOCK_TAGS and not self.skipping and (self.inside or not self.found):
            block = {"tag": tag, "cls": a.get("class"), "style": a.get("style"), "align": a.get("align"), "header": self.header > 0, "text": "", "strong": None, "links": []}
            self.out.append(block)
            self.inner.append(block)
        self.open.append((tag, block, skipped, body, head))
        count[tag] = count.get(tag, 0) + 1
        if self.inner and not self.skipping:
            if tag == "a":
                if a.get("href"):
                    self.link = {"href": a["href"], "text": ""}
            elif tag in ("strong", "b") and self.inner[-1]["strong"] is None:
                self.inner[-1]["strong"] = ""
                self.strong.append(self.inner[-1])

    def handle_endtag(self, tag: str) -> None:
        if self.count.get(tag):
            self.close_to(tag)

    def close_to(self, tag: str) -> None:
        while self.open:
            t, block, skipped, body, head = self.open[-1]
            if t == "a" and self.link is not None:
                if self.inner:
                    try:
                        self.inner[-1]["links"].append({"url": urljoin(self.url, self.link["href"].strip()), "text": self.link["text"]})
                    except ValueError:
                        pass
                self.link = None
            elif t in ("strong", "b") and self.strong:
                self.strong.pop()
            self.open.pop()
            self.count[t] -= 1
            if block is not None:
                self.inner.pop()
            self.skipping -= skipped
            self.inside -= body
            self.header -= head
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.count.get("title"):
            self.title += data
            return
        if self.skipping or not self.inner:
            return
        self.inner[-1]["text"] += data
        if self.link is not None:
            self.link["text"] += data
        for b in self.strong:
            b["strong"] += data

    def blocks(self) -> list[dict]:
        self.close()
        while self.open:
            self.close_to(self.open[-1][0])
        return [b for b in self.out if b["links"] or b["text"].strip()]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that pages are made from, over all cores: small files are read in few tasks, yet a page takes as long from any."""
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def parse(pages: DataFrame, url: str = "url", html: str = "html", charset: str | None = None) -> DataFrame:
    """All columns of ``pages`` but the HTML, and page_title, found (has the body element), blocks, error.

    ``html`` is a string, or bytes with their ``charset`` in a column.  A page
    that cannot be read gives an error and no blocks instead of failing the job.
    """
    kept = [c for c in pages.columns if c not in (html, "page_title", "found", "blocks", "error")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in kept] + [PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, found, blocks, errors = [], [], [], []
            codes = batch.column(charset).to_pylist() if charset else [None] * batch.num_rows
            for u, h, c in zip(batch.column(url).to_pylist(), batch.column(html).to_pylist(), codes, strict=True):
                try:
                    if isinstance(h, bytes):
                        h = h.decode({"shift_jis": "cp932"}.get(c, c or "utf-8"), "replace")
                    reader = BlockReader(u or "")
                    reader.feed(h or "")
                    own = reader.blocks()
                    titles.append(reader.title)
                    found.append(reader.found)
                    blocks.append(own)
                    errors.append(None if reader.found else "no body element")
                except Exception as e:  # noqa: BLE001 - one page must not end the job; the row says so
                    titles.append(None)
                    found.append(False)
                    blocks.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            cols = [batch.column(c) for c in kept]
            cols += [pa.array(titles, pa.string()), pa.array(found, pa.bool_()), pa.array(blocks, pa.list_(BLOCK_TYPE)), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "page_title", "found", "blocks", "error"])

    return pages.mapInArrow(run, schema)


# ---- expressions over blocks --------------------------------------------------------------------


def page_heading(blocks: Column) -> Column:
    """The page header's h1, else the first h1, on one line."""
    h1 = F.filter(blocks, lambda b: (b["tag"] == "h1") & (b["text"] != ""))
    first = F.coalesce(F.get(F.filter(h1, lambda b: b["header"]), 0), F.get(h1, 0))
    return text.found(text.clean_line(first["text"]))


def texts(blocks: Column, *tags: str) -> Column:
    """Cleaned texts of the blocks with these tags, without navigation."""
    lines = F.transform(F.filter(blocks, lambda b: b["tag"].isin(*tags)), lambda b: text.clean_line(b["text"]))
    return F.filter(lines, lambda t: (t != "") & ~t.isin(*SKIP_TEXTS))


def all_links(blocks: Column) -> Column:
    """Links without fragment, the first of each URL, in page order."""
    flat = F.flatten(F.transform(blocks, lambda b: F.transform(b["links"], lambda x: F.struct(F.regexp_replace(x["url"], "#.*$", "").alias("url"), text.clean_line(x["text"]).alias("text")))))
    return first_of_url(flat)


def first_of_url(items: Column) -> Column:
    kept = lambda a: bind(F.transform(a, lambda x: x["url"]), lambda seen: F.filter(a, lambda x, i: F.array_position(seen, x["url"]) == i + 1))
    return bind(items, kept)


def attached_pdfs(blocks: Column) -> Column:
    """PDF links: title (PDF without a text), url, size_kb, kind."""
    raw = F.flatten(F.transform(blocks, lambda b: b["links"]))
    own = first_of_url(F.filter(raw, lambda x: x["url"].rlike(r"(?i)\.pdf(\?|$)")))
    title = lambda x: F.coalesce(text.found(text.clean_line(x["text"])), F.lit("PDF"))
    return F.transform(own, lambda x: bind(title(x), lambda t: F.struct(t.alias("title"), x["url"].alias("url"), pdf.size_kb(x["text"]).alias("size_kb"), pdf.kind(t).alias("kind"))))


def under_headings(blocks: Column, heading: Column | None = None, inner: tuple[str, ...] = ("p", "div", "li")) -> Column:
    """Array of struct heading, paragraphs: the blocks between one h2 and the next heading of the page."""
    numbered = F.transform(blocks, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    starts = F.filter(numbered, lambda x: x["b"]["tag"] == "h2")
    plain = F.array().cast("array<int>")
    stops = F.transform(F.filter(numbered, lambda x: (x["b"]["tag"].isin("h1", "h2")) | x["b"]["header"]), lambda x: x["i"])

    def section(s: Column, ends: Column) -> Column:
        end = F.coalesce(F.array_min(F.filter(ends, lambda i: i > s["i"])), F.size(blocks))
        return F.struct(s["b"]["text"].alias("heading"), F.filter(F.slice(blocks, s["i"] + 2, end - s["i"] - 1), lambda b: b["tag"].isin(*inner)).alias("inner"))

    return bind(F.coalesce(stops, plain), lambda ends: F.transform(starts, lambda s: section(s, ends)))


def indent(b: Column) -> Column:
    cls = F.coalesce(b["cls"], F.lit(""))
    named = F.regexp_extract(cls, r"(?:^|\s)indent([123])(?:\s|$)", 1)
    return F.when(named != "", named.cast("int")).otherwise(2)


def section_clauses(parsed: DataFrame) -> DataFrame:
    """Clauses of section pages: page columns, chapter_title, section_title, pos, clause_number, title, paragraphs, full_text.

    A clause is an h2 with a paragraph of the first indent that starts with a
    clause number; what stands before that paragraph is passed over.
    """
    chapter = F.get(F.filter(texts(F.col("blocks"), "p"), lambda t: t.rlike(r"^第[0-9０-９]+(の[0-9０-９]+)?章") & (F.length(t) < 60)), 0)
    bare = F.regexp_replace(text.clean_line(F.col("page_title")), r"\s*[|｜].*$", "")
    pages = parsed.filter("found").withColumn("chapter_title", chapter).withColumn("section_title", F.coalesce(page_heading(F.col("blocks")), bare))
    rows = pages.select("*", F.posexplode(under_headings(F.col("blocks"), inner=("p", "div"))).alias("pos", "s")).drop("blocks")
    first = F.array_position(F.transform("s.inner", lambda b: (b["tag"] == "p") & b["cls"].rlike(r"(^|\s)indent1(\s|$)")), True).cast("int")
    rows = rows.withColumn("_first", first).filter(F.col("_first") > 0)
    rows = rows.withColumn("_n", text.clause_number(text.clean_block(F.get("s.inner", F.col("_first") - 1)["text"]))).filter(F.col("_n").isNotNull())
    rest = F.filter(
        F.transform(F.slice("s.inner", F.col("_first") + 1, F.size("s.inner")), lambda b: F.struct(indent(b).alias("indent"), text.clean_block(b["text"]).alias("text"))),
        lambda x: x["text"] != "",
    )
    rows = rows.withColumn("paragraphs", F.concat(F.array(F.struct(F.lit(1).alias("indent"), F.col("_n.body").alias("text"))), rest))
    rows = rows.withColumn("title", text.strip_parens(text.clean_block(F.col("s.heading")))).withColumn("clause_number", F.col("_n.clause_number"))
    full = F.array_join(F.concat(F.array("title"), F.transform("paragraphs", lambda x: x["text"])), "\n")
    return rows.withColumn("full_text", full).drop("s", "_first", "_n", "page_title", "found", "error")


def document_pages(parsed: DataFrame, doc_type: str) -> DataFrame:
    """Rows of the document table from pages (url, fetched_at) of revisions, guidelines or written replies; error instead of content."""
    b, u, lines, title = F.col("blocks"), F.col("url"), F.col("_lines"), F.col("_title")
    shown = F.transform(F.filter(b, lambda x: x["tag"].isin("p", "h2", "h3")), lambda x: F.struct((x["tag"] == "p").alias("p"), text.clean_line(x["text"]).alias("t")))
    kept = F.filter("_shown", lambda x: ~x["t"].isin("", *SKIP_TEXTS) | (~x["p"] & (x["t"] != "")))
    made = parsed.withColumns({"_shown": shown, "_title": page_heading(b)}).withColumn("_kept", kept)
    made = made.withColumn("_lines", F.transform(F.filter("_kept", lambda x: x["p"]), lambda x: x["t"]))
    body = F.transform("_kept", lambda x: F.when(x["p"], x["t"]).otherwise(F.concat(F.lit("【"), x["t"], F.lit("】")))) if doc_type != "kaisei" else lines
    keys = {
        "kaisei": (urls.revision_id(u), urls.revision_taxonomy(u)),
        "jimu-unei": (urls.guideline_id(u), urls.guideline_taxonomy(u)),
        "bunshokaitou": (urls.reply_id(u), urls.reply_taxonomy(u)),
    }[doc_type]
    issued = F.coalesce(dates.era_date(F.coalesce(F.get(lines, 0), F.lit(""))), dates.era_date(title), dates.folder_date(u))
    first = F.slice(lines, 1, 6 if doc_type == "kaisei" else 8)
    named = F.get(F.filter(first, lambda p: p.rlike(text.ISSUER_MARKS)), 0)
    issuer = urls.reply_issuer(named, u) if doc_type == "bunshokaitou" else text.issuer(first)
    df = made.select(
        F.lit(doc_type).alias("doc_type"), F.coalesce(keys[0], F.lit("")).alias("doc_id"), keys[1].alias("taxonomy"), title.alias("title"), issued.alias("issued_at"), issuer.alias("issuer"),
        u.alias("source_url"), "fetched_at", text.normalize_text(F.array_join(body, "\n")).alias("full_text"), attached_pdfs(b).alias("attached_pdfs"),
        F.coalesce("error", F.when(title.isNull(), F.lit("no title"))).alias("error"),
    )
    return with_hash(df)


def with_hash(df: DataFrame) -> DataFrame:
    from ..functions.quality import document_hash

    return df.withColumn("content_hash", document_hash(F.col("doc_type"), F.col("doc_id"), F.coalesce("title", F.lit("")), F.col("full_text")))


def tax_answers(parsed: DataFrame) -> DataFrame:
    """Tax answers: number, title, effective_date, tax_category, sections, and the document columns."""
    b = F.col("blocks")
    heading = page_heading(b)
    numbered = heading.rlike(r"^No\.\s*\d+")
    title = F.when(numbered, F.regexp_extract(heading, r"^No\.\s*(\d+)\s*(.*)$", 2)).otherwise(heading)
    effective = F.get(F.filter(texts(b, "p"), lambda t: t.rlike(r"^\[.+\]$")), 0)
    sections = F.filter(
        F.transform(under_headings(b), lambda s: F.struct(text.clean_line(s["heading"]).alias("heading"), F.filter(F.transform(s["inner"], lambda x: text.clean_line(x["text"])), lambda t: t != "").alias("paragraphs"))),
        lambda s: (s["heading"] != "") & ~s["heading"].startswith("サイトマップ") & ~s["heading"].startswith("お問い合わせ先") & (F.size(s["paragraphs"]) > 0),
    )
    df = parsed.withColumn("_s", sections).withColumn("effective_date", F.regexp_extract(effective, r"^\[(.+)\]$", 1)).withColumn("title", title)
    df = df.withColumn("number", F.when(numbered, F.regexp_extract(heading, r"^No\.\s*(\d+)", 1)).otherwise(""))
    df = df.withColumn("tax_category", F.get(F.filter("_s", lambda s: s["heading"] == "対象税目"), 0)["paragraphs"][0])
    df = df.withColumn("sections", F.filter("_s", lambda s: s["heading"] != "対象税目"))
    body = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("【"), s["heading"], F.lit("】\n"), F.array_join(s["paragraphs"], "\n"))), "\n\n")
    df = df.select(
        F.lit("tax-answer").alias("doc_type"), F.col("number").alias("doc_id"), F.regexp_extract("url", r"/taxanswer/([^/]+)/", 1).alias("taxonomy"), "title",
        dates.era_date(F.col("effective_date")).alias("issued_at"), F.lit(None).cast("string").alias("issuer"), F.col("url").alias("source_url"), "fetched_at",
        text.join_blocks(F.col("title"), body).alias("full_text"), attached_pdfs(b).alias("attached_pdfs"), "error", "effective_date", "tax_category", "sections",
    )
    return with_hash(df)


def qa_cases(parsed: DataFrame) -> DataFrame:
    """Question-and-answer cases: topic, category and number from the URL, question, answer, related_laws, and the document columns."""
    b = F.col("blocks")
    at = lambda i: F.regexp_extract("url", r"/shitsugi/([^/]+)/(\d+)/(\d+)\.htm", i)

    def part(marker: str) -> Column:
        found = F.get(F.filter(under_headings(b), lambda s: F.contains(s["heading"], F.lit(marker))), 0)
        return F.coalesce(F.filter(F.transform(found["inner"], lambda x: text.clean_line(x["text"])), lambda t: t != ""), F.array().cast("array<string>"))

    df = parsed.withColumns({"question": part("【照会要旨】"), "answer": part("【回答要旨】"), "related_laws": part("【関係法令通達】"), "title": page_heading(b)})
    body = text.join_blocks(F.col("title"), *[text.headed(h, F.col(c)) for h, c in (("照会要旨", "question"), ("回答要旨", "answer"), ("関係法令通達", "related_laws"))])
    df = df.select(
        F.lit("qa-jirei").alias("doc_type"), F.concat_ws("/", at(1), at(2), at(3)).alias("doc_id"), at(1).alias("taxonomy"), "title", F.lit(None).cast("string").alias("issued_at"), F.lit(None).cast("string").alias("issuer"),
        F.col("url").alias("source_url"), "fetched_at", body.alias("full_text"), attached_pdfs(b).alias("attached_pdfs"), "error", at(2).alias("category"), at(3).alias("number"), "question", "answer", "related_laws",
    )
    return with_hash(df)


# The links that each kind of index lists.
INDEX_LINKS = {
    "kaisei": r"/kaisei/[^/]+/index\.htm$",
    "jimu-unei": r"/jimu-unei/.+/(index|01)\.htm$",
    "bunshokaitou-main": r"/bunshokaito/[^/]+/[^/]*\.htm$",
    "bunshokaitou": r"/law/bunshokaito/.+/index\.htm$|/about/organization/[^/]+/bunshokaito/.+\.htm$",
    "tax-answer": r"/taxanswer/[^/]+/\d+\.htm$",
    "qa-jirei": r"/shitsugi/[^/]+/\d+/\d+\.htm$",
}


def index_links(parsed: DataFrame, kind: str) -> DataFrame:
    """page columns, pos, url, title, issued_at of the entries of index pages, the first of each URL.

    The main index of written replies keeps the first link of each taxonomy.
    """
    rows = parsed.select(*[F.col(c).alias("page_url" if c == "url" else c) for c in parsed.columns if c not in ("blocks", "page_title", "found", "error")], F.posexplode(all_links(F.col("blocks"))).alias("pos", "x"))
    rows = rows.filter(F.col("x.url").rlike(INDEX_LINKS[kind]) & (F.col("x.text") != ""))
    if kind == "jimu-unei":
        rows = rows.filter(~F.col("x.url").contains("/kaisei/"))
    rows = rows.withColumns({"url": F.col("x.url"), "title": F.col("x.text"), "issued_at": dates.era_date(F.col("x.text"))}).drop("x")
    if kind != "bunshokaitou-main":
        return rows
    w = Window.partitionBy("page_url", "taxonomy").orderBy("pos")
    rows = rows.withColumn("taxonomy", F.regexp_extract("url", r"/bunshokaito/([^/]+)/", 1))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


# Headings of tables of contents.
CHAPTER, SECTION, SUBSECTION, PART = (rf"^第[0-9０-９]+(の[0-9０-９]+)?{x}" for x in "章節款編")


def contents(parsed: DataFrame, style: Column) -> DataFrame:
    """Tables of contents to rows: url, style, chapter_number, chapter_title, section_number, section_title, subsection, section_url.

    One row per linked section or subsection.  Labels are carried down the
    page by windows; chapters are numbered densely, chapters without links
    do not count, and a URL counts once in its chapter (once in the page for
    the sozoku style, whose entries get group labels in their titles).
    """
    rows = parsed.filter("found").select("url", style.alias("style"), F.posexplode("blocks").alias("pos", "b"))
    rows = rows.withColumn("t", text.clean_line(F.col("b.text")))
    cls = F.coalesce("b.cls", F.lit(""))
    centred = cls.rlike(r"(^|\s)center(\s|$)") | (F.col("b.align") == "center")
    is_chapter = (
        F.when(F.col("style") == "shohi", (F.col("b.tag") == "p") & F.col("b.strong").isNotNull() & F.col("t").rlike(CHAPTER))
        .when(F.col("style") == "shotoku", (F.col("b.tag") == "h3") & F.col("t").rlike(CHAPTER))
        .when(F.col("style") == "hojin", (F.col("b.tag") == "h2") & F.col("t").rlike(f"{CHAPTER}|^附則"))
        .otherwise((F.col("b.tag") == "p") & F.coalesce(centred, F.lit(False)) & F.col("t").rlike(CHAPTER))
    )
    is_part = (F.col("style") == "shotoku") & (F.col("b.tag") == "h2") & F.col("t").rlike(PART)
    is_section = F.when(F.col("style") == "shohi", cls.rlike("indent2") & F.col("t").rlike(SECTION)).when(F.col("style") == "sozoku", F.coalesce(centred, F.lit(False)) & F.col("t").rlike(SECTION)).otherwise(F.lit(False))
    group = F.when((F.col("style") == "sozoku") & cls.rlike("indent1") & F.col("t").rlike("(第[0-9０-９]+|第[0-9０-９]+条|関係)$"), F.col("t")).when(
        (F.col("style") == "sozoku") & (cls == "") & F.col("b.align").isNull() & F.col("b.strong").rlike("関係$"), text.clean_line(F.col("b.strong"))
    )
    w = Window.partitionBy("url").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = lambda test, value: F.last(F.when(test, value), ignorenulls=True).over(w)
    rows = rows.withColumns({"_ch": F.coalesce(F.sum(F.when(is_chapter, 1)).over(w), F.lit(0)), "_cht": carry(is_chapter, F.col("t")), "_part": carry(is_part, F.col("t")), "_sec": carry(is_section, F.struct("pos", "t")), "_grp": carry(group.isNotNull(), F.struct("pos", group.alias("t"))), "_chp": carry(is_chapter, F.col("pos"))})
    rows = rows.filter(~is_chapter & ~is_part).select("url", "style", "pos", "t", "_ch", "_cht", "_part", "_sec", "_grp", "_chp", F.posexplode("b.links").alias("i", "x"))
    rows = rows.withColumn("section_url", F.regexp_replace("x.url", "#.*$", "")).filter(F.col("section_url").rlike(r"\.html?$"))
    scope = F.when(F.col("style") == "sozoku", F.lit(0)).otherwise(F.col("_ch"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("url", scope, "section_url").orderBy("pos", "i"))).filter("_r = 1")
    by_page = Window.partitionBy("url").orderBy("_ch")
    rows = rows.withColumn("chapter_number", F.dense_rank().over(by_page))
    counted = F.when(F.col("style") == "sozoku", F.lit(0)).otherwise(F.col("_ch"))
    rows = rows.withColumn("section_number", F.row_number().over(Window.partitionBy("url", counted).orderBy("pos", "i")))
    label = text.clean_line(F.col("x.text"))
    fresh = lambda c: F.when(F.col(f"{c}.pos") > F.coalesce("_chp", F.lit(-1)), F.col(f"{c}.t"))
    grp = F.when(F.col("_grp.pos") > F.greatest(F.coalesce("_chp", F.lit(-1)), F.coalesce("_sec.pos", F.lit(-1))), F.col("_grp.t"))
    title = F.when(F.col("style") == "sozoku", F.concat_ws(" / ", fresh("_sec"), grp, label)).when(F.col("style") == "shohi", F.coalesce(F.when(F.col("t").rlike(f"{SECTION}|{SUBSECTION}"), F.col("t")), label)).otherwise(label)
    chapter = F.coalesce(F.when(F.col("style") == "shotoku", F.concat_ws(" ", "_part", "_cht")).otherwise(F.col("_cht")), F.lit("（章未指定）"))
    sub = (F.col("style") == "shohi") & F.col("t").rlike(SUBSECTION)
    return rows.select("url", "style", "chapter_number", chapter.alias("chapter_title"), "section_number", title.alias("section_title"), sub.alias("subsection"), F.when(sub, F.col("_sec.t")).alias("of_section"), "section_url")


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, link, host of all links of whole pages."""
    parsed = parse(pages.select("page_id", "url", "html"))
    host = F.regexp_extract("x.url", r"^[a-z]+://([^/?#]+)", 1)
    return parsed.select("page_id", F.posexplode(all_links(F.col("blocks"))).alias("pos", "x")).select("page_id", "pos", F.col("x.url").alias("link"), host.alias("host"))


def outline(pages: DataFrame) -> DataFrame:
    """page_id, page_title, heading, n_blocks, sections, text of whole pages."""
    parsed = parse(pages.select("page_id", "url", "html"))
    b = F.col("blocks")
    return parsed.select("page_id", text.clean_line(F.col("page_title")).alias("page_title"), page_heading(b).alias("heading"), F.size(b).alias("n_blocks"), F.size(under_headings(b)).alias("n_sections"), F.array_join(texts(b, "p", "h1", "h2", "h3", "li", "div"), "\n").alias("text"))


def host_of(url: str) -> str:
    return urlparse(url).netloc
