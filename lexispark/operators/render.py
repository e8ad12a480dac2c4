"""Markdown renderings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import pdf

RULE = "---"


def clause(number: Column, title: Column, paragraphs: Column) -> Column:
    """A heading and paragraphs; deeper indents are deeper quotes."""
    quoted = F.transform(paragraphs, lambda p: F.concat(F.when(p["indent"] >= 3, "> > ").when(p["indent"] == 2, "> ").otherwise(""), p["text"], F.lit("\n")))
    return F.concat(F.lit("## "), number, F.lit("（"), title, F.lit("）\n\n"), F.array_join(quoted, "\n"))


def source(url: Column, fetched_at: Column, note: str = "") -> Column:
    lines = F.array_compact(F.array(F.lit(RULE), F.concat(F.lit("出典: "), url), F.when(F.coalesce(fetched_at, F.lit("")) != "", F.concat(F.lit("取得: "), fetched_at)), F.lit(f"\n> {note}") if note else F.lit(None).cast("string")))
    return F.array_join(lines, "\n")


def clause_page(number: Column, title: Column, paragraphs: Column, url: Column, fetched_at: Column, note: str = "") -> Column:
    return F.concat_ws("\n", clause(number, title, paragraphs), source(url, fetched_at, note))


def section_page(section_title: Column, chapter_title: Column, clauses: Column, url: Column, fetched_at: Column, note: str = "") -> Column:
    """``clauses``: array of struct clause_number, title, paragraphs."""
    head = F.concat(F.lit("# "), section_title, F.lit("\n"), F.coalesce(F.concat(F.lit("\n**"), chapter_title, F.lit("**\n")), F.lit("")))
    body = F.array_join(F.transform(clauses, lambda c: clause(c["clause_number"], c["title"], c["paragraphs"])), "\n")
    return F.concat_ws("\n", head, body, source(url, fetched_at, note))


def _parts(sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), F.array_join(s["paragraphs"], "\n\n"), F.lit("\n"))), "\n")


def tax_answer(number: Column, title: Column, effective: Column, category: Column, sections: Column, url: Column, fetched_at: Column, note: str = "") -> Column:
    facts = F.array_join(F.array_compact(F.array(F.concat(F.lit("法令時点: "), effective), F.concat(F.lit("対象税目: "), category))), "\n")
    return F.concat_ws("\n", F.concat(F.lit("# No."), number, F.lit(" "), title, F.lit("\n")), facts, F.lit(""), _parts(sections), source(url, fetched_at, note))


def qa_case(title: Column, question: Column, answer: Column, laws: Column, url: Column, fetched_at: Column, note: str = "") -> Column:
    part = lambda h, c: F.struct(F.lit(h).alias("heading"), c.alias("paragraphs"))
    sections = F.filter(F.array(part("【照会要旨】", question), part("【回答要旨】", answer), part("【関係法令通達】", laws)), lambda s: F.size(s["paragraphs"]) > 0)
    return F.concat_ws("\n", F.concat(F.lit("# "), title, F.lit("\n")), _parts(sections), source(url, fetched_at, note))


def document(title: Column, taxonomy: Column, issued_at: Column, issuer: Column, full_text: Column, pdfs: Column, url: Column, fetched_at: Column, note: str = "") -> Column:
    facts = F.array_join(F.array_compact(F.array(F.concat(F.lit("- 税目: "), taxonomy), F.concat(F.lit("- 発出日: "), issued_at), F.concat(F.lit("- 発出者: "), issuer))), "\n")
    return F.concat_ws("\n", F.concat(F.lit("# "), title, F.lit("\n")), facts, F.lit(""), full_text, attached(pdfs), source(url, fetched_at, note))


def attached(pdfs: Column) -> Column:
    """Table of attached files by kind, and one reading example per kind; null without files."""
    filled = pdf.by_priority(pdfs)
    labels = F.create_map(*[F.lit(x) for kv in pdf.KIND_LABELS.items() for x in kv])
    size = lambda p: F.when(F.coalesce(p["size_kb"], F.lit(0)) > 0, F.concat(p["size_kb"].cast("string"), F.lit("KB"))).otherwise(F.lit("—"))
    row = lambda p: F.concat(F.lit("| "), F.element_at(labels, F.coalesce(p["kind"], F.lit("unknown"))), F.lit(" | "), F.replace(p["title"], F.lit("|"), F.lit("\\|")), F.lit(" | "), size(p), F.lit(" | [link]("), p["url"], F.lit(") |"))
    example = lambda h: F.concat(F.lit('{ "tool": "'), h["tool"], F.lit('", "args": { "url": "'), h["url"], F.lit('" } }'))
    head = F.concat(F.lit("## 添付 PDF ("), F.size(pdfs).cast("string"), F.lit(" 件)\n\n| 種別 | タイトル | サイズ | URL |\n| --- | --- | --- | --- |\n"))
    out = F.concat(head, F.array_join(F.transform(filled, row), "\n"), F.lit("\n\n```json\n"), F.array_join(F.transform(pdf.hints(filled), example), "\n"), F.lit("\n```"))
    return F.when(F.size(pdfs) > 0, out)


def search_hit(title: Column, snippet: Column, url: Column) -> Column:
    return F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(") "), snippet)
