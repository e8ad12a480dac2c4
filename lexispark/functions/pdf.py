"""Attached PDF files: size, kind, order and reading hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind
from .text import BLANKS, NARROW_LETTERS, WIDE_LETTERS, normalize_text

PDF = "struct<title:string,url:string,size_kb:int,kind:string>"

# Kinds in the order in which their patterns are tried; each kind's label, mark, tool and note.
KIND_PATTERNS = (
    ("comparison", "新旧対(照|応)表|対比表"),
    ("qa-pdf", "(?i)Q&A|質疑応答|FAQ"),
    ("attachment", "別紙|別表|様式|付録|添付資料"),
    ("notice", "通知|お知らせ|連絡"),
    ("related", "参考|関連資料"),
)
KIND_ORDER = ("comparison", "attachment", "qa-pdf", "related", "notice", "unknown")
KIND_LABELS = {"comparison": "🔄 新旧対照表", "attachment": "📎 別紙・別表", "qa-pdf": "❓ Q&A", "related": "📚 参考資料", "notice": "📢 通知・連絡", "unknown": "📄 その他"}
KIND_TOOLS = {"comparison": "extract_tables", "attachment": "extract_tables", "qa-pdf": "read_text", "related": "read_text", "notice": "read_text", "unknown": "read_text"}
KIND_NOTES = {
    "comparison": "extract_tables で改正後/改正前の差分を表として抽出するのが最優先。失敗時は read_text に fallback。",
    "attachment": "extract_tables で表組みの別紙・別表・様式を構造化抽出。本文ベースで読みたい時は read_text を併用。",
    "qa-pdf": "read_text で全文を取得し、Q/A の流れを読む。",
    "related": "read_text で全文を取得。文脈次第で読むか判断。",
    "notice": "read_text で連絡内容を確認。LLM 要約には通常含めない。",
    "unknown": "read_text で先頭ページをサンプリングし、内容を把握する。",
}
SIZE = r"(?i)PDF[^/]*/\s*([0-9,.]+)\s*(KB|MB)"


def size_kb(text: Column) -> Column:
    """Whole KB of a link text such as (PDF/1,594KB) or (PDF/1.18MB); null if it states none."""
    n = F.regexp_replace(F.regexp_extract(text, SIZE, 1), ",", "")
    n = F.regexp_extract(n, r"^[0-9]*\.?[0-9]*", 0).try_cast("double")
    unit = F.upper(F.regexp_extract(text, SIZE, 2))
    return F.when(text.rlike(SIZE), F.floor(F.when(unit == "MB", n * 1024).otherwise(n) + 0.5).cast("int"))


def kind(title: Column) -> Column:
    plain = F.regexp_replace(F.translate(normalize_text(F.coalesce(title, F.lit(""))), WIDE_LETTERS, NARROW_LETTERS), BLANKS, "")

    def tried(t: Column) -> Column:
        out = F.lit("unknown")
        for name, rx in reversed(KIND_PATTERNS):
            out = F.when(t.rlike(rx), F.lit(name)).otherwise(out)
        return out

    return bind(plain, tried)


def priority(k: Column) -> Column:
    """Rank of a kind, from 0; unknown kinds come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in KIND_ORDER]), F.coalesce(k, F.lit("unknown")))
    return F.when(at > 0, at - 1).otherwise(len(KIND_ORDER) - 1).cast("int")


def fill_kinds(pdfs: Column) -> Column:
    return F.transform(pdfs, lambda p: p.withField("kind", F.coalesce(p["kind"], kind(p["title"]))))


def by_priority(pdfs: Column) -> Column:
    """Sorted by kind, equal kinds in their order."""
    tagged = F.transform(pdfs, lambda p, i: F.struct(priority(p["kind"]).alias("rank"), i.alias("i"), p.alias("pdf")))
    return F.transform(F.array_sort(tagged), lambda x: x["pdf"])


def hints(pdfs: Column) -> Column:
    """One example per kind, its first file: array of struct kind, tool, url."""
    firsts = bind(fill_kinds(pdfs), lambda a: F.filter(a, lambda p, i: ~F.exists(F.slice(a, 1, i), lambda q: q["kind"] == p["kind"])))
    tools = F.create_map(*[F.lit(x) for kv in KIND_TOOLS.items() for x in kv])
    return F.transform(by_priority(firsts), lambda p: F.struct(p["kind"].alias("kind"), F.element_at(tools, p["kind"]).alias("tool"), p["url"].alias("url")))


def noted_hints(pdfs: Column) -> Column:
    """``hints`` with a note on how to read each kind."""
    notes = F.create_map(*[F.lit(x) for kv in KIND_NOTES.items() for x in kv])
    return F.transform(hints(pdfs), lambda h: h.withField("note", F.element_at(notes, h["kind"])))
