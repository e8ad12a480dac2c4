"""Table schemas, keys and fixed domain values."""

from __future__ import annotations

from .functions.pdf import PDF

SCHEMA_VERSION = 3

#: Columns as DDL, and the key.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "circular": ("id bigint, formal_name string, abbr string, source_root_url string", ("formal_name",)),
    "chapter": ("circular_id bigint, number int, title string", ("circular_id", "number")),
    "section": (
        "circular_id bigint, chapter_number int, section_number int, title string, url string, fetched_at timestamp, content_hash string",
        ("circular_id", "chapter_number", "section_number"),
    ),
    "clause": (
        "id bigint, circular_id bigint, clause_number string, source_url string, chapter_number int, section_number int, title string, full_text string, paragraphs array<struct<indent:int,text:string>>",
        ("circular_id", "clause_number"),
    ),
    "document": (
        f"doc_type string, doc_id string, taxonomy string, title string, issued_at string, issuer string, source_url string, fetched_at timestamp, full_text string, attached_pdfs array<{PDF}>, content_hash string",
        ("doc_type", "doc_id"),
    ),
    "run_history": (
        "doc_type string, ran_at timestamp, total bigint, fetched bigint, failed bigint, new_docs bigint, updated_docs bigint, orphaned_docs bigint, moved_docs bigint, fail_rate double, duration_ms bigint",
        ("doc_type", "ran_at"),
    ),
}

DOC_TYPES = ("kaisei", "jimu-unei", "bunshokaitou", "tax-answer", "qa-jirei")
#: What binds whom: circulars bind the office only, explanatory material binds nobody.
LEGAL_STATUS = {
    "circular": {"binds_citizens": False, "binds_courts": False, "binds_tax_office": True},
    "information": {"binds_citizens": False, "binds_courts": False, "binds_tax_office": False},
}


def legal_status(doc_type: str) -> dict[str, bool]:
    return LEGAL_STATUS["information" if doc_type in ("tax-answer", "qa-jirei") else "circular"]
