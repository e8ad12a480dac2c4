"""Normalisation of Japanese regulatory text, as Column -> Column functions.

Nothing here is a Python UDF; every function stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that normalisation maps, and the blanks of ECMAScript's \s.
WIDE = "－～〜０１２３４５６７８９　"
NARROW = "-~~0123456789 "
BLANK_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
BLANKS = "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in BLANK_RANGES) + "]"
WIDE_LETTERS = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ＆"
NARROW_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz&"
DIGIT = "[0-9０-９]"
ISSUER_MARKS = r"殿|国税庁長官|（官印省略）|\(官印省略\)"


def found(value: Column) -> Column:
    """Null instead of the empty string that ``regexp_extract`` gives for no match."""
    return F.when(value != "", value)


def trim_blanks(s: Column) -> Column:
    return F.regexp_replace(s, f"^{BLANKS}+|{BLANKS}+$", "")


def normalize_text(s: Column) -> Column:
    """Full-width hyphen, tilde, digits and blank to ASCII; the rest stays."""
    # translate works character by character, so it is kept for texts that need it
    return F.when(s.rlike(f"[{WIDE}]"), F.translate(s, WIDE, NARROW)).otherwise(s)


def normalize_key(s: Column) -> Column:
    """A clause number for comparison: normalised, without blanks."""
    return F.regexp_replace(normalize_text(s), BLANKS, "")


def normalize_query(s: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_text(s), f"{BLANKS}+", " "))


def clean_line(s: Column) -> Column:
    """One line: runs of blanks become one."""
    return F.trim(F.regexp_replace(s, f"{BLANKS}+", " "))


def clean_block(s: Column) -> Column:
    """Several lines: blanks collapse, line ends stay, two in a row at most."""
    s = F.regexp_replace(F.replace(s, F.lit("　"), F.lit(" ")), r"[ \t]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\n +", "\n"), r" +\n", "\n")
    return trim_blanks(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def strip_parens(s: Column) -> Column:
    """Without one pair of outer parentheses, full or half width."""
    t = trim_blanks(s)
    wide, narrow = r"(?s)^（(.*)）$", r"(?s)^\((.*)\)$"
    inner = F.when(t.rlike(wide), F.regexp_extract(t, wide, 1)).when(t.rlike(narrow), F.regexp_extract(t, narrow, 1))
    return F.coalesce(trim_blanks(inner), t)


def clause_number(s: Column) -> Column:
    """Struct clause_number, body from the text of a clause's first paragraph; null if it has no number.

    Three shapes, tried in order: articles joined by a middle dot before a shared
    number, a range of articles before a shared number, and plain hyphenated
    numbers.
    """
    part = f"{DIGIT}+(?:の{DIGIT}+)?"
    shapes = (
        f"{part}(?:・{part})+共[-－]{part}",
        f"{DIGIT}+[〜ー～]{DIGIT}+共[-－]{part}",
        f"{part}(?:[-－]{part})+",
    )
    t = F.regexp_replace(s, f"^{BLANKS}+", "")
    whole = [rf"(?s)^({x})[\s　]*(.*)$" for x in shapes]
    number = F.coalesce(*[found(F.regexp_extract(t, rx, 1)) for rx in whole])
    body = F.coalesce(*[F.when(t.rlike(rx), F.regexp_extract(t, rx, 2)) for rx in whole])
    return F.when(number.isNotNull(), F.struct(normalize_key(number).alias("clause_number"), trim_blanks(body).alias("body")))


def parse_clause_number(s: Column) -> Column:
    """Struct chapter, section, article of a three-level number; null for other text."""
    t = trim_blanks(s)
    rx = r"^(\d+)-(\d+)-(\d+(?:の\d+)?)$"
    at = lambda i: F.regexp_extract(t, rx, i)
    return F.when(t.rlike(rx), F.struct(at(1).try_cast("int").alias("chapter"), at(2).try_cast("int").alias("section"), at(3).alias("article")))


def issuer(paragraphs: Column) -> Column:
    """The paragraphs that name a sender or addressee, joined by line ends; null if none."""
    lines = F.filter(paragraphs, lambda p: p.rlike(ISSUER_MARKS))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def digits_to_int(s: Column) -> Column:
    return F.translate(s, WIDE, NARROW).try_cast("int")


def pad2(s: Column) -> Column:
    """Left-padded with zeros to two characters; longer text stays."""
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def join_blocks(*parts: Column) -> Column:
    """Non-empty blocks joined by an empty line, then normalised."""
    return normalize_text(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n\n"))


def headed(heading: str, lines: Column) -> Column:
    """A block of lines under a bracketed heading; empty without lines."""
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"【{heading}】\n"), F.array_join(lines, "\n"))).otherwise(F.lit(""))


def sections(full_text: Column) -> Column:
    """The headed blocks of a text that ``join_blocks`` and ``headed`` made: array of struct heading, paragraphs; empty without any."""
    blocks = F.filter(F.split(full_text, r"\n\n(?=【[^】\n]+】\n)"), lambda b: b.rlike(r"^【[^】\n]+】\n"))
    parts = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, "^【([^】]+)】", 1).alias("heading"), F.split(F.regexp_replace(b, r"^【[^】]+】\n", ""), "\n+").alias("paragraphs")))
    return F.coalesce(parts, F.array().cast("array<struct<heading:string,paragraphs:array<string>>>"))
