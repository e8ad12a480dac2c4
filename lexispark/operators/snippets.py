"""Snippets: the window of a text that shows a query best.

A window is ``WINDOW`` consecutive trigrams, 18 characters.  One is tried from every
hit, moved so that its hits stand in the middle, and one from the start of the hit's
sentence.  The first hit of a term in a window counts 1000, any other 1, the start of
a sentence 100, that of the text 120.  The highest count wins, of equal ones the earliest.

Texts without a hit show their start; null and empty texts give an empty snippet.
Hits that begin before the window are not marked; those that reach beyond its end are
cut there.  A text costs one search for each term and a short look from each hit, so
very long texts and terms with very many hits are fine.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW = 16
NEW, AGAIN, SENTENCE, TEXT = 1000, 1, 100, 120
OPEN, CLOSE, CUT = "<b>", "</b>", " … "
BREAK = re.compile(r"[.:]([ \t\n\r]+)")


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def sentence_starts(text: str, tokens: int) -> list[int]:
    """0, and each place after a full stop or colon and at least one blank."""
    return [0, *(p for m in BREAK.finditer(text) for p in range(m.start(1) + 1, m.end(1) + 1) if p < tokens)]


def best_start(text: str, hits: list[tuple[int, int]], sizes: list[int]) -> int:
    """Where the window starts; ``hits`` are place and term in order, ``sizes`` the terms' trigrams."""
    tokens = max(len(text) - 2, 0)
    starts = sentence_starts(text, tokens)
    best, found = 0, 0

    def seen(start: int) -> tuple[int, list[tuple[int, int]]]:
        own = hits[bisect_left(hits, (start, 0)) : bisect_left(hits, (start + WINDOW, 0))]
        kinds = len({t for _, t in own})
        return NEW * kinds + AGAIN * (len(own) - kinds), own

    for at, _ in hits:
        score, own = seen(at)
        if score > best:
            end = own[-1][0] + sizes[own[-1][1]]
            best, found = score, max(0, min(at - int((WINDOW - (end - at)) / 2), tokens - WINDOW))
        first = starts[bisect_right(starts, at) - 1]
        if first < at and tokens > WINDOW:
            score = seen(first)[0] + (SENTENCE if first else TEXT)
            if score > best:
                best, found = score, first
    return found


def marked(hits: list[tuple[int, int]], sizes: list[int], start: int) -> list[list[int]]:
    """From and to of the characters in bold: hits with common trigrams are one, and so are those with common characters."""
    runs: list[list[int]] = []
    for at, t in hits:
        if at >= start + WINDOW:
            break
        if runs and at <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], at + sizes[t] - 1)
        else:
            runs.append([at, at + sizes[t] - 1])
    bold: list[list[int]] = []
    for a, z in runs:
        if a < start:
            continue
        a, z = a, min(z, start + WINDOW - 1) + 3
        if bold and a < bold[-1][1]:
            bold[-1][1] = max(bold[-1][1], z)
        else:
            bold.append([a, z])
    return bold


def snippet_of(text: str | None, terms: list[str]) -> str:
    """The snippet of one text for folded terms."""
    text = text or ""
    low = folded(text)
    hits = sorted((m.start(), i) for i, t in enumerate(terms) for m in re.finditer(f"(?={re.escape(t)})", low))
    sizes = [max(len(t) - 2, 1) for t in terms]
    start = best_start(text, hits, sizes)
    end = len(text) if start + WINDOW >= len(text) - 2 else start + WINDOW + 2
    out, at = [CUT if start else ""], start
    for a, z in marked(hits, sizes, start):
        out += [text[at:a], OPEN, text[a : min(z, end)], CLOSE]
        at = min(z, end)
    return "".join([*out, text[at:end], CUT if end < len(text) else ""])


@F.pandas_udf(StringType())
def _snippets(text: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([snippet_of(x, list(t)) for x, t in zip(text, terms, strict=True)], dtype=object)


#: Not deterministic to the optimizer, which else moves it below the limit of a top-k and makes it for every hit.
_after_limit = _snippets.asNondeterministic()


def snippet(text: Column, terms: Column) -> Column:
    """The snippet of a text for an array of terms; meant for the few rows that are shown."""
    return _after_limit(F.coalesce(text, F.lit("")), F.transform(terms, lambda t: F.lower(t)))
