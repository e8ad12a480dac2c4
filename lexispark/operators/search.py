"""Full-text search: substring terms of three characters or more, exact BM25.

A term hits as a substring, case-folded, overlapping hits count.  All terms of a
query must hit, each in any indexed column.  Rank is minus BM25 (k1 1.2, b 0.75)
with lengths in trigrams; document frequencies, the number of rows and the
average length are those of the whole index, before any filter.  Terms below
three characters never hit and empty the result.

Two strategies give the same rows.  ``scan`` counts the terms of one query in
the texts, one pass without an index.  ``postings`` answers a table of queries from
positional trigrams, made for them or kept in step with a table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, NARROW, WIDE
from . import snippets

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
LIMIT, MAX_LIMIT = 10, 50
SNIPPET = 18
MARKS = re.compile(r'[\r\n\t"*:()]')


def query_terms(raw: str) -> list[str]:
    """Terms of a query; none if fewer than two characters are left after normalisation."""
    text = raw.translate(str.maketrans(WIDE, NARROW))
    text = MARKS.sub(" ", re.sub(f"{BLANKS}+", " ", text)).strip()
    return text.split() if len(text) >= 2 else []


def clamp_limit(limit: int | None) -> int:
    return min(max(LIMIT if limit is None else limit, 1), MAX_LIMIT)


def hit_count(text: Column, term: Column) -> Column:
    """Overlapping occurrences of a folded term in a folded text."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.contains(text, term), F.regexp_count(text, quoted)).otherwise(0)


def trigrams(text: Column) -> Column:
    return F.greatest(F.length(text) - 2, F.lit(0))


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def term_score(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def first_hit(text: Column, term: str) -> Column:
    """Without leaving the JVM, for any number of rows: ``SNIPPET`` characters from the first hit of a term, the hit in bold, dots where the text is cut."""
    at = F.locate(term.lower(), F.lower(text))
    size = len(term)
    tail = F.substring(text, at + size, F.lit(max(SNIPPET - size, 0)))
    end = at + max(SNIPPET, size)
    shown = F.concat(
        F.when(at > 1, F.lit(" … ")).otherwise(F.lit("")), F.lit("<b>"), F.substring(text, at, F.lit(size)), F.lit("</b>"), tail,
        F.when(end <= F.length(text), F.lit(" … ")).otherwise(F.lit("")),
    )
    return F.when(at > 0, shown).otherwise(F.substring(text, 1, SNIPPET))


def scan(rows: DataFrame, keyword: str, key: str, columns: tuple[str, ...], keep: Column | None = None, limit: int | None = None, short_terms: bool = False) -> DataFrame:
    """The best rows for one query: all columns of ``rows`` with rank and snippet (of the last column), in the order of (rank, key).

    ``keep`` filters after the statistics are taken.  ``short_terms`` lets terms
    of one or two characters hit as substrings, too.
    """
    terms = query_terms(keyword)
    if not terms or (not short_terms and any(len(t) < 3 for t in terms)):
        return rows.withColumns({"rank": F.lit(0.0), "snippet": F.lit("")}).limit(0)
    tfs = {f"_tf{i}": sum((hit_count(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t.lower())) for c in columns), F.lit(0)) for i, t in enumerate(terms)}
    length = sum((trigrams(F.coalesce(F.col(c), F.lit(""))) for c in columns), F.lit(0))
    counted = rows.withColumns({**tfs, "_len": length})
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    hits = counted
    for i in range(len(terms)):
        hits = hits.filter(F.col(f"_tf{i}") > 0)
    if keep is not None:
        hits = hits.filter(keep)
    hits = hits.crossJoin(F.broadcast(stats))  # one row
    score = sum((term_score(F.col(f"_tf{i}"), F.col(f"_df{i}"), F.col("_n"), F.col("_len"), F.col("_mean")) for i in range(len(terms))), F.lit(0.0))
    best = hits.select(*rows.columns, (-score).alias("rank")).orderBy("rank", key).limit(clamp_limit(limit))
    return best.withColumn("snippet", snippets.snippet(F.col(columns[-1]), F.lit(terms)))
