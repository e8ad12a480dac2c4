"""Spelling variant grouping with PartEnum signatures.

A word is a binary vector over (letter, how-manieth): words one edit apart differ
in at most two of its places, as an edit takes one letter, adds one, or both.  The
letters are dealt to ``parts`` parts; two differences leave all but two parts alone,
so two such words agree on some choice of parts - 2 parts, and every such choice is
an exact signature.  Anagrams agree on all of them, so a signature also holds the
half of the word that one edit leaves alone: of the shorter word's letters at least
half stand at the front, or half at the end, of both.  Signatures are joined for
equality and every pair that meets is verified by its edit distance.

Words are counted in tasks document by document, then summed.  Forms are followed
by doubling the steps, each round written to the shared folder.

Edge cases: null and blank texts have no words; a null doc_id counts as an empty
string where runs are hashed; repeated rows count each time; ties go to the smallest
word in code-point order; an empty table gives no rows; other columns are ignored;
a text of any length is read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

RUN = re.compile("[a-zÀ-ÿ]+")


@dataclass(frozen=True)
class SpellingParams:
    #: least code points and occurrences of a word
    min_chars: int = 5
    min_count: int = 3
    #: a form has at least so many times the word's occurrences
    ratio: int = 2
    parts: int = 4
    #: one in so many (document, run) pairs loses a letter before it is counted; None: none
    drop_every: int | None = None
    #: different words that a task counts before it sends them on
    hold: int = 300_000


def shortened(doc_id: object, run: str, every: int) -> str:
    """``run``, or without one letter where the hash of document and run says so."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, params: SpellingParams | None = None) -> DataFrame:
    """word, n: the words of all texts with their occurrences, those of enough letters and occurrences."""
    p = params or SpellingParams()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                runs = Counter(RUN.findall((text.as_py() or b"").lower().decode("utf-8", "replace")))
                for run, n in runs.items():
                    word = shortened(doc_id, run, p.drop_every) if p.drop_every else run
                    if len(word) >= p.min_chars:
                        held[word] += n
                if len(held) >= p.hold:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.min_count)


def letter_parts(word: Column, parts: int) -> list[Column]:
    """The letters of each part, sorted: equal strings are equal parts of the letter multiset."""
    letters = F.array_sort(F.split(word, ""))

    def own(part: int) -> Column:
        return F.array_join(F.filter(letters, lambda x: (x != "") & (F.pmod(F.ascii(x), F.lit(parts)) == part)), "")

    return [own(i) for i in range(parts)]


def signatures(words: DataFrame, p: SpellingParams) -> DataFrame:
    """word, n, long and key for every signature; long: as the longer one of a pair whose words differ in length."""
    kept = list(combinations(range(p.parts), p.parts - 2))
    cut = words.select("word", "n", *[x.alias(f"_p{i}") for i, x in enumerate(letter_parts(F.col("word"), p.parts))])
    shorter = cut.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("long")).withColumn("least", F.length("word") - F.col("long").cast("int"))
    half = F.floor(F.col("least") / 2).cast("int")
    halves = (F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.length("word") - half + 1, half))
    keys = [F.xxhash64("least", F.lit(side), F.lit(i), h, *[F.col(f"_p{k}") for k in own]) for side, h in enumerate(halves) for i, own in enumerate(kept)]
    return shorter.select("word", "n", "long", F.explode(F.array(*keys)).alias("key"))


def near_pairs(words: DataFrame, params: SpellingParams | None = None) -> DataFrame:
    """a, a_n, b, b_n: all pairs of words that differ by one inserted, deleted or replaced code point, once."""
    p = params or SpellingParams()
    entries = signatures(words, p)
    one = entries.filter(~F.col("long")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = entries.select("key", "long", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = one.join(other, "key").filter((F.col("long") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """word, root for each row of ``forms`` (word, form): the last word that the forms lead to."""
    current = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = current.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = current.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        following = stored(step, "forms")
        drop_stored(current)
        current = following.select("word", "root")
        if following.filter("moved").isEmpty():
            return current


def group_words(words: DataFrame, params: SpellingParams | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of ``words`` (word, n; words are unique).

    form: the near word of largest n, if that is ``ratio`` times the word's n at
    least; root: where the forms lead, the word itself without one.
    """
    p = params or SpellingParams()
    pairs = near_pairs(words, p)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    far = -F.col("best.m") >= p.ratio * F.col("n")
    joined = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.other")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"),
    )
    found = stored(joined, "spelling")
    roots = followed(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, params: SpellingParams | None = None) -> DataFrame:
    """``group_words`` of the words of ``docs`` (doc_id, text)."""
    p = params or SpellingParams()
    return group_words(stored(word_counts(docs, p), "words"), p)
