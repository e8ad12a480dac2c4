"""Quality rules by distribution divergence (DataFrame functions only).

A document's character-class histogram and its common-word histogram are
compared by Jensen-Shannon distance with references of the languages.  A reference
is the mean over all documents of a language that pass the base rules, and its
common words are the ``n_common`` most frequent words of all its documents, so both
come from the corpus itself, for every language that labels ``min_docs`` documents.

A document is compared with the reference of its own language; if that one is too
far, or the language is null, with all of them, and the nearest decides.

Three passes: the first counts words by language (counts are aggregated before
they are shuffled), the second turns each text into a row of counts (no shuffle) that
is written to the shared folder, the third averages these rows per language and scores
them.  Common words and references are a row per language, which bounds what the
driver sees.

Edge cases: a null text has no words and fails the length rule; null ``lang``
never enters a reference but is scored; a document in a language without a
reference, or shorter than the guard, is kept unless a base rule fails; with no
reference at all every document that passes the base rules is kept; ties between
common words go to the one that sorts first; repeated rows give repeated results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, stored, words, wrapped

#: Character classes; what is in none of them counts as other.
CLASSES = (
    ("lower", r"[a-z]"),
    ("upper", r"[\p{Lu}]"),
    ("accented", r"[\p{L}&&[^a-z\p{Lu}]]"),
    ("digit", r"[0-9]"),
    ("space", r"[\x20\x09-\x0D]"),
    ("stop", r"[.,;:'()-]"),
)


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: guard: histograms of fewer letters say too little
    min_letters: int = 200
    max_class_distance: float = 0.30
    max_word_distance: float = 0.45
    #: most frequent words of a language that make its histogram
    n_common: int = 12
    #: documents that a language needs for a reference
    min_docs: int = 10
    #: parts of a language's words in the first ranking
    salts: int = 32


def repeated_words(ws: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more in ``ws``.

    Windows are compared by 64-bit hashes within one document.  Sorting
    (hash, position) finds the repeats in n log n for any text.
    """

    def covered(g: Column) -> Column:
        # sort_array compares natively, array_sort by an interpreted lambda
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hits = bind(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(s, lambda e, k: F.struct(
                            e["i"].alias("i"),
                            (F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))).alias("twice"),
                        )),
                        lambda e: e["twice"],
                    ),
                    lambda e: e["i"],
                )
            ),
        )
        return bind(
            hits,
            lambda p: F.aggregate(
                F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    grams = bind(
        ws,
        lambda w: F.when(
            F.size(w) >= 4,
            F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0).cast("long")))


def lowered(text: Column) -> Column:
    """Runs of letters in lower case, and empty strings at the ends."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def common_words(docs: DataFrame, p: QualityParams) -> dict[str, list[str]]:
    """The most frequent words of each language with enough documents."""
    labelled = docs.select("lang", "text").filter(F.col("lang").isNotNull())
    enough = labelled.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= p.min_docs)
    seen = labelled.select("lang", F.explode(lowered(F.coalesce("text", F.lit("")))).alias("word")).filter(F.col("word") != "")
    seen = seen.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # a language's words are ranked in parts first, as one may have most of all words
    for part in (F.pmod(F.xxhash64("word"), F.lit(p.salts)), F.lit(0)):
        rank = F.row_number().over(Window.partitionBy("lang", part).orderBy(F.col("n").desc(), "word"))
        seen = seen.withColumn("i", rank).filter(F.col("i") <= p.n_common)
    rows = enough.select("lang").join(seen.select("lang", "i", "word"), "lang", "left").collect()  # n_common rows for each language with a reference
    found: dict[str, list[str]] = {r["lang"]: [] for r in rows}
    for r in sorted((r for r in rows if r["word"] is not None), key=lambda r: (r["lang"], r["i"])):
        found[r["lang"]].append(r["word"])
    return found


def features(docs: DataFrame, vocabulary: list[str], p: QualityParams) -> DataFrame:
    """Counts of each document: base counts, class histogram, the common words it has."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "lang", text.alias("_t")).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    # a column of its own, as two expressions use it
    df = df.withColumn("_l", lowered(F.col("_t")))
    # what few characters are counted of, without the runs of others
    df = df.withColumns({"_marks": F.regexp_replace("_t", r"[^0-9.,;:'()\-#*$%&|<>]+", ""), "_capitals": F.regexp_replace("_t", r"[\x00-@\[-\x7F]+", "")})
    ends = (F.get("_l", 0) == "").cast("int") + ((F.size("_l") > 1) & (F.element_at("_l", -1) == "")).cast("int")  # only they can be empty
    removed = lambda rx: (F.length("_t") - F.length(F.regexp_replace("_t", rx, ""))).cast("long")
    word_chars = F.length(F.array_join("_w", "")).cast("long")
    frequent = {"lower": removed("[a-z]+"), "space": F.length("_t").cast("long") - word_chars}  # words and breaks make a text
    within = {"upper": "_capitals", "accented": "_capitals", "digit": "_marks", "stop": "_marks"}
    counts = [frequent[name] if name in frequent else F.regexp_count(within[name], F.lit(rx)).cast("long") for name, rx in CLASSES]
    df = df.select(
        "doc_id",
        "lang",
        F.size("_w").cast("long").alias("n_words"),
        word_chars.alias("word_chars"),
        F.regexp_count("_marks", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.length("_t").cast("long").alias("_chars"),
        F.array(*counts).alias("_cls"),
        (F.size("_l") - ends).cast("long").alias("_runs"),
        F.filter("_l", lambda w: w.isin(*vocabulary) if vocabulary else F.lit(False)).alias("_common"),
    )
    total = F.aggregate("_cls", F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        df.withColumn("_cls", F.concat("_cls", F.array(F.col("_chars") - total)))
        .withColumn("_letters", F.get("_cls", 0) + F.get("_cls", 1) + F.get("_cls", 2))
        .withColumn(
            "base_failed",
            (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words")),
        )
        .drop("_chars")
    )


def word_counts(of: Column, p: QualityParams) -> Column:
    """How often a document has each of the words ``of`` (fewer than n_common: zeros), and all others."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(p.n_common - 1)), lambda i: bind(F.get(of, i), lambda w: F.size(F.filter("_common", lambda x: x == w)).cast("long")))
    return bind(counts, lambda c: F.concat(c, F.array(F.col("_runs") - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))


def shares(counts: Column) -> Column:
    return bind(
        counts,
        lambda c: bind(
            F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x).cast("double"),
            lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))),
        ),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance in base 2 (0 to 1) of two share arrays of one length."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / ((a + b) / 2))).otherwise(F.lit(0.0))

    divergence = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x) / 2
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def references(feats: DataFrame, common: dict[str, list[str]], p: QualityParams) -> DataFrame:
    """One row: the array of (lang, words, class shares, word shares), means over documents."""
    table = F.from_json(F.lit(json.dumps(common)), "map<string,array<string>>")  # no join: one language may have most rows
    rows = feats.filter(~F.col("base_failed") & (F.col("_letters") >= p.min_letters)).withColumn("_of", F.element_at(table, F.col("lang"))).filter(F.col("_of").isNotNull())
    rows = rows.select("lang", "_of", shares(F.col("_cls")).alias("_c"), shares(word_counts(F.col("_of"), p)).alias("_v"))
    # means of millionths as integers: the sum does not depend on the order of rows
    unit = lambda c, i: F.sum(F.round(F.get(c, i) * 1_000_000).cast("long")) / F.count("*") / 1_000_000
    means = rows.groupBy("lang").agg(
        F.first("_of").alias("of"),
        F.array(*[unit(F.col("_c"), i) for i in range(len(CLASSES) + 1)]).alias("c"),
        F.array(*[unit(F.col("_v"), i) for i in range(p.n_common + 1)]).alias("v"),
    )
    return means.agg(F.array_sort(F.collect_list(F.struct("lang", "of", "c", "v"))).alias("_refs"))


def quality_rules(docs: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """Base counts and the verdict of each document.

    ``docs`` needs doc_id, text and lang.  Returns doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ref_lang (the
    reference that decides; null where the guard applies), class_distance, word_distance.
    """
    p = params or QualityParams()
    common = common_words(docs, p)
    feats = stored(features(docs, sorted({w for ws in common.values() for w in ws}), p), "quality")
    scored = feats.crossJoin(F.broadcast(references(feats, common, p)))  # one row
    judged = F.col("_letters") >= p.min_letters  # a language without a reference is held against all

    def distances(r: Column) -> Column:
        return bind(
            F.struct(js_distance(shares(F.col("_cls")), r["c"]).alias("c"), js_distance(shares(word_counts(r["of"], p)), r["v"]).alias("v")),
            lambda x: F.struct(F.round(x["c"] + x["v"], 6).alias("sum"), r["lang"].alias("lang"), F.round(x["c"], 6).alias("c"), F.round(x["v"], 6).alias("v")),
        )

    far = lambda x: (x["c"] > p.max_class_distance) | (x["v"] > p.max_word_distance)
    own = F.get(F.transform(F.filter("_refs", lambda r: r["lang"] == F.col("lang")), distances), 0)
    near = bind(own, lambda o: F.when(o.isNotNull() & ~far(o), o).otherwise(F.array_min(F.transform("_refs", distances))))
    scored = scored.withColumn("_near", F.when(judged & (F.size("_refs") > 0), near))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far(F.col("_near")), F.lit(False))).alias("kept"),
        F.col("_near.lang").alias("ref_lang"),
        F.col("_near.c").alias("class_distance"),
        F.col("_near.v").alias("word_distance"),
    )


def quality_filter(docs: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """The documents that the rules keep, all columns unchanged.

    Rows are matched by doc_id and text, so repeated rows stay repeated.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("text"))
    verdict = quality_rules(docs.select(F.to_json(key).alias("doc_id"), "text", "lang"), params)
    rejected = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_k")).distinct()
    return wrapped(docs, _k=F.to_json(key)).join(rejected, "_k", "left_anti").select("_row.*")
