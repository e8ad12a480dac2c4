"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers.  These are the seeds.  The words around an occurrence make its lexical
patterns: the two words before it, and the word before with the word after.
Other identifier-like tokens (with a digit or an @) that stand in such places are
candidate instances.  Patterns and instances form a bipartite graph that is scored
in rounds.  A pattern's confidence in a kind is the share of its distinct instances
that are known, each with its score; it counts from ``min_support`` known instances
on.  An instance's score is the noisy-or of its confident patterns; from
``min_score`` on it is known, and takes part in the next round like a seed, so that
its other contexts become patterns.  Seeds keep score 1.  Rounds go on until nothing
new is known, ``rounds`` at most.  What is known in the end are identifiers that no
base pattern covers.

One pass over the texts writes spans and occurrences, which are small, to the
shared folder.  The rounds run on the distinct edges of patterns with enough
instances (no other can ever count); joins on patterns are salted, as one context
may have a third of all instances.

Offsets are code points, ends exclusive.  Edge cases: null text is empty; a
failing match is dropped without a retry; repeated rows get the same spans and
count once as instances; a kind without seeds learns nothing; ties between
kinds go to the first as listed; a token with the character U+FDD0, which marks
base spans, is no candidate; in a text of any length each occurrence looks at the
stretches next to it only, and offsets take n * sqrt(n) steps for n matches of a kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bind, stored

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that no text makes them slow: a match starts
#: where a run of its characters starts, and runs are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?:[0-9][\x20-]?){15,18}[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-like tokens: a digit or an @ in a run without blanks.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Characters around a token that belong to the sentence.
EDGE_LEFT, EDGE_RIGHT = r"^[\"'(\[<{,;:!?.]+", r"[\"')\]>},;:!?.]+$"
#: Code points before and after an occurrence that are looked at for its words.
REACH = 80
CELL = 256
#: Stands for the characters of base spans where tokens are looked for.
MASK = "\ufdd0"
MOST_ROUNDS = 200


@dataclass(frozen=True)
class PiiParams:
    #: rounds go on until a state repeats, and fail beyond MOST_ROUNDS; fewer stop on purpose before all is known
    rounds: int = MOST_ROUNDS
    #: distinct known instances of a kind that a pattern needs
    min_support: int = 3
    min_confidence: float = 0.6
    min_score: float = 0.8
    min_token: int = 4
    #: parts of a pattern's instances in a join
    salts: int = 16


def prefix_sums(sizes: Column) -> Column:
    """Sums of all elements before each one, in n * sqrt(n) steps: sums of cells, then within cells."""

    def running(a: Column) -> Column:
        return F.aggregate(
            a,
            F.struct(F.lit(0).cast("int").alias("s"), F.array().cast("array<int>").alias("o")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o")),
            lambda acc: acc["o"],
        )

    total = lambda a: F.aggregate(a, F.lit(0).cast("int"), lambda s, x: s + x)
    cells = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CELL).cast("int")), lambda c: F.slice(a, c * CELL + 1, F.lit(CELL)))

    def whole(a: Column) -> Column:
        return bind(
            cells(a),
            lambda cs: bind(running(F.transform(cs, total)), lambda off: F.flatten(F.transform(cs, lambda c, i: bind(F.get(off, i), lambda o: F.transform(running(c), lambda x: x + o))))),
        )

    return bind(sizes, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).when(F.size(a) <= CELL, running(a)).otherwise(whole(a)))


def matches(text: Column, pattern: str) -> Column:
    """Array of struct s, e, v, b, a of all matches: positions from the gaps between them, and up to REACH
    code points before and after, which reach over one neighbouring match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    head = lambda c: F.substring(c, F.lit(1), F.lit(REACH))
    tail = lambda c: F.when(F.length(c) > REACH, F.substring(c, -REACH, F.lit(REACH))).otherwise(c)

    def placed(vs: Column) -> Column:
        pieces = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), head(g).alias("h"), tail(g).alias("t")))
        known = F.transform(vs, lambda v: F.struct(v.alias("v"), F.length(v).alias("n"), head(v).alias("h"), tail(v).alias("t")))
        some = lambda c: F.coalesce(c, F.lit(""))

        def all_(gs: Column, ms: Column) -> Column:
            return bind(
                prefix_sums(F.transform(ms, lambda m, i: F.get(gs, i)["n"] + m["n"])),
                lambda before: F.transform(
                    ms,
                    lambda m, i: bind(
                        F.get(before, i) + F.get(gs, i)["n"],
                        lambda s: F.struct(
                            s.alias("s"), (s + m["n"]).alias("e"), m["v"].alias("v"),
                            tail(F.concat(some(F.get(gs, i - 1)["t"]), some(F.get(ms, i - 1)["t"]), F.get(gs, i)["t"])).alias("b"),
                            head(F.concat(F.get(gs, i + 1)["h"], some(F.get(ms, i + 1)["h"]), some(F.get(gs, i + 2)["h"]))).alias("a"),
                        ),
                    ),
                ),
            )

        return bind(pieces, lambda gs: bind(known, lambda ms: all_(gs, ms)))

    none = F.array().cast("array<struct<s:int,e:int,v:string,b:string,a:string>>")
    return bind(found, lambda vs: F.when(F.size(vs) > 0, placed(vs)).otherwise(none))


def masked(text: Column, kind: str) -> Column:
    """The text with every valid match of a kind replaced by as many MASK characters."""
    pattern = PATTERNS[kind]
    hide = lambda v: F.when(valid(kind, v), F.rpad(F.lit(MASK), F.length(v), MASK)).otherwise(v)
    joined = lambda vs: F.array_join(F.zip_with(F.split(text, pattern, -1), vs, lambda g, v: F.concat(g, F.coalesce(hide(v), F.lit("")))), "")
    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda vs: F.when(F.size(vs) > 0, joined(vs)).otherwise(text))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, -i, F.lit(1)).cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return bind(digits, luhn)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Array of struct k (number of the kind), s, e, v, b, a."""
    k = KINDS.index(kind)
    kept = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["v"]))
    return F.transform(kept, lambda m: F.struct(F.lit(k).alias("k"), *[m[c].alias(c) for c in "sevba"]))


def occurrences(text: Column, spans: Column, min_token: int) -> Column:
    """Seeds and candidate tokens of a text with masked spans, with their patterns: struct k (null: candidate), s, e, inst, pats."""

    def trimmed(m: Column) -> Column:
        left = F.regexp_replace(m["v"], EDGE_LEFT, "")
        return bind(
            F.struct((m["s"] + F.length(m["v"]) - F.length(left)).alias("s"), F.regexp_replace(left, EDGE_RIGHT, "").alias("v")),
            lambda x: F.struct(F.lit(None).cast("int").alias("k"), x["s"].alias("s"), (x["s"] + F.length(x["v"])).alias("e"), x["v"].alias("v"), m["b"].alias("b"), m["a"].alias("a")),
        )

    tokens = F.filter(
        F.transform(F.filter(matches(text, TOKEN), lambda m: ~F.contains(m["v"], F.lit(MASK))), trimmed),
        lambda t: (F.length(t["v"]) >= min_token) & t["v"].rlike("[0-9@]"),
    )
    word = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}=:@#]+"), lambda w: w != "")

    def around(t: Column) -> Column:
        def patterns(b: Column, a: Column) -> Column:
            one = F.coalesce(F.get(b, F.size(b) - 1), F.lit("^"))
            two = F.coalesce(F.get(b, F.size(b) - 2), F.lit("^"))
            return F.array(F.concat_ws(" ", two, one, F.lit("_")), F.concat_ws(" ", one, F.lit("_"), F.coalesce(F.get(a, 0), F.lit("$"))))

        return F.struct(
            t["k"].alias("k"), t["s"].alias("s"), t["e"].alias("e"), F.lower(t["v"]).alias("inst"),
            bind(word(t["b"]), lambda b: bind(word(t["a"]), lambda a: patterns(b, a))).alias("pats"),
        )

    return F.transform(F.concat(spans, tokens), around)


def scan(docs: DataFrame, p: PiiParams) -> DataFrame:
    """key, sig, doc_id, base (spans without values), occ: one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("key"), F.xxhash64("text").alias("sig"), text.alias("_t"))
    digits = F.col("_t").rlike("[0-9]")
    none = F.array().cast("array<struct<k:int,s:int,e:int,v:string,b:string,a:string>>")
    some = {"email": F.contains("_t", F.lit("@")), "ip": digits, "card": digits, "phone": F.contains("_t", F.lit("+"))}
    spans = F.concat(*[F.when(some[k], base_spans(F.col("_t"), k)).otherwise(none) for k in KINDS])
    df = df.withColumn("_spans", spans)
    # phones and cards first: what is left of a longer span is then no number of another kind
    def hide(t: Column, kind: str) -> Column:
        return bind(t, lambda x: F.when(F.exists("_spans", lambda b: b["k"] == KINDS.index(kind)), masked(x, kind)).otherwise(x))

    hidden = F.col("_t")
    for kind in ("phone", "card", "ip", "email"):
        hidden = hide(hidden, kind)
    occ = F.when(digits | F.contains("_t", F.lit("@")), bind(hidden, lambda t: occurrences(t, F.col("_spans"), p.min_token))).otherwise(
        F.array().cast("array<struct<k:int,s:int,e:int,inst:string,pats:array<string>>>")
    )
    return df.select("doc_id", "key", "sig", F.transform("_spans", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))).alias("base"), occ.alias("occ"))


def learn(occ: DataFrame, p: PiiParams) -> DataFrame:
    """inst, k: the unseen identifiers, from occurrences (k, inst, pats)."""
    edges = occ.select(F.explode(F.array_distinct("pats")).alias("pat"), "inst", "k")
    # copies of a document add nothing: an instance counts once for a pattern
    edges = stored(edges.groupBy("pat", "inst").agg(F.min("k").alias("k")), "pii-edges")
    # a seed keeps its first kind everywhere
    seeds = stored(edges.filter(F.col("k").isNotNull()).groupBy("inst").agg(F.min("k").alias("k")).withColumn("score", F.lit(1.0)), "pii-seeds")
    salt = F.pmod(F.xxhash64("inst"), F.lit(p.salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1)))
    sizes = edges.groupBy("pat").agg(F.count("*").alias("n")).filter(F.col("n") >= p.min_support)
    edges = edges.select("pat", "inst", salt.alias("salt")).join(sizes.withColumn("salt", every), ["pat", "salt"])
    edges = stored(edges, "pii-graph")
    open_ = edges.join(seeds.select("inst"), "inst", "left_anti")
    known, states = seeds, set()
    for _ in range(p.rounds):
        met = edges.join(known, "inst").groupBy("pat", "k").agg(F.sum("score").alias("sum"), F.count("*").alias("support"), F.first("n").alias("n"))
        # rounded, so that the order of additions does not matter
        trust = met.filter(F.col("support") >= p.min_support).select("pat", "k", F.round(F.col("sum") / F.col("n"), 6).alias("conf"))
        trust = trust.filter(F.col("conf") >= p.min_confidence)
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))))
        scores = open_.join(trust.withColumn("salt", every), ["pat", "salt"]).groupBy("inst", "k").agg(F.round(1 - doubt, 6).alias("score"))
        best = scores.filter(F.col("score") >= p.min_score).groupBy("inst").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
        found = stored(best.select("inst", (-F.col("b.k")).alias("k"), F.col("b.score").alias("score")), "pii-known")
        state = found.agg(F.count("*"), F.sum(F.xxhash64("inst", "k", "score").cast("decimal(20,0)"))).first()
        known = seeds.unionByName(found)
        if state in states or not state[0]:
            return found.select("inst", "k")
        states.add(state)
    if p.rounds >= MOST_ROUNDS:
        raise RuntimeError("scores did not settle")
    return found.select("inst", "k")


def spans_string(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans_of(docs: DataFrame, params: PiiParams | None = None) -> DataFrame:
    """doc_id, key, sig (which tell documents apart), base, added for each row of ``docs`` (doc_id, text).

    Both are arrays of struct k (index into KINDS), s, e, sorted; added spans
    overlap no base span.
    """
    p = params or PiiParams()
    rows = stored(scan(docs, p), "pii")
    occ = rows.select("key", "sig", F.explode("occ").alias("o"))
    known = learn(occ.select("o.k", "o.inst", "o.pats"), p)
    hits = occ.filter(F.col("o.k").isNull()).select("key", "sig", F.col("o.inst").alias("inst"), F.col("o.s").alias("s"), F.col("o.e").alias("e")).join(known, "inst")
    added = hits.groupBy("key", "sig").agg(F.array_sort(F.collect_set(F.struct("k", "s", "e"))).alias("added"))
    joined = rows.select("doc_id", "key", "sig", "base").join(added, ["key", "sig"], "left")
    return joined.select("doc_id", "key", "sig", F.array_sort("base").alias("base"), F.coalesce("added", F.array().cast("array<struct<k:int,s:int,e:int>>")).alias("added"))


def find_pii(docs: DataFrame, params: PiiParams | None = None) -> DataFrame:
    """doc_id, base, added of ``spans_of``."""
    return spans_of(docs, params).drop("key", "sig")


def redact(docs: DataFrame, params: PiiParams | None = None) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets; null stays null."""
    found = spans_of(docs, params).select(F.col("key").alias("_key"), F.col("sig").alias("_sig"), F.concat("base", "added").alias("_all")).dropDuplicates(["_key", "_sig"])
    names = F.array(*[F.lit(k) for k in KINDS])
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_key"), F.xxhash64("text").alias("_sig")).join(found, ["_key", "_sig"], "left")
    by_start = F.array_sort(F.transform("_all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    cut = F.aggregate(
        by_start,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["s"] < a["at"], a).otherwise(
            F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring("text", a["at"] + 1, x["s"] - a["at"]), F.lit("<"), F.get(names, x["k"]), F.lit(">")).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))),
    )
    return rows.select("doc_id", cut.alias("text"))
