"""Line dedup by a segment-partition edit join (DataFrame functions only).

A line is removed if an equal line, or one within as many character edits as the
shorter of the two allows, stands earlier in the corpus (smaller doc_id, or same
document, earlier line); lines are judged on the input, not on what is left.
Equality counts for lines of any length.  Edits grow with the line: one for
every ``chars_per_edit`` characters, from one (lines of ``min_edit_chars`` or
more; one edit in fewer is another line) to ``most_edits``.

Equal lines are collapsed by two 64-bit hashes before any join, so that a line's
number of copies never matters.  For the edit join a line of n characters that
allows e edits is cut into e + 1 segments: within e edits one segment of the
shorter line stands unchanged in the longer one, at a place that the length
difference bounds.  Index entries are (length, segment number, segment) of each
line; probes are the substrings of each line at those places, for its own and
the next shorter lengths.  Entries whose key nothing else has are dropped by one
shuffle; for the lines of the others a letter profile discards pairs while they are
joined, and survivors are verified by banded bit-parallel edit distance on what
remains between their common ends.

A segment that more than ``hot`` lines share, such as a common start of log
lines, is not joined as it is: what remains of these lines without it may have
e edits as well, so it is cut into e + 1 segments again, up to ``levels`` times.
Keys are joined in ``passes`` shares, so that only one share is shuffled at a time.

Edge cases: null text has no lines; lines without a word are kept; repeated rows
are one document, neither is earlier than the other; rows of one doc_id with
different texts are different documents, in the order of their text hashes; a
null doc_id is the smallest; a line of any length is one line.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, bind, drop_stored, keyed, stored, stored_by, wrapped

#: Characters whose counts make the profile, four bits each.
PROFILE = "etaoinsrhdlucmp "
#: What tells a line apart: the place where it stands first.
PLACE = ("k", "sig", "pos")


@dataclass(frozen=True)
class LineParams:
    #: one edit for so many characters of the shorter line, at least one and at most ``most_edits``
    chars_per_edit: int = 100
    most_edits: int = 2
    #: lines from this length on may have an edit
    min_edit_chars: int = 10
    #: lines that may share a segment before the rest of them is cut again, and how often that is done
    hot: int = 300
    levels: int = 3
    #: shares of the keys that are joined one after the other
    passes: int = 1
    #: lines with more than this share of all copies are joined by broadcast: at most 1 / share of them
    copies_share: float = 0.001


def edits_of(length: Column, p: LineParams) -> Column:
    """Edits that a pair may have whose shorter line is so long."""
    some = F.greatest(F.lit(1), F.least(F.lit(p.most_edits), F.floor(length / p.chars_per_edit).cast("int")))
    return F.when((length < p.min_edit_chars) | (F.lit(p.most_edits) == 0), 0).otherwise(some)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def probe_offsets(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, offset) of all places where an unchanged segment can stand."""
    out = []
    for diff in range(edits + 1):
        for i in range(edits + 1):
            low = max(-i, diff - (edits - i))
            high = min(i, diff + (edits - i))
            out += [(diff, i, o) for o in range(low, high + 1)]
    return out


def places(edits: list[int]) -> Column:
    """Constant array of struct e (edits), d (length difference), i (segment), o (offset)."""
    found = [(e, *x) for e in edits for x in probe_offsets(e)] if any(edits) else []
    rows = [F.struct(*[F.lit(v).alias(c) for v, c in zip(x, "edio", strict=True)]) for x in found]
    return F.array(*rows) if rows else F.array().cast("array<struct<e:int,d:int,i:int,o:int>>")


def segment(length: Column, x: Column) -> tuple[Column, Column]:
    """(start from 1, size) in a line of this length where the place ``x`` has its segment; later segments are longer."""
    size, parts = length - x["d"], x["e"] + 1
    base, short = F.floor(size / parts).cast("int"), parts - size % parts
    start = base * x["i"] + F.greatest(F.lit(0), x["i"] - short) + 1 + x["o"]
    return start.cast("int"), (base + F.when(x["i"] >= short, 1).otherwise(0)).cast("int")


def cut(rows: DataFrame, code: Column, x: Column, base: Column, *carried: str, rest: bool) -> DataFrame:
    """Entries of rows (line, n, its length, and ``code``, its characters in four bytes each) that have one place ``x`` each: carried columns, e, index (is it an
    index entry), key and, where asked for, d and what the line is without the segment, with its length.
    """
    start, width = segment(F.col("n"), x)
    key = F.xxhash64(base, x["i"], F.col("n") - x["d"], F.substring(code, start * 4 - 3, width * 4))
    left = F.concat(F.substring("line", F.lit(1), start - 1), F.substring("line", start + width, F.col("n")))
    more = [x["d"].alias("d"), left.alias("line"), (F.col("n") - width).alias("n")] if rest else []
    kept = (start >= 1) & (start + width - 1 <= F.col("n"))
    return rows.filter(kept).select(*carried, x["e"].alias("e"), ((x["d"] == 0) & (x["o"] == 0)).alias("index"), key.alias("key"), *more)


def profile(line: Column) -> Column:
    """Counts of the profile's characters, modulo 16, in a long."""
    total = F.lit(0).cast("long")
    for i, c in enumerate(PROFILE):
        n = (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long")
        total = total.bitwiseOR(F.shiftleft(n.bitwiseAND(15), 4 * i))
    return total


def profiles_near(a: Column, b: Column, edits: int | Column) -> Column:
    """Whether two profiles can belong to lines within ``edits``: an edit adds at most one character and takes at most one."""
    more = less = F.lit(0).cast("long")
    for i in range(len(PROFILE)):
        part = lambda c, i=i: F.shiftrightunsigned(c, 4 * i).bitwiseAND(15)
        d = (part(a) - part(b) + 8).bitwiseAND(15) - 8
        more, less = more + F.greatest(d, F.lit(0)), less + F.greatest(-d, F.lit(0))
    return (more <= edits) & (less <= edits)


def common_start(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by halving steps."""
    most = F.least(F.length(a), F.length(b))
    return F.aggregate(
        F.array(*[F.lit(1 << e) for e in range(30, -1, -1)]),
        F.lit(0),
        lambda at, step: F.when((step <= most - at) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step)), at + step).otherwise(at),
    )


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings if at most ``most``, else ``most`` + 1.

    Bit-parallel over the band of 2 * most + 1 diagonals: bit i of column j is
    row j - most + i of the dynamic programming table.  The distance is the
    start of the diagonal that ends in the last cell and one for each step on it
    that costs.
    """
    full = (1 << (2 * most + 1)) - 1
    band = lambda c: c.bitwiseAND(full)
    inverse = lambda c: band(F.bitwise_not(c))

    def run(x: Column) -> Column:
        rows, columns, d = x["a"], x["b"], x["d"]

        def step(s: Column, j: Column) -> Column:
            eq = F.lit(0).cast("long")
            here = F.get(columns, j - 1)
            for i in range(2 * most + 1):
                eq = eq.bitwiseOR(F.when(F.get(rows, j - most + i - 1) == here, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))

            def vectors(e: Column) -> Column:
                return band((e.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(e).bitwiseOR(s["vn"]))

            def following(d0: Column) -> Column:
                hp = s["vn"].bitwiseOR(inverse(d0.bitwiseOR(s["vp"])))
                hn = d0.bitwiseAND(s["vp"])
                down = F.shiftright(d0, 1)
                cost = F.when((j + d >= 1) & (F.call_function("shiftright", d0, most + d).bitwiseAND(1) == 0), 1).otherwise(0)
                return F.struct(
                    hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (s["cost"] + cost).alias("cost"),
                )

            return F.when(s["cost"] > most, s).otherwise(bind(bind(eq, vectors), following))

        begin = F.struct(F.lit(full ^ ((1 << most) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.abs(d).alias("cost"))
        return F.when(
            F.size(columns) == 0, F.size(rows)
        ).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(columns)), begin, step, lambda s: s["cost"]))

    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    apart = F.length(a) - F.length(b)
    found = F.when(F.abs(apart) > most, F.lit(most + 1)).otherwise(bind(F.struct(chars(a).alias("a"), chars(b).alias("b"), apart.alias("d")), run))
    return F.least(found, F.lit(most + 1))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """``banded_distance`` of what two strings have between their common ends."""

    def middle(x: Column) -> Column:
        rest = lambda c: F.substring(x[c], x["p"] + 1, F.length(x[c]))
        return bind(
            F.struct(rest("a").alias("a"), rest("b").alias("b")),
            lambda r: bind(
                common_start(F.reverse(r["a"]), F.reverse(r["b"])),
                lambda n: banded_distance(F.substring(r["a"], F.lit(1), F.length(r["a"]) - n), F.substring(r["b"], F.lit(1), F.length(r["b"]) - n), most),
            ),
        )

    return bind(F.struct(a.alias("a"), b.alias("b"), common_start(a, b).alias("p")), middle)


def first_lines(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1, k, sig, pos, line, n (its length) of the places in ``firsts``; ``texts`` (k, sig, text) is in buckets of k and sig and isn't shuffled."""
    wanted = firsts.groupBy("k", "sig").agg(F.collect_list(F.struct("pos", "h1")).alias("at"))
    taken = bind(F.split("text", "\n"), lambda ls: F.transform("at", lambda x: F.struct(x["h1"].alias("h1"), x["pos"].alias("pos"), F.get(ls, x["pos"]).alias("line"))))
    found = texts.join(wanted, ["k", "sig"]).select("k", "sig", F.explode(taken).alias("x"))
    return found.select("x.h1", "k", "sig", "x.pos", "x.line", F.length("x.line").alias("n"))


def entries(lines: DataFrame, p: LineParams, *carried: str, rest: bool) -> DataFrame:
    """All keys of ``lines`` (h1, line, n)."""
    n = F.col("n")
    own, least = edits_of(n, p), edits_of(n - p.most_edits, p)
    choice = F.when(own == 0, places([]))
    for e in range(1, p.most_edits + 1):
        choice = choice.when((own == e) & (least == e), places([e])).when(own == e, places([e - 1, e] if e > 1 else [e]))
    placed = lines.withColumn("code", F.encode("line", "UTF-32")).select("h1", "line", "n", "code", *carried, F.explode(choice).alias("x"))
    # a shorter line may allow fewer edits
    placed = placed.filter((F.col("x.e") == edits_of(n - F.col("x.d"), p)) & (F.col("x.d") <= F.col("x.e")))
    return cut(placed, F.col("code"), F.col("x"), F.lit(0), "h1", *carried, rest=rest)


def met(rows: DataFrame, *columns: str) -> DataFrame:
    """The entries whose key an index entry and another entry have, and n_index, how many index entries."""
    own = Window.partitionBy("key")
    counted = rows.select("h1", "e", "index", "key", *columns, F.count("*").over(own).alias("n_all"), F.count_if("index").over(own).alias("n_index"))
    return counted.filter((F.col("n_all") > 1) & (F.col("n_index") > 0)).drop("n_all")


def line_pairs(texts: DataFrame, firsts: DataFrame, p: LineParams) -> tuple[DataFrame, DataFrame]:
    """(x < y: h1 of the lines that share a segment and have near profiles; the table of these lines with their profiles)."""
    found, shares = [], []
    for i in range(p.passes):
        rows = entries(first_lines(texts, firsts), p, rest=False)
        shares.append(stored(met(rows if p.passes == 1 else rows.filter(F.pmod("key", F.lit(p.passes)) == i)), "line-keys"))
    level = reduce(DataFrame.union, shares)
    lines = first_lines(texts, firsts.join(level.select("h1").distinct(), "h1", "left_semi"))
    lines = stored(lines.withColumn("prof", profile(F.col("line"))), "line-wanted")
    level = level.join(lines.select("h1", "prof"), "h1")
    for depth in range(p.levels + 1):
        cold = level.filter(F.col("n_index") <= p.hot) if depth < p.levels else level
        a = cold.filter("index").select("key", F.col("h1").alias("x"), F.col("prof").alias("px"), "e")
        b = cold.select(F.col("key").alias("key2"), F.col("h1").alias("y"), F.col("prof").alias("py"))
        pairs = a.join(b, (F.col("key") == F.col("key2")) & (F.col("x") != F.col("y")) & profiles_near(F.col("px"), F.col("py"), F.col("e")))
        found.append(stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "line-pairs"))
        if depth == p.levels:
            break
        hot = stored(level.filter(F.col("n_index") > p.hot).select("key").distinct(), "line-hot")
        if hot.isEmpty():
            break
        # what remains of hot lines, cut again at the length difference that their key has
        rows = (entries(lines, p, "prof", rest=True) if depth == 0 else again).join(hot, "key", "left_semi")
        table = places(list(range(1, p.most_edits + 1)))
        rows = rows.select("h1", "prof", F.col("index").alias("was"), F.col("key").alias("base"), "line", "n", F.explode(F.filter(table, lambda x: (x["e"] == F.col("e")) & (x["d"] == F.col("d")))).alias("x"))
        again = cut(rows, F.encode("line", "UTF-32"), F.col("x"), F.col("base"), "h1", "prof", "was", rest=True).withColumn("index", F.col("was") & F.col("index")).drop("was")
        again = stored(again, "line-rest")
        level = stored(met(again, "prof"), "line-keys")
    return reduce(DataFrame.union, found).distinct(), lines


def near_links(texts: DataFrame, firsts: DataFrame, p: LineParams) -> DataFrame:
    """The places (a_ and b_ columns) of the earlier and the later line of every verified link."""
    pairs, lines = line_pairs(texts, firsts, p)
    pairs = stored(pairs, "line-pairs")
    side = lambda c: lines.select(F.col("h1").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in (*PLACE, "line")])
    joined = pairs.join(side("x"), "x").join(side("y"), "y")
    most = edits_of(F.least(F.length("x_line"), F.length("y_line")), p)
    close = joined.filter((F.col("x_line") != F.col("y_line")) & (edit_distance(F.col("x_line"), F.col("y_line"), max(1, p.most_edits)) <= most))
    both = F.array_sort(F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in PLACE]) for s in "xy"]))
    return close.select(both.alias("o")).select(*[F.get("o", i)[c].alias(f"{s}_{c}") for i, s in enumerate("ab") for c in PLACE]).distinct()


def removals(docs: DataFrame, p: LineParams) -> DataFrame:
    """k, sig, and what is removed of it: array of struct pos, near (by an edit link only), first_k; n_links of its lines."""
    lines = keyed(docs, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).filter(has_word(F.col("line")))
    rows = stored(lines.select(F.col("_k").alias("k"), F.col("_sig").alias("sig"), "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), "lines")
    firsts = stored(rows.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("f"), F.count("*").alias("copies")).select("h1", "h2", "f.*", "copies"), "line-firsts")
    texts, table = stored_by(keyed(docs, "text").toDF("k", "sig", "text").dropDuplicates(["k", "sig"]), "line-texts", "k", "sig")
    links = stored(near_links(texts, firsts, p), "line-links")
    drop_stored(texts, table)
    later = links.groupBy(*[F.col(f"b_{c}").alias(c) for c in PLACE]).agg(F.min("a_k").alias("near_k"))
    ends = links.select(F.explode(F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in PLACE]) for s in "ab"])).alias("x")).select("x.*")
    degree = ends.groupBy(*PLACE).agg(F.count("*").alias("links"))
    facts = firsts.join(degree, list(PLACE), "left").join(later, list(PLACE), "left").filter((F.col("copies") > 1) | F.col("links").isNotNull())
    facts = stored(facts.select("h1", "h2", "copies", "links", "near_k", *[F.col(c).alias(f"first_{c}") for c in PLACE]), "line-facts")
    many = F.greatest(F.lit(1000.0), F.lit((rows.count()) * p.copies_share))
    hot = F.broadcast(facts.filter(F.col("copies") > many))  # at most 1 / copies_share rows
    cold = rows.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(facts.filter(F.col("copies") <= many), ["h1", "h2"])
    found = rows.join(hot, ["h1", "h2"]).unionByName(cold)
    again = F.lit(False)
    for c in PLACE:
        again = again | (F.col(c) != F.col(f"first_{c}"))
    gone = F.when(again | F.col("near_k").isNotNull(), F.struct("pos", (~again).alias("near"), F.when(again, F.col("first_k")).otherwise(F.col("near_k")).alias("first_k")))
    # rows of repeated documents agree: each line counts once
    found = found.select("k", "sig", "pos", gone.alias("gone"), F.coalesce("links", F.lit(0)).alias("links"))
    lists = found.groupBy("k", "sig").agg(F.collect_set(F.struct("pos", "gone", "links")).alias("all"))
    return lists.select("k", "sig", F.filter(F.transform("all", lambda x: x["gone"]), lambda x: x.isNotNull()).alias("gone"), F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["links"]).alias("n_links"))


def applied(docs: DataFrame, p: LineParams) -> DataFrame:
    """The rows of ``docs`` as _row, with doc_id, text, _gone (what is removed), _links, _new (the text after it)."""
    gone = removals(docs, p).select(F.col("k").alias("_k"), F.col("sig").alias("_sig"), F.col("gone").alias("_gone"), F.col("n_links").alias("_links"))
    rows = wrapped(docs, doc_id=F.col("doc_id"), text=F.col("text"), _k=F.coalesce("doc_id", F.lit(NULL_ID)), _sig=F.xxhash64("text")).join(gone, ["_k", "_sig"], "left")
    lines = F.split("text", "\n")
    # kept lines are what stands between removed ones
    at = F.array_sort(F.transform("_gone", lambda g: g["pos"]))
    between = lambda ls, ps: F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(ps)),
        lambda i: bind(F.coalesce(F.get(ps, i - 1) + 1, F.lit(0)), lambda a: F.slice(ls, a + 1, F.coalesce(F.get(ps, i), F.size(ls)) - a)),
    ))
    kept = bind(F.struct(lines.alias("ls"), at.alias("ps")), lambda x: F.array_join(between(x["ls"], x["ps"]), "\n"))
    return rows.withColumn("_new", F.when(F.size(F.coalesce("_gone", F.array())) == 0, F.col("text")).otherwise(kept)).drop("_k", "_sig")


def line_dedup(docs: DataFrame, params: LineParams | None = None) -> DataFrame:
    """doc_id, n_lines (with a word), n_exact and n_near (removed lines), n_links (links of its lines to other
    texts), dup_of (first documents of removed lines, sorted), text and n_chars (long) after the removal.
    """
    rows = applied(docs.select("doc_id", "text"), params or LineParams())
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), has_word)).cast("long")
    near = F.size(F.filter("_gone", lambda g: g["near"]))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    dup = F.coalesce(F.array_sort(F.array_distinct(F.transform("_gone", lambda g: g["first_k"]))), F.array().cast("array<bigint>"))
    return rows.select(
        "doc_id", lines.alias("n_lines"), zero(F.size("_gone") - near).alias("n_exact"), zero(near).alias("n_near"), zero(F.col("_links")).alias("n_links"),
        F.transform(dup, lambda d: F.when(d != NULL_ID, d)).alias("dup_of"),
        F.col("_new").alias("text"), F.length("_new").cast("long").alias("n_chars"),
    )


def drop_lines(docs: DataFrame, params: LineParams | None = None) -> DataFrame:
    """``docs`` with repeated lines removed from text and n_chars adjusted; documents that lose all their words leave."""
    rows = applied(docs, params or LineParams())
    lost = (F.coalesce(F.size("_gone"), F.lit(0)) > 0) & ~F.coalesce(has_word(F.col("_new")), F.lit(False))
    made = {"text": F.col("_new"), "n_chars": F.when(F.col("_new").eqNullSafe(F.col("text")), F.col("_row.n_chars")).otherwise(F.length("_new").cast("long")) if "n_chars" in docs.columns else None}
    return rows.filter(~lost).select(*[(made[c] if made.get(c) is not None else F.col("_row")[c]).alias(c) for c in docs.columns])
