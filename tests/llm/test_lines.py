import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.llm.common import documents
from lexispark.llm.lines import LineParams, drop_lines, edit_distance, line_dedup, probe_offsets
from lexispark.llm.queries import op3_line_dedup


def order(text):
    """The signed hash that orders documents of one doc_id."""
    return 42 if text is None else xxhash.xxh64(text.encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(text.encode(), seed=42).intdigest() >> 63)


def distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row[-1], most + 1)


def allowed(n, p):
    return 0 if n < p.min_edit_chars or not p.most_edits else max(1, min(p.most_edits, n // p.chars_per_edit))


def brute(rows, p=LineParams()):
    """All lines of all documents; rows of one doc_id and text are one document, others differ."""
    docs = {(-(2**63) if d is None else d, order(t)) for d, t in rows}
    texts = {(-(2**63) if d is None else d, order(t)): t for d, t in rows}
    lines = [(d, o, i, s) for d, o in docs for i, s in enumerate((texts[d, o] or "").split("\n")) if s.strip(" \t\n\x0b\x0c\r")]
    first = {}
    for d, o, i, s in lines:
        first[s] = min(first.get(s, (d, o, i)), (d, o, i))
    near, links = {}, Counter()
    by_length = {}
    for s in sorted(first):
        by_length.setdefault(len(s), []).append(s)
    bags = {n: np.array([np.bincount([ord(c) % 61 for c in s], minlength=61) for s in own]) for n, own in by_length.items()}
    for n, own in by_length.items():
        edits = allowed(n, p)
        for m in (x for x in range(n, n + edits + 1) if edits and x in by_length):
            for a, bag in zip(own, bags[n], strict=True):
                # an edit changes at most two counts by one
                for b in (by_length[m][i] for i in np.flatnonzero(np.abs(bags[m] - bag).sum(1) <= 2 * edits)):
                    if (a < b or m > n) and distance(a, b, edits) <= edits:
                        links[a] += 1
                        links[b] += 1
                        x, y = sorted((a, b), key=first.get)
                        near[y] = min(near.get(y, first[x]), first[x])
    out = []
    for d, t in rows:
        at = -(2**63) if d is None else d
        kept, exact, close, of, total = [], 0, 0, set(), 0
        for i, s in enumerate((t or "").split("\n")):
            total += links.get(s, 0)
            if s in first and first[s] != (at, order(t), i):
                exact += 1
                of.add(first[s][0])
            elif s in near:
                close += 1
                of.add(near[s][0])
            else:
                kept.append(s)
        out.append((d, exact, close, total, [None if x == -(2**63) else x for x in sorted(of)], None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_exact"], r["n_near"], r["n_links"], r["dup_of"], r["text"]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in documents(spark, d).select("doc_id", "text").collect()]
    want = [(a, b, c, n, of, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, n, of, t in brute(rows)]
    got = [(r["doc_id"], r["n_exact"], r["n_near"], r["n_links"], r["dup_of"], r["kept_sha256"]) for r in op3_line_dedup(spark, d).collect()]
    assert sorted(got, key=str) == want


def test_random_edits(spark, docs):
    rng = random.Random(4)
    rows = []
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(18, 40))) for _ in range(12)]
    for d in range(60):
        own = []
        for _ in range(rng.randint(0, 4)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(s))
                s[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
            own.append("".join(s))
        rows.append((d, "\n".join(own)))
    for p in (LineParams(chars_per_edit=1, most_edits=2, passes=1), LineParams(chars_per_edit=9, most_edits=3), LineParams(most_edits=0)):
        assert rows_of(line_dedup(docs(*rows), p)) == brute(rows, p)


def test_bit_parallel_distance(spark):
    rng = random.Random(9)
    pairs = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text("abé", max_size=12), st.text("abé", max_size=12))
    def gather(a, b):
        pairs.append((a, b))

    gather()
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 4):
        got = df.select("a", "b", edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect()
        assert [(r["a"], r["b"], r["d"]) for r in got] == [(a, b, distance(a, b, most)) for a, b in pairs]


def test_edge_cases(spark, docs):
    line = "a line that is long enough to count"
    rows = [(1, None), (2, ""), (3, f"{line}\n \n\nshort"), (4, line), (5, f"{line}!\nnew words"), (6, "z" * 100_000), (6, "z" * 100_000), (None, f"x\n{line}"), (7, "short\nshort")]
    assert rows_of(line_dedup(docs(*rows))) == brute(rows)
    kept = drop_lines(docs(*rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 5, 6, 6, None], key=str)
    assert kept.columns == docs(*rows).columns
    assert line_dedup(docs(*rows).filter("false")).count() == 0
    assert len(probe_offsets(1)) == 4 and len(probe_offsets(2)) == 12


def test_one_doc_id_with_two_texts(spark, docs):
    rows = [(1, "one line of text\nClick here now"), (2, "one line of text"), (2, "Click here now"), (2, "a line that only this row has"), (3, "Click here now")]
    got = rows_of(line_dedup(docs(*rows)))
    assert got == brute(rows)
    assert (2, 0, 0, 0, [], "a line that only this row has") in got
    assert sorted((r["doc_id"], r["text"]) for r in drop_lines(docs(*rows)).collect()) == [(1, rows[0][1]), (2, "a line that only this row has")]


def test_edits_grow_with_length(spark, docs):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdeé ") for _ in range(n)) for n in (8, 9, 10, 11, 22, 39, 40, 41, 59, 60, 63, 79, 80, 83, 150)]
    lines = list(base)
    for _ in range(150):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
        lines.append("".join(s) or "x")
    rows = list(enumerate(lines))
    for p in (LineParams(chars_per_edit=20, most_edits=4, passes=3), LineParams(chars_per_edit=20, most_edits=3, passes=1, hot=2, levels=2)):
        want = brute(rows, p)
        assert rows_of(line_dedup(docs(*rows), p)) == want
        assert sum(x[2] for x in want) > 20


def test_lines_with_a_common_half(spark):
    half = "2026-03-01 service=gateway level=info "
    text = F.concat(F.lit(half), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 38))
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    near = spark.range(50).select((F.col("id") + 200_000).alias("doc_id"), F.concat(text, F.lit("!")).alias("text"))
    got = line_dedup(df.union(near)).agg(F.sum("n_exact"), F.sum("n_near"), F.min(F.when(F.col("n_near") > 0, F.col("doc_id")))).first()
    assert tuple(got) == (0, 50, 200_000)


def test_one_word_of_a_long_line(spark, docs):
    line = " ".join(f"word{i:02d} of" for i in range(35))
    rows = [(1, line), (2, line.replace("word17", "ward71")), (3, line.replace("word20 of", "word20 in"))]
    three = LineParams(most_edits=3)
    assert [r["n_near"] for r in line_dedup(docs(*rows), three).orderBy("doc_id").collect()] == [0, 1, 1]
    assert sorted(r["doc_id"] for r in drop_lines(docs(*rows), three).collect()) == [1]
    # the default allows two edits, the first change has three
    assert [r["n_near"] for r in line_dedup(docs(*rows)).orderBy("doc_id").collect()] == [0, 0, 1]


def test_one_row_many_times(spark, docs):
    rows = [(1, "the very same row stands here")] * 400 + [(2, "the very same row stand here")]
    got = [(r["doc_id"], r["n_exact"], r["n_near"], r["n_links"]) for r in line_dedup(docs(*rows)).orderBy("doc_id").collect()]
    assert got == [(1, 0, 0, 1)] * 400 + [(2, 0, 1, 1)]
