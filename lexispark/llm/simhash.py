"""SimHash near-dedup with pivot distance tables.

Fingerprints of equal value are one node.  Nodes that may be within ``radius``
bits meet in buckets: the 64 bits are cut into radius + r blocks, of which at
least r agree, and each choice of r blocks is a bucket.  Within a bucket the table of
distances to the pivots (fixed reference fingerprints) discards every pair whose
coordinates differ by more than ``radius`` anywhere; survivors are verified by
their exact distance.  A bucket gives the edges of a spanning forest, never all
pairs of a dense group.  r follows the number of nodes, so that buckets stay
small; the result is the same for any r.  Buckets above ``hot`` nodes are dealt
anew with one more block, up to ``levels`` times.

Edges are merged into components by alternating star contraction, each round
written to the shared folder.

Edge cases: null and blank texts have fingerprint zero and link like any other;
a group's id is its smallest doc_id that is not null (null if all are);
repeated rows are copies of each other; rows of one doc_id with different texts
are different documents; an empty table gives no rows; other
columns are ignored; a text of any length is hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, wrapped
from .substring import odd_numbers

BITS = 64
PIECE = 20_000


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 4
    radius: int = 4
    hash_seed: int = 42
    pivots: int = 16
    pivot_seed: int = 29
    #: nodes up to which 1, 2, ... blocks make a bucket
    steps: tuple[int, ...] = (1_000_000, 150_000_000, 20_000_000_000)
    hot: int = 30_000
    levels: int = 3


def fingerprint(text: str | bytes | None, p: SimHashParams) -> int:
    """The fingerprint of one whole text as an unsigned integer."""
    from xxhash import xxh64_intdigest

    data = (text.encode("utf-8") if isinstance(text, str) else text or b"").lower()
    ws = data.split()
    if not ws:
        return 0
    data = b" ".join(ws)
    if len(ws) < p.shingle:
        return _majority(np.array([xxh64_intdigest(data, p.hash_seed)], np.uint64))
    ends = [e + i for i, e in enumerate(accumulate(map(len, ws)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[p.shingle - 1 :]
    seed, ones, n = p.hash_seed, np.zeros(BITS, np.int64), len(ends)
    for at in range(0, n, PIECE):
        h = np.array([xxh64_intdigest(data[a:b], seed) for a, b in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=False)], np.uint64)
        ones += _ones(h)
    return _pack(2 * ones > n)


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _pack(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _majority(h: np.ndarray) -> int:
    return _pack(2 * _ones(h) > len(h))


def fingerprints(docs: DataFrame, p: SimHashParams) -> DataFrame:
    """doc_id, sig (hash of the text), fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), p) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), pa.array(fps.view(np.int64))], names=["doc_id", "sig", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("sig"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, sig bigint, fp bigint")


def pivot_table(x: np.ndarray, p: SimHashParams) -> np.ndarray:
    """Distances of fingerprints to all pivots."""
    return np.bitwise_count(x[:, None] ^ odd_numbers(p.pivots, p.pivot_seed)[None, :]).astype(np.int16)


def bucket_edges(x: np.ndarray, p: SimHashParams) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket of distinct fingerprints."""
    t, r = pivot_table(x, p), p.radius
    left = np.argsort(t[:, 0], kind="stable")  # not reached yet, by the first coordinate
    out: list[tuple[int, int]] = []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            i = queue.pop()
            first = t[left, 0]
            lo, hi = np.searchsorted(first, t[i, 0] - r, "left"), np.searchsorted(first, t[i, 0] + r, "right")
            near = left[lo:hi]
            near = near[(np.abs(t[near] - t[i]) <= r).all(1)]
            near = near[np.bitwise_count(x[near] ^ x[i]) <= r]
            if near.size:
                out += [(int(i), int(j)) for j in near]
                queue += list(near)
                left = left[~np.isin(left, near)]
    return out


def small_edges(key: np.ndarray, x: np.ndarray, p: SimHashParams) -> tuple[np.ndarray, np.ndarray]:
    """All links within many small buckets at once, by shifting against each other."""
    t, r = pivot_table(x, p), p.radius
    order = np.lexsort((t[:, 0], key))
    key, x, t = key[order], x[order], t[order]
    at, shift, out_a, out_b = np.arange(len(x)), 1, [], []
    while True:
        at = at[at + shift < len(x)]
        at = at[(key[at] == key[at + shift]) & (t[at + shift, 0] - t[at, 0] <= r)]
        if not at.size:
            break
        close = at[(np.abs(t[at] - t[at + shift]) <= r).all(1)]
        close = close[np.bitwise_count(x[close] ^ x[close + shift]) <= r]
        out_a.append(x[close])
        out_b.append(x[close + shift])
        shift += 1
    none = np.zeros(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def blocks(width: int, n: int) -> list[tuple[int, int]]:
    """(offset, size) of ``n`` blocks of ``width`` bits."""
    cuts = [width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def bucket_keys(fp: Column, radius: int, agree: int) -> Column:
    """Array of bucket keys: one for each choice of ``agree`` of radius + agree blocks."""
    cut = blocks(BITS, radius + agree)
    keys = []
    for k, chosen in enumerate(combinations(cut, agree)):
        parts = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << n) - 1) for a, n in chosen]
        keys.append(F.xxhash64(F.lit(k), *parts))
    return F.array(*keys)


def links(nodes: DataFrame, p: SimHashParams) -> DataFrame:
    """Edges a, b between distinct fingerprints whose components are those of all links."""
    n = nodes.count()
    agree = 1 + sum(n > s for s in p.steps)
    entries = nodes.select(F.explode(bucket_keys(F.col("fp"), p.radius, agree)).alias("key"), "fp")
    dealt, current = [], entries.withColumn("base", F.col("key"))
    for more in range(1, p.levels + 1):
        large = stored(current.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > p.hot).select("key"), "hot")
        if large.isEmpty():
            break
        dealt.append(current.join(large, "key", "left_anti").select("key", "fp"))
        again = current.join(large, "key", "left_semi").select("base", "fp").distinct()
        finer = F.explode(bucket_keys(F.col("fp"), p.radius, agree + more)).alias("sub")
        current = again.select("base", "fp", finer).select(F.xxhash64("base", "sub").alias("key"), "fp", "base")
    entries = current.select("key", "fp")
    for part in dealt:
        entries = entries.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(key: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(head, len(key)))
            small = np.repeat(size <= 64, size)
            a, b = small_edges(key[small], x[small], p)
            pairs = [(a, b)]
            for h, s in zip(head[size > 64], size[size > 64], strict=True):
                own = x[h : h + s]
                e = np.array(bucket_edges(own, p), np.int64).reshape(-1, 2)
                pairs.append((own[e[:, 0]], own[e[:, 1]]))
            a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        keys, fps, rows = [], [], 0
        for batch in batches:
            keys.append(batch.column("key").to_numpy())
            fps.append(batch.column("fp").to_numpy().view(np.uint64))
            rows += batch.num_rows
            if rows >= 200_000:  # all but the last bucket, which may go on
                k, x = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(k, k[-1]))
                if cut:
                    yield from solved(k[:cut], x[:cut])
                keys, fps, rows = [k[cut:]], [x[cut:]], len(k) - cut
        if rows:
            yield from solved(np.concatenate(keys), np.concatenate(fps))

    found = entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for each node of ``edges`` (a, b, long): root is its component's smallest node.

    Alternating large and small stars; stops when a round changes nothing.
    """
    current, before = stored(edges.select("a", "b").filter(F.col("a") != F.col("b")), "edges"), None
    for _ in range(rounds):
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["u"]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y")).filter(F.col("x") != F.col("y")).distinct()
        down = large.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "u")
        small = large.join(down, large["x"] == down["u"]).select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct(F.col("x"), F.col("m").alias("y")))).alias("e")).select("e.x", "e.y")
        small = small.filter(F.col("x") != F.col("y")).distinct().select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        following = stored(small, "edges")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop_stored(current)
        current = following
        if state == before:
            return current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = state
    raise RuntimeError("components did not settle")


def labelled(docs: DataFrame, p: SimHashParams) -> DataFrame:
    """doc_id, sig (hash of the text), fp, and of its group: component_id, root_sig (of the document that stays)."""
    rows = stored(fingerprints(docs, p), "fingerprints")
    # the smallest document that has an id; documents without one come last
    least = lambda d, s: F.min(F.struct(F.col(d).isNull().alias("none"), F.col(d).alias("id"), F.col(s).alias("sig")))
    nodes = rows.groupBy("fp").agg(least("doc_id", "sig").alias("f")).select("fp", F.col("f.id").alias("first"), F.col("f.sig").alias("first_sig"))
    nodes = stored(nodes, "nodes")
    edges = stored(links(nodes.select("fp"), p), "links")
    if edges.isEmpty():
        ids = nodes.select(F.col("fp").alias("node"), F.col("first").alias("component_id"), F.col("first_sig").alias("root_sig"))
    else:
        roots = components(edges)
        known = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "first_sig", F.coalesce("root", "fp").alias("root"))
        best = known.groupBy("root").agg(least("first", "first_sig").alias("f")).select(F.col("root").alias("r"), F.col("f.id").alias("component_id"), F.col("f.sig").alias("root_sig"))
        ids = known.join(best, F.col("root") == F.col("r")).select(F.col("fp").alias("node"), "component_id", "root_sig")
    return rows.join(ids, rows["fp"] == ids["node"]).drop("node")


def near_duplicates(docs: DataFrame, params: SimHashParams | None = None) -> DataFrame:
    """doc_id, fp (signed long), component_id for each row of ``docs`` (doc_id, text)."""
    return labelled(docs, params or SimHashParams()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, params: SimHashParams | None = None) -> DataFrame:
    """``docs`` without near duplicates: of each group the document with the smallest doc_id stays, once."""
    found = labelled(docs, params or SimHashParams())
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sig") == F.col("root_sig"))).select(F.col("doc_id").alias("_kept"), F.col("sig").alias("_kept_sig")).distinct()
    taken = wrapped(docs, _id=F.col("doc_id"), _sig=F.xxhash64("text"))
    taken = taken.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_sig") == F.col("_kept_sig")), "left_semi")
    return taken.dropDuplicates(["_id", "_sig"]).select("_row.*")
