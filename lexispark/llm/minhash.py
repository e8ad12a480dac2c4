"""MinHash near-dedup with SuperMinHash signatures.

Documents with equal shingle sets are one node.  A node's signature has ``values``
places: every shingle walks through the places in an order of its own, and the place
it meets in step j is offered the value j plus a fraction; each place keeps its least.
Steps stop once no place can fall any more, after a few of them for long texts.
Values of one shingle never share a place, so estimates vary less than those of
independent hashes.

Nodes that agree on a band of the signature meet in a bucket.  A pair at the threshold
misses all 32 bands of 5 with a chance below 10^-8.  Within a bucket pairs whose
signatures agree too little to be linked (by six standard deviations) go, and a forest
over the others joins nodes to clusters, which hold every link.  Buckets above ``hot``
nodes must agree on a second band of those they share, which leaves hardly any pair
below 0.5 and misses less than one link in a million; a bucket that is dense even so
is part of one cluster as it is.

Links are confirmed on full sets, cluster by cluster: a task reaches all linked nodes
from one another, and tries every pair that might still join two components.  Clusters
above ``hot`` nodes or ``group_bytes`` are dealt out in chunks that share one node.
Then only what lies outside a cluster's largest component visits the other chunks.  So
no link is lost, and a group of linked nodes is never tried pair by pair; nodes that
agree as much as links do without being any are, which no bound of a set can spare.

Edges become components by alternating stars, each round written to the shared folder.

Edge cases: null and blank texts have an empty set, link with nothing and are their own
component; a text of fewer words than a shingle is one shingle; a component's id is its
smallest doc_id that is not null (null if all are); repeated rows are copies of each
other; rows of one doc_id with different texts are different documents; an empty table
gives no rows; other columns are ignored; a text of any length is hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, bloom
from .common import NULL_ID, stored
from .simhash import components
from .substring import hash_words, mixed, odd_numbers, rolled

U = np.uint64


@dataclass(frozen=True)
class MinHashParams:
    shingle: int = 5
    #: documents link if so many of 100 shingles of their union are common
    percent: int = 85
    values: int = 160
    rows: int = 5
    seed: int = 17
    #: nodes of a bucket that one task compares
    hot: int = 1000
    #: nodes of a bucket up to which all pairs that agree are edges of the cluster
    small: int = 6
    #: bytes of sets that one task holds
    group_bytes: int = 32 << 20
    #: bits of the filter of documents whose sets are read again
    max_bits: int = 1 << 28
    #: shingles that walk at once
    block: int = 100_000

    @property
    def least(self) -> int:
        """Agreeing values below which a pair can't be linked, by six standard deviations."""
        t = self.percent / 100
        return int(self.values * t - 6 * sqrt(self.values * t * (1 - t)))


def shingle_sets(texts: list[bytes], p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as 64-bit hashes, sorted within each text, and how many each text has."""
    h, size = hash_words([t.lower() for t in texts], p.seed)
    row = np.repeat(np.arange(len(size)), size)
    n = max(0, len(h) - p.shingle + 1)
    whole = row[:n] == row[p.shingle - 1 :] if n else np.zeros(0, bool)
    value, own = [rolled(h, p.shingle, p.seed + p.shingle)[whole]], [row[:n][whole]]
    begin = np.cumsum(size) - size
    for k in range(1, p.shingle):  # texts of k words
        short = np.flatnonzero(size == k)
        value.append(np.array([rolled(h[begin[i] : begin[i] + k], k, p.seed + k)[0] for i in short], np.uint64))
        own.append(short)
    v, r = np.concatenate(value), np.concatenate(own)
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.bincount(r[new], minlength=len(texts))


def walk(v: np.ndarray, row: np.ndarray, signature: np.ndarray, p: MinHashParams) -> None:
    """Let shingles ``v`` of the rows walk through the places of ``signature``."""
    m = p.values
    order, spread = np.tile(np.arange(m, dtype=np.uint8), (len(v), 1)), odd_numbers(m, p.seed + 1)
    flat, left = signature.reshape(-1), np.arange(len(v))
    for j in range(m):
        left = left[(signature.max(1) >> 24)[row[left]] >= j]  # other rows hold less than any value of this step
        if not left.size:
            break
        h = mixed(v[left] + spread[j])
        k = j + ((h & U(0xFFFFFFFF)) % U(m - j)).astype(np.int64)
        place = order[left, k]
        order[left, k] = order[left, j]
        np.minimum.at(flat, row[left] * m + place, (U(j << 24) | h >> U(40)).astype(np.uint32))


def signatures(v: np.ndarray, size: np.ndarray, p: MinHashParams) -> np.ndarray:
    """rows x values: step in the upper 8 bits, fraction in the lower 24."""
    out = np.full((len(size), p.values), 0xFFFFFFFF, np.uint32)
    row = np.repeat(np.arange(len(size)), size)
    for a in range(0, len(v), p.block):
        part = row[a : a + p.block]
        walk(v[a : a + p.block], part - part[0], out[part[0] : part[-1] + 1], p)
    return out


def band_keys(signature: np.ndarray, p: MinHashParams) -> np.ndarray:
    """rows x bands."""
    n = p.values // p.rows
    cut = signature[:, : n * p.rows].reshape(len(signature), n, p.rows).astype(np.uint64)
    return mixed((mixed(cut + U(1)) * odd_numbers(p.rows, p.seed + 2)).sum(2) + odd_numbers(n, p.seed + 3))


def set_hashes(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set; of no meaning for empty sets."""
    total = np.concatenate(([U(0)], np.cumsum(mixed(v))))
    ends = np.cumsum(size)
    return mixed(total[ends] - total[ends - size] + size.astype(np.uint64)).view(np.int64)


SKETCH = "doc_id bigint, sig bigint, n bigint, node bigint, keys array<bigint>, code binary"


def sketches(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """doc_id, sig (hash of the text), n (set size), node (hash of the set, null if empty), keys of the bands, code (a byte of each value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 200) for a in range(0, whole.num_rows, 200)):
                v, size = shingle_sets([t.as_py() or b"" for t in batch.column("text")], p)
                s = signatures(v, size, p)
                node = set_hashes(v, size)
                keys = band_keys(s, p)
                ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("sig"), pa.array(size, pa.int64()), pa.array(node, mask=size == 0), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel())), pa.array([x.tobytes() for x in s.astype(np.uint8)], pa.binary())],
                    names=["doc_id", "sig", "n", "node", "keys", "code"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("sig"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SKETCH)


def met(entries: DataFrame) -> DataFrame:
    """key, node, size of the entries (key, node) whose key has several nodes."""
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    return stored(entries.join(sizes, "key"), "met")


def compare(buckets: DataFrame, nodes: DataFrame, p: MinHashParams) -> DataFrame:
    """a, b: a forest over the pairs of each bucket (key, node) whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table) -> pa.RecordBatch:
            key, node = (t.column(c).to_numpy() for c in ("key", "node"))
            a, b = forest(key, node, np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(key), -1), p)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 20_000:  # all but the last bucket, which may go on
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield solved(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield solved(pa.Table.from_batches(held))

    full = buckets.join(nodes.select("node", "code"), "node").select("key", "node", "code")
    return full.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def shifted(key: np.ndarray, code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within small buckets whose codes agree enough, by shifting."""
    at, shift, i, j = np.arange(len(key)), 1, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        if not at.size:
            return np.concatenate(i), np.concatenate(j)
        near = at[(code[at] == code[at + shift]).sum(1) >= least]
        i.append(near)
        j.append(near + shift)
        shift += 1


def forest(key: np.ndarray, node: np.ndarray, code: np.ndarray, p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Small buckets give all pairs whose codes agree enough, others a forest over them."""
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(head, len(key)))
    few = np.flatnonzero(np.repeat(size <= p.small, size))
    i, j = shifted(key[few], code[few], p.least)
    out = [(node[few[i]], node[few[j]])]
    for h, n in zip(head[size > p.small], size[size > p.small], strict=True):
        left = np.arange(h, h + n)
        while left.size > 1:
            queue, left = [left[0]], left[1:]
            while queue and left.size:
                at = queue.pop()
                near = (code[left] == code[at]).sum(1) >= p.least
                if near.any():
                    reached, left = left[near], left[~near]
                    out.append((np.full(len(reached), node[at]), node[reached]))
                    queue += list(reached)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def members(docs: DataFrame, wanted: DataFrame, p: MinHashParams) -> DataFrame:
    """node, members (its sorted shingles) for the nodes of ``wanted`` (node, doc_id, sig), and for some others.

    A Bloom filter of the wanted documents stands where a join would shuffle all texts.
    """
    name = lambda doc_id, sig: F.xxhash64(F.coalesce(doc_id, F.lit(NULL_ID)), sig).alias("h")
    words = bloom(wanted.select(name("doc_id", "sig")), wanted.count(), p.max_bits)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bloom(shared.value)
        for whole in batches:
            left = whole.filter(pa.array(known.holds(whole.column("h").to_numpy().view(np.uint64))))
            for batch in (left.slice(a, 200) for a in range(0, left.num_rows, 200)):
                v, size = shingle_sets([t.as_py() or b"" for t in batch.column("text")], p)
                ends = np.cumsum(size)
                blobs = [v[e - n : e].tobytes() for e, n in zip(ends, size, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(v, size)), pa.array(blobs, pa.binary())], names=["node", "members"])

    rows = docs.select(name("doc_id", F.xxhash64("text")), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sets, "node bigint, members binary").groupBy("node").agg(F.first("members").alias("members"))


class Group:
    """Nodes that one task holds, with their components so far."""

    def __init__(self, p: MinHashParams):
        self.p, self.node, self.comp, self.aside, self.code, self.sets = p, [], [], [], [], []

    def add(self, node: int, comp: int, aside: bool, code: bytes, sets: bytes) -> None:
        self.node.append(node)
        self.aside.append(aside)
        self.comp.append(comp)
        self.code.append(np.frombuffer(code, np.uint8))
        self.sets.append(np.frombuffer(sets, np.uint64))

    def ready(self) -> None:
        self.ids, self.comps, self.codes = np.array(self.node, np.int64), np.array(self.comp, np.int64), np.array(self.code)
        self.sizes, self.asides = np.array([len(x) for x in self.sets]), np.array(self.aside, bool)

    def linked(self, code: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the nodes ``at`` link with a node of this code and set."""
        t, n = self.p.percent, self.sizes[at]
        at = at[(100 * n >= t * len(own)) & (100 * len(own) >= t * n)]
        at = at[(self.codes[at] == code).sum(1) >= self.p.least]
        if not at.size:
            return at
        both = np.concatenate([self.sets[i] for i in at])
        hit = own[np.minimum(np.searchsorted(own, both), len(own) - 1)] == both
        n = self.sizes[at]
        common = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
        return at[100 * common >= t * (len(own) + n - common)]

    def within(self) -> Iterator[tuple[int, int]]:
        """A forest over all links of the group."""
        left = np.arange(len(self.ids))
        while left.size > 1:
            queue, left = [left[0]], left[1:]
            while queue and left.size:
                i = queue.pop()
                near = self.linked(self.codes[i], self.sets[i], left)
                if near.size:
                    yield from ((self.node[i], self.node[j]) for j in near)
                    queue += list(near)
                    left = np.setdiff1d(left, near, assume_unique=True)


def confirmed(dealt: DataFrame, again: bool, p: MinHashParams) -> DataFrame:
    """a, b: links by full sets within the groups of ``dealt`` (key, visitor, aside, node, comp, code, members).

    First time: a forest within each group.  Again: visitors, one after the other,
    against the nodes of other components that the group holds; of two nodes that
    visit each other's groups the smaller one does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, open_ = None, Group(p), True
        names = ("key", "visitor", "aside", "node", "comp", "code", "members")

        def sent(pairs) -> Iterator[pa.RecordBatch]:
            pairs = list(pairs)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in pairs], pa.int64()), pa.array([max(x) for x in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            found: list[tuple[int, int]] = []
            for k, visitor, aside, node, comp, code, sets in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if k != key:
                    if not again and key is not None:
                        group.ready()
                        yield from sent(group.within())
                    key, group, open_ = k, Group(p), True
                if not visitor:
                    group.add(node, comp, aside, code, sets)
                    continue
                if open_:
                    group.ready()
                    open_ = False
                if group.node:
                    at = np.flatnonzero((group.comps != comp) & (~group.asides | (group.ids > node)))
                    found += [(node, group.node[j]) for j in group.linked(np.frombuffer(code, np.uint8), np.frombuffer(sets, np.uint64), at)]
            yield from sent(found)
        if not again and key is not None:
            group.ready()
            yield from sent(group.within())

    return stored(dealt.repartition("key").sortWithinPartitions("key", "visitor", "node").mapInArrow(run, "a bigint, b bigint"), "links")


def links(docs: DataFrame, nodes: DataFrame, p: MinHashParams) -> DataFrame:
    """Edges a, b between nodes (node, doc_id, sig, keys, code) whose components are those of all links."""
    own = met(nodes.select(F.explode("keys").alias("key"), "node"))
    large = F.col("size") > p.hot
    buckets, dense = own.filter(~large).select("key", "node"), own.filter(large)
    if not dense.isEmpty():
        shared = dense.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("k"))  # at most one for each band
        two = F.explode(F.flatten(F.transform("k", lambda x, i: F.transform(F.slice("k", i + 2, F.size("k")), lambda y: F.xxhash64(x, y)))))
        dense = met(shared.select(two.alias("key"), "node"))
        buckets, dense = buckets.unionByName(dense.filter(~large).select("key", "node")), dense.filter(large)
    tried = compare(buckets, nodes, p)
    least = dense.groupBy("key").agg(F.min("node").alias("a"))
    tried = stored(tried.unionByName(dense.join(least, "key").select("a", F.col("node").alias("b")).filter("a <> b").distinct()), "pairs")
    if tried.isEmpty():
        return tried
    clusters = components(tried).select("node", F.col("root").alias("cluster"))
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster").distinct())
    placed = clusters.join(nodes.select("node", "doc_id", "sig", "code"), "node")
    placed = stored(placed, "clusters")
    full = placed.select("node", "cluster", "code").join(members(docs, placed.select("node", "doc_id", "sig"), p), "node")
    sizes = full.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / p.hot), F.ceil(F.sum(F.length("members")) / p.group_bytes)).alias("chunks"), F.min("node").alias("anchor"))
    full = stored(full.join(sizes, "cluster"), "members")
    mark = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c")
    columns = ("key", "visitor", "aside", "node", "comp", "code", "members")
    plain = (F.lit(False).alias("visitor"), F.lit(False).alias("aside"), F.lit(0).cast("long").alias("comp"))
    # a cluster's anchor stands in each of its chunks, so that chunks of one group come together
    first = full.filter("node <> anchor").select("cluster", mark.alias("c"), "node", "code", "members").unionByName(full.filter("node = anchor").select("cluster", every, "node", "code", "members"))
    sure = confirmed(first.select(F.xxhash64("cluster", "c").alias("key"), *plain, "node", "code", "members").select(*columns), False, p)
    cut = full.filter("chunks > 1")
    if cut.isEmpty():
        return sure
    comp = cut.join(components(sure), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    counts = comp.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").drop("comps")
    rest = stored(comp.join(main, "cluster").withColumn("aside", F.col("comp") != F.col("main")).withColumn("own", mark), "aside")
    visits = rest.filter("aside").select("*", every).filter("c <> own").withColumn("visitor", F.lit(True))
    second = visits.unionByName(rest.withColumns({"c": F.col("own"), "visitor": F.lit(False)}))
    return sure.unionByName(confirmed(second.withColumn("key", F.xxhash64("cluster", "c")).select(*columns), True, p))


def near_duplicates(docs: DataFrame, params: MinHashParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    p = params or MinHashParams()
    rows = stored(sketches(docs, p), "sketches")
    least = lambda d, *rest: F.min(F.struct(F.col(d).isNull().alias("none"), F.col(d).alias("id"), *rest))
    nodes = stored(rows.filter("node IS NOT NULL").groupBy("node").agg(least("doc_id", "sig", "keys", "code").alias("f")).select("node", F.col("f.id").alias("doc_id"), "f.sig", "f.keys", "f.code"), "nodes")
    edges = links(docs, nodes.select("node", "doc_id", "sig", "keys", "code"), p)
    if edges.isEmpty():
        ids = nodes.select("node", F.col("doc_id").alias("first"))
    else:
        known = nodes.select("node", "doc_id").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        best = known.groupBy("root").agg(least("doc_id").alias("f")).select("root", F.col("f.id").alias("first"))
        ids = known.join(best, "root").select("node", "first")
    found = rows.select("doc_id", "n", "node").join(ids.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
