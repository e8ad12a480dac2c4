"""A maintained full-text index: positional trigram postings in segments, with score bounds.

A segment holds some documents of similar length; its postings of a trigram are one
block: documents and positions, the greatest number of hits and the least length.  A
term is covered by every third of its trigrams and the last one, so where these stand
at their offsets the term stands, and its hits are counted without reading a text.

Blocks end a search early: no document of a block scores more than its greatest number
of hits at its least length.  A first pass scores the few segments of highest bound;
the worst of the best rows found there is a threshold, and segments bounded below it
are skipped.

The index follows a table: ``refresh`` takes what changed between the version it knows
and the current one, whoever wrote it.  New rows make new segments, whose blocks are
added to the buckets of their trigrams; rows that left are tombstones in their segment.
Both count from one commit of the segment table on, which also notes the version and
the totals; blocks of segments it doesn't know are ignored.  ``compact`` writes the
segments with many tombstones anew and puts the files of each bucket together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import search, snippets
from .merge import Manifest, Table

SEGMENT_DOCS, HELD_DOCS, HELD_CHARS = 256, 4096, 1 << 23
#: Places between the columns of a row, so that no term reaches from one to the next.
GAP = 8
#: Segments of highest bound that the first pass scores for a query.
SEEDS = 4
SLACK = 1e-6

POSTINGS = "gram bigint, segment bigint, docs binary, places binary, n_docs int, max_tf int, min_len bigint"
SEGMENTS = "segment bigint, keys array<string>, lens array<bigint>, dead array<int>"
PLACES = "key string, segment bigint, place int, len bigint"
RAW = f"{POSTINGS}, keys array<string>, lens array<bigint>"
FOUND = "term string, segment bigint, docs array<int>, tf array<int>, lens array<bigint>, df bigint, max_tf int, min_len bigint"
FOUND_NAMES = ["term", "segment", "docs", "tf", "lens", "df", "max_tf", "min_len"]
FOUND_TYPES = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64())
#: About as many queries share a pass over the texts.
CHUNK_QUERIES = 1 << 14


class Overtaken(RuntimeError):
    """Another writer refreshed the index first."""


def packed(a: Column, b: Column, c: Column) -> Column:
    """A trigram as a number: 21 bits for each code point."""
    return F.ascii(a).cast("long").bitwiseOR(F.shiftleft(F.ascii(b).cast("long"), 21)).bitwiseOR(F.shiftleft(F.ascii(c).cast("long"), 42))


def cover(term: Column) -> Column:
    """offset and gram of every third trigram of a folded term and of its last one."""
    last = F.length(term) - 3
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(3)), F.array(last)))
    at = lambda i, k: F.substring(term, i + k, F.lit(1))
    return F.transform(starts, lambda i: F.struct(i.alias("offset"), packed(at(i, 1), at(i, 2), at(i, 3)).alias("gram")))


def segment_id(keys: list[str], salt: int) -> np.int64:
    from xxhash import xxh64_intdigest

    return np.uint64(xxh64_intdigest("\0".join(keys), seed=salt & (2**64 - 1))).astype(np.int64)


def segment_postings(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """gram, doc and place of all trigrams of some texts in this order, where each gram starts, and the texts' lengths."""
    points, doc, places, lens = [], [], [], []
    for i, columns in enumerate(texts):
        at, n = 0, 0
        for text in columns:
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if len(c) > 2:
                points.append(c[:-2] | c[1:-1] << 21 | c[2:] << 42)
                doc.append(np.full(len(c) - 2, i, np.uint16))
                places.append(np.arange(at, at + len(c) - 2, dtype=np.uint32))
            n += max(0, len(c) - 2)
            at += len(c) + GAP
        lens.append(n)
    if not points:
        points, doc, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint32)]
    gram, doc, places = np.concatenate(points), np.concatenate(doc), np.concatenate(places)
    order = np.argsort(gram, kind="stable")  # within a gram by document and place
    gram, doc, places = gram[order], doc[order], places[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1])))
    return gram, doc, places, head, lens


def segment_rows(keys: list[str], texts: list[list[str]], salt: int) -> pa.RecordBatch:
    """The blocks of one segment, and the segment itself in a row without a gram."""
    gram, doc, places, head, lens = segment_postings(texts)
    segment, lengths = segment_id(keys, salt), np.array(lens, np.int64)
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(gram)), bool), (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]))))
    tf = np.diff(np.append(new, len(gram)))
    first = np.searchsorted(new, head)
    k = len(head)
    ends = np.append(head, len(gram))

    def blobs(x: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])

    none = np.zeros(0, np.int64)
    bounds = (np.diff(np.append(first, len(new))), np.maximum.reduceat(tf, first), np.minimum.reduceat(lengths[doc[new]], first)) if k else (none, none, none)
    blocks = [pa.array(gram[head]), pa.array(np.full(k, segment)), blobs(doc), blobs(places), pa.array(bounds[0], pa.int32()), pa.array(bounds[1], pa.int32()), pa.array(bounds[2], pa.int64()), pa.nulls(k, pa.list_(pa.string())), pa.nulls(k, pa.list_(pa.int64()))]
    own = [pa.nulls(1, pa.int64()), pa.array([segment]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([keys], pa.list_(pa.string())), pa.array([lens], pa.list_(pa.int64()))]
    names = ["gram", "segment", "docs", "places", "n_docs", "max_tf", "min_len", "keys", "lens"]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(blocks, own, strict=True)], names=names)


def folded(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("key"), *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"c{i}") for i, c in enumerate(columns)])


def dealt(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[str], list[list[str]]]]:
    """Keys and texts of each segment of a task's documents."""
    held: list[tuple[str, list[str]]] = []
    chars = 0

    def sent() -> Iterator[tuple[list[str], list[list[str]]]]:
        held.sort(key=lambda x: (sum(map(len, x[1])), x[0]))  # bounds are close where lengths are
        at = 0
        while at < len(held):
            n, size = 0, 0
            while at + n < len(held) and n < SEGMENT_DOCS and (size < HELD_CHARS or not n):
                size += sum(map(len, held[at + n][1]))
                n += 1
            yield [k for k, _ in held[at : at + n]], [t for _, t in held[at : at + n]]
            at += n

    for batch in batches:
        texts = [batch.column(f"c{i}").to_pylist() for i in range(width)]
        for k, *own in zip(batch.column("key").to_pylist(), *texts, strict=True):
            held.append((k, own))
            chars += sum(map(len, own))
            if len(held) >= HELD_DOCS or chars >= HELD_CHARS:
                yield from sent()
                held, chars = [], 0
    if held:
        yield from sent()


def build(rows: DataFrame, key: str, columns: tuple[str, ...], salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """Blocks and segments of ``rows``, written once."""
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in dealt(batches, width):
            yield segment_rows(keys, texts, salt)

    raw = written(folded(rows, key, columns).mapInArrow(run, RAW).withColumn("kind", F.when(F.col("gram").isNull(), "segment").otherwise("block")), "segments", "kind")
    segments = raw.filter("kind = 'segment'").select("segment", "keys", "lens", F.array().cast("array<int>").alias("dead"))
    return raw.filter("kind = 'block'").select("gram", "segment", "docs", "places", "n_docs", "max_tf", "min_len"), segments


def standing(term: str, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a term and its hits in each, from offset, documents and places of its trigrams."""
    sets = sorted(((doc.astype(np.int64) << 32) + place - offset for offset, doc, place in parts), key=len)
    at = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sets)
    return np.unique((at + len(term)) >> 32, return_counts=True)


def counted(rows: DataFrame, key: str, columns: tuple[str, ...], terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``term_blocks`` finds for ``terms``, and the segments: a segment's postings are looked up where they are made, and kept nowhere."""
    width = len(columns)
    pieces = terms.select("term", cover(F.col("term")).alias("pieces")).collect()  # of CHUNK_QUERIES queries at most
    shared = rows.sparkSession.sparkContext.broadcast([(r["term"], [(x["offset"], x["gram"]) for x in r["pieces"]]) for r in pieces])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        wanted = np.unique(np.array([g for _, own in asked for _, g in own], np.int64))
        for keys, texts in dealt(batches, width):
            gram, doc, places, head, lens = segment_postings(texts)
            segment, lengths, ends = int(segment_id(keys, 0)), np.array(lens, np.int64), np.append(head, len(gram))
            _, mine, at = np.intersect1d(wanted, gram[head], assume_unique=True, return_indices=True)
            met = dict(zip(wanted[mine].tolist(), zip(ends[at].tolist(), ends[at + 1].tolist(), strict=True), strict=True))
            out = [(None, segment, None, None, lens, None, None, None, keys)]
            for term, own in asked:
                if not all(g in met for _, g in own):
                    continue
                docs, tf = standing(term, [(offset, doc[a:z], places[a:z]) for offset, g in own for a, z in [met[g]]])
                if len(docs):
                    size = lengths[docs]
                    out.append((term, segment, docs.tolist(), tf.tolist(), size.tolist(), len(docs), int(tf.max()), int(size.min()), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (*FOUND_TYPES, pa.list_(pa.string())), strict=True)], names=[*FOUND_NAMES, "keys"])

    raw = written(folded(rows, key, columns).mapInArrow(run, f"{FOUND}, keys array<string>").withColumn("kind", F.when(F.col("term").isNull(), "segment").otherwise("found")), "term-blocks", "kind")
    segments = raw.filter("kind = 'segment'").select("segment", "keys", "lens")
    return raw.filter("kind = 'found'").select(*FOUND_NAMES), segments


# -- searching


def term_blocks(terms: DataFrame, blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """term, segment, docs and tf (of its living documents with the term), df, max_tf, min_len."""
    pieces = terms.select("term", F.explode(cover(F.col("term"))).alias("x")).select("term", "x.offset", "x.gram")
    need = terms.select("term", F.size(cover(F.col("term"))).alias("need"))
    met = pieces.join(blocks, "gram").groupBy("term", "segment").agg(F.collect_list(F.struct("offset", "docs", "places")).alias("pieces"))  # as many as a term has grams
    full = met.join(need, "term").filter(F.size("pieces") == F.col("need")).join(segments.select("segment", "lens", "dead"), "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for term, segment, parts, lens, dead in zip(*(batch.column(c).to_pylist() for c in ("term", "segment", "pieces", "lens", "dead")), strict=True):
                doc, tf = standing(term, [(x["offset"], np.frombuffer(x["docs"], np.uint16), np.frombuffer(x["places"], np.uint32)) for x in parts])
                alive = ~np.isin(doc, np.array(dead or [], np.int64))
                doc, tf = doc[alive], tf[alive]
                if len(doc):
                    own = np.array(lens, np.int64)[doc]
                    out.append((term, segment, doc.tolist(), tf.tolist(), own.tolist(), len(doc), int(tf.max()), int(own.min())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), FOUND_TYPES, strict=True)], names=FOUND_NAMES)

    return full.select("term", "segment", "pieces", "lens", "dead").mapInArrow(run, FOUND)


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id and terms of the queries (query_id, keyword) that can hit: all terms have three characters at least."""
    clean = F.translate(F.col("keyword"), search.WIDE, search.NARROW)
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, r'[\r\n\t"*:()]', " "), f"{search.BLANKS}+", " "))
    asked = queries.select("query_id", F.filter(F.split(F.lower(clean), " "), lambda t: t != "").alias("terms")).filter(F.size("terms") > 0)
    return asked.filter(F.forall("terms", lambda t: F.length(t) >= 3))


def distinct_terms(queries: DataFrame) -> DataFrame:
    return asked_terms(queries).select(F.explode("terms").alias("term")).distinct()


def bounded(queries: DataFrame, found: DataFrame, n: Column, mean: Column) -> DataFrame:
    """query_id, segment, bound (of a document's score there), parts (idf, docs, tf, lens of each term), turn (1: highest bound)."""
    asked = asked_terms(queries)
    wanted = asked.select("query_id", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    df = found.groupBy("term").agg(F.sum("df").alias("all"))
    scored = found.join(df, "term").withColumn("idf", search.idf(n, F.col("all")))
    most = search.term_score(F.col("max_tf"), F.col("all"), n, F.col("min_len"), mean)
    per = wanted.join(scored.withColumn("most", most), "term").groupBy("query_id", "segment").agg(
        F.sum("most").alias("bound"), F.collect_list(F.struct("idf", "docs", "tf", "lens")).alias("parts"), F.first("size").alias("size"))  # one for each term
    per = per.filter(F.size("parts") == F.col("size"))
    return per.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment"))).drop("size")


def scores(rows: DataFrame, mean: float) -> DataFrame:
    """query_id, segment, place, score of the documents that all terms hit."""
    k1, b = search.K1, search.B

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, segment, place, score = [], [], [], []
            for r, (s, parts) in enumerate(zip(batch.column("segment").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                docs = reduce(np.intersect1d, [np.array(x["docs"], np.int64) for x in parts])
                total = np.zeros(len(docs))
                for x in parts:
                    at = np.searchsorted(np.array(x["docs"], np.int64), docs)
                    tf, lens = np.array(x["tf"], float)[at], np.array(x["lens"], float)[at]
                    total += x["idf"] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / mean))
                query += [r] * len(docs)
                segment += [s] * len(docs)
                place += docs.tolist()
                score += total.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(query, pa.int64())), pa.array(segment, pa.int64()), pa.array(place, pa.int32()), pa.array(score, pa.float64())], names=["query_id", "segment", "place", "score"])

    kind = rows.schema["query_id"].dataType.simpleString()
    return rows.select("query_id", "segment", "parts").mapInArrow(run, f"query_id {kind}, segment bigint, place int, score double")


def top(queries: DataFrame, blocks: DataFrame, segments: DataFrame, n: int, total: int, limit: int, kind: str = "string") -> tuple[DataFrame, DataFrame]:
    """The best rows of each query (query_id, key of type ``kind``, rank, position); and turn and bound of each segment with whether it was scored."""
    found = written(term_blocks(distinct_terms(queries), blocks, segments), "term-blocks")
    return best(queries, found, segments, n, total, limit, kind)


def best(queries: DataFrame, found: DataFrame, segments: DataFrame, n: int, total: int, limit: int, kind: str = "string") -> tuple[DataFrame, DataFrame]:
    """``top`` of what was found for each term."""
    mean = total / n if n else 1.0
    plan = written(bounded(queries, found, F.lit(n), F.lit(mean)), "bounds")
    first = written(scores(plan.filter(F.col("turn") <= SEEDS), mean), "seeds")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    floor = first.withColumn("r", F.row_number().over(by_score)).filter(F.col("r") == limit).select("query_id", F.col("score").alias("floor"))
    seen = plan.join(floor, "query_id", "left").withColumn("scored", (F.col("turn") <= SEEDS) | F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
    rest = scores(seen.filter(F.col("scored") & (F.col("turn") > SEEDS)), mean)
    hits = first.unionByName(rest)
    # more than ``limit`` rows of a segment can't be among the best, but for ties
    near = hits.withColumn("r", F.rank().over(Window.partitionBy("query_id", "segment").orderBy(F.round("score", 9).desc()))).filter(F.col("r") <= limit)
    named = near.join(segments.select("segment", "keys"), "segment").select("query_id", F.element_at("keys", F.col("place") + 1).cast(kind).alias("key"), (-F.round("score", 9)).alias("rank"))
    ranked = named.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key")))
    return ranked.filter(F.col("position") <= limit), seen.select("query_id", "segment", "turn", "bound", "scored")


def search_once(rows: DataFrame, queries: DataFrame, key: str, columns: tuple[str, ...], limit: int = search.LIMIT) -> DataFrame:
    """``top`` without a kept index: postings are made for some queries at a time and never leave their task; keys keep their type."""
    chunks = max(1, -(-queries.count() // CHUNK_QUERIES))
    out = []
    for i in range(chunks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == i) if chunks > 1 else queries
        found, segments = counted(rows, key, columns, distinct_terms(own))
        n, total = segments.agg(F.sum(F.size("keys")), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        out.append(best(own, found, segments, n or 0, total or 0, limit, rows.schema[key].dataType.simpleString())[0])
    return reduce(DataFrame.unionByName, out)


def shown(found: DataFrame, queries: DataFrame, rows: DataFrame, key: Column, column: str) -> DataFrame:
    """The rows of a search (query_id, key, ...) with the snippet of ``column``; only texts of found rows are read into windows."""
    texts = rows.select(key.alias("key"), F.col(column).alias("_text"))
    asked = found.join(asked_terms(queries).withColumnRenamed("terms", "_terms"), "query_id").join(texts, "key")
    return asked.select(*found.columns, snippets.snippet(F.col("_text"), F.col("_terms")).alias("snippet"))


# -- maintenance


class SearchIndex:
    """The index of ``columns`` of a table, kept under ``root/name``."""

    def __init__(self, spark: SparkSession, root: str, name: str, table: Table, columns: tuple[str, ...], buckets: int = 64):
        self.spark, self.table, self.columns = spark, table, columns
        self.postings = Table(spark, root, f"{name}/postings", POSTINGS, ("gram",), table.version, buckets)
        self.segments = Table(spark, root, f"{name}/segments", SEGMENTS, ("segment",), table.version, max(1, buckets // 4))
        self.places = Table(spark, root, f"{name}/places", PLACES, ("key",), table.version, buckets)

    def key(self) -> Column:
        return F.concat_ws("/", *[F.col(k).cast("string") for k in self.table.keys])

    def refresh(self) -> int:
        """Bring the index to the table's current version; returns how many rows came and left."""
        own, now = self.segments.manifest(), self.table.manifest().number
        since = own.meta.get("source", 0)
        if since == now:
            return 0
        if since and since not in self.table.versions():  # its files are gone
            return self.rebuild()
        changed = written(self.table.changes(since, now).select(self.key().alias("key"), *self.columns, "_added"), "changes")
        if since and self.places.manifest().meta.get("source") != since:  # a refresh ended early
            self._place_all(own)
        blocks, segments = build(changed.filter("_added"), "key", self.columns, salt=now)
        gone = self.places.read().join(changed.filter("NOT _added").select("key"), "key", "left_semi")
        gone = written(gone, "gone")
        left, left_len = gone.agg(F.count("*"), F.sum("len")).first()
        came, came_len = segments.agg(F.sum(F.size("keys")), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        self.postings.append(blocks)
        marks = gone.groupBy("segment").agg(F.collect_set("place").alias("more"))  # at most the documents of a segment
        marked = self.segments.read(own.number).join(marks, "segment").select("segment", "keys", "lens", F.array_sort(F.array_union("dead", "more")).alias("dead"))
        meta = {"source": now, "n": own.meta.get("n", 0) + (came or 0) - left, "total": own.meta.get("total", 0) + (came_len or 0) - (left_len or 0)}
        self.segments.merge(marked.unionByName(segments), meta=lambda base: self._still(base, since) or meta)
        self.places.merge(self._places(segments), gone=gone, meta=lambda _: {"source": now})
        return (came or 0) + left

    @staticmethod
    def _still(base: Manifest, since: int) -> None:
        if base.meta.get("source", 0) != since:
            raise Overtaken(f"index at version {base.meta.get('source')}, not {since}")

    @staticmethod
    def _places(segments: DataFrame) -> DataFrame:
        each = segments.select("segment", "lens", "dead", F.posexplode("keys").alias("place", "key"))
        return each.filter(~F.array_contains("dead", F.col("place"))).select("key", "segment", "place", F.get("lens", F.col("place")).alias("len"))

    def _place_all(self, own: Manifest) -> None:
        self.places.overwrite(self._places(self.segments.read(own.number)), {"source": own.meta["source"]})

    def rebuild(self) -> int:
        """The index made anew from the whole table."""
        m = self.table.manifest()
        rows = self.table.read(m.number).select(self.key().alias("key"), *self.columns)
        blocks, segments = build(rows, "key", self.columns, salt=m.number)
        n, total = segments.agg(F.sum(F.size("keys")), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        self.postings.append(blocks)
        self.segments.overwrite(segments, {"source": m.number, "n": n or 0, "total": total or 0})
        self._place_all(self.segments.manifest())
        self.postings.overwrite(blocks)
        return n or 0

    def compact(self, dead_share: float = 0.2) -> int:
        """Segments with many tombstones are written anew, the buckets' files put together without blocks of lost segments."""
        own = self.segments.manifest()
        if self.refresh():
            own = self.segments.manifest()
        worn = self.segments.read(own.number).filter(F.size("dead") > dead_share * F.size("keys"))
        worn = written(worn.select("segment", "keys", "dead"), "worn")
        rows = self.table.read(own.meta["source"]).select(self.key().alias("key"), *self.columns)
        alive = worn.select(F.posexplode("keys").alias("place", "key"), "dead").filter(~F.array_contains("dead", F.col("place"))).select("key")
        blocks, segments = build(rows.join(alive, "key", "left_semi"), "key", self.columns, salt=-own.number)
        self.postings.append(blocks)
        self.segments.merge(segments, gone=worn, meta=lambda base: self._still(base, own.meta["source"]) or base.meta)
        self.places.merge(self._places(segments), meta=lambda base: base.meta)
        kept = self.segments.read()
        return self.postings.compact(keep=lambda d: d.join(kept.select("segment"), "segment", "left_semi"))

    def blocks_of(self, queries: DataFrame) -> DataFrame:
        """The postings of the buckets that the queries' trigrams fall into."""
        grams = asked_terms(queries).select(F.explode("terms").alias("term")).select(F.explode(cover(F.col("term"))).alias("x")).select(F.col("x.gram").alias("gram"))
        wanted = {r[0] for r in grams.select(self.postings.bucket()).distinct().collect()}  # at most the number of buckets
        m = self.postings.manifest()
        return self.postings.rows([f for b in sorted(wanted) for f in m.files.get(b, [])])

    def search(self, queries: DataFrame, limit: int = search.LIMIT) -> tuple[DataFrame, DataFrame]:
        """``top`` for queries (query_id, keyword) at the table's current version."""
        self.refresh()
        own = self.segments.manifest()
        return top(queries, self.blocks_of(queries), self.segments.read(own.number), own.meta.get("n", 0), own.meta.get("total", 0), limit)
