"""Phrase collocation mining: an FM-index per shard over word ids, counts summed across shards.

A shard is the word ids of some texts of one language, about ``shard_bytes`` of them,
with a 0 between pieces.  Its index holds the Burrows-Wheeler transforms of the
sequence and of its reverse, both ordered by the first few ids only, which is all
that phrases of that length need.  A phrase is an interval in each; it is extended by
every word that stands left of it (or right of it) at once, and the other interval
follows, so extensions may change sides.

Counts grow no more as phrases do, so what is too rare is cut before it is extended:
words first, then pairs, then longer phrases.  What is frequent is known only across
shards and grows with the corpus; the shards get it as Bloom filters of at most
``max_bits`` bits.  A full filter lets more phrases pass, which costs time and never
changes a count.  Most phrases are rare, so those of all sizes but the last are first
counted by 32 bits of a hash within a part, packed, which only tells what goes into the
filter; the last pass counts what the filters let pass by its words, which a shard sends
packed by part as well.

Edge cases: null text is empty; a null lang counts as ``und``; repeated rows count
each time; a piece is never cut, however long; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import Bloom, bloom
from .common import partitions, stored
from .substring import mixed

U = np.uint64
#: Pieces end at these; words end at blanks and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(ENDS))
#: Rows sent at once.
ROWS = 1 << 16
#: Counts of a part that are held before those of equal phrases are summed.
HELD = 1 << 19


@dataclass(frozen=True)
class PhraseParams:
    min_count: int = 30
    most_words: int = 4
    #: a phrase goes if a longer one around it has this share of its occurrences
    covered_percent: int = 80
    scale: int = 2_000_000
    #: phrases reported of each language
    top: int = 2000
    shard_bytes: int = 3 << 20
    max_bits: int = 1 << 28
    #: word occurrences of the corpus for each part by which phrases are counted
    part_words: int = 4_000_000


class FMIndex:
    """Of a sequence of ids with a 0 at both ends and between pieces, for patterns of up to ``depth`` ids."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.sides = [self._side(ids, depth), self._side(ids[::-1], depth)]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(ids))))

    @staticmethod
    def _side(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The transform, and its rows in the order of (symbol, row)."""
        rank, known = ids.astype(np.uint64), 1
        while known < depth:  # order by twice as many ids
            key = rank << U(32) | np.roll(rank, -known)
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([0], np.diff(key[order]) != 0))
            rank = np.empty(len(ids), np.uint64)
            rank[order] = np.cumsum(new)
            known *= 2
        order = np.argsort(rank, kind="stable")
        last = ids[order - 1].astype(np.uint64)
        return last, np.sort(last << U(32) | np.arange(len(ids), dtype=np.uint64))

    def words(self) -> Patterns:
        """The patterns of one id."""
        size = np.diff(self.first)
        own = np.flatnonzero(size)
        own = own[own > 0]
        return Patterns(own[:, None], [self.first[own], self.first[own]], size[own])

    def extended(self, p: Patterns, side: int) -> Patterns:
        """All patterns with one more id on the left (side 0) or right (side 1)."""
        last, rows = self.sides[side]
        end = np.cumsum(p.size)
        at = np.repeat(p.low[side] - (end - p.size), p.size) + np.arange(int(p.size.sum()))
        key, count = np.unique(np.repeat(np.arange(len(p.size), dtype=np.uint64), p.size) << U(32) | last[at], return_counts=True)
        owner, symbol = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)
        before = np.cumsum(count) - count - (end - p.size)[owner]  # of smaller symbols next to the same pattern
        own = symbol > 0
        owner, symbol, count, before = owner[own], symbol[own], count[own], before[own]
        low: list[np.ndarray] = [p.low[0], p.low[1]]
        low[side] = np.searchsorted(rows, symbol.astype(np.uint64) << U(32) | p.low[side][owner].astype(np.uint64))
        low[1 - side] = p.low[1 - side][owner] + before
        ids = [symbol[:, None], p.ids[owner]]
        return Patterns(np.hstack(ids if side == 0 else ids[::-1]), low, count)


@dataclass
class Patterns:
    """Ids of each pattern, the begin of its intervals in both indexes, and its occurrences."""

    ids: np.ndarray
    low: list[np.ndarray]
    size: np.ndarray

    def taken(self, own: np.ndarray) -> Patterns:
        return Patterns(self.ids[own], [x[own] for x in self.low], self.size[own])


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seed = xxh64_intdigest(lang)
    return np.array([xxh64_intdigest(w, seed) for w in words], np.uint64)


def gram_hashes(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A hash of each row of ids from the hashes of its words."""
    out = h[ids[:, 0]]
    for column in ids.T[1:]:
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[column])
    return out


def shard_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts (id i stands for word i - 1) and their ids, 0 at both ends and between pieces."""
    data = b" \n ".join([b"", *(t.translate(PLAIN).replace(b"\n", b" \n ") for t in texts), b""])
    tokens = pc.split_pattern(pa.array([data.decode("utf-8", "replace")], pa.large_string()), " ").flatten().dictionary_encode()
    words, at = tokens.dictionary, tokens.indices.to_numpy()
    blank, stop = (pc.index(words, pa.scalar(x, pa.large_string())).as_py() for x in ("", "\n"))
    own = np.setdiff1d(np.arange(len(words)), [blank, stop])
    number = np.zeros(len(words), np.int32)
    number[own] = np.arange(1, len(own) + 1)
    ids = number[at[at != blank]]
    return words.take(pa.array(own)).cast(pa.string()), joined(ids)


def joined(ids: np.ndarray) -> np.ndarray:
    """``ids`` without zeros after zeros, and one at both ends."""
    ids = np.concatenate(([0], ids, [0])).astype(np.int32)
    return ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))]


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids, compressed: all shards of a task are held on both sides of the step that reads them."""
    return len(ids).to_bytes(8, "little") + pa.compress(ids.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def ids_of(packed: pa.BinaryScalar) -> np.ndarray:
    data = packed.as_buffer()
    return np.frombuffer(pa.decompress(data.slice(8), 4 * int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), codec="zstd"), "<i4")


SHARD = "lang string, words array<string>, counts binary, ids binary, n bigint"
COUNTED = "lang string, phrase string, size int, n bigint"


def shards(docs: DataFrame, p: PhraseParams) -> DataFrame:
    """lang, words, counts of the words, ids, n (number of word occurrences) of each shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def row(lang: str) -> pa.RecordBatch:
            words, ids = shard_of(held.pop(lang))
            size.pop(lang)
            counts = np.bincount(ids, minlength=len(words) + 1)[1:].astype("<i8")
            columns = ([lang], [words.to_pylist()], [counts.tobytes()], [packed_ids(ids)], [int(counts.sum())])
            kinds = (pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "words", "counts", "ids", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                data = text.as_py() or b""
                held.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data) + 100
                if size[lang] >= p.shard_bytes:
                    yield row(lang)
                elif sum(size.values()) >= 4 * p.shard_bytes:  # very many languages
                    yield row(max(size, key=size.__getitem__))
        for lang in list(held):
            yield row(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(build, SHARD)


def counted(lang: str, size: int, n: np.ndarray, phrases) -> Iterator[pa.RecordBatch]:
    """Counts as rows, some at a time; ``phrases`` gives the texts from one place to another."""
    for a in range(0, len(n), ROWS):
        k = len(n[a : a + ROWS])
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, k), phrases(a, a + k), pa.repeat(pa.scalar(size, pa.int32()), k), pa.array(n[a : a + k], pa.int64())], names=["lang", "phrase", "size", "n"])


def summed(found: DataFrame, p: PhraseParams) -> DataFrame:
    """Counts across shards, of phrases that are frequent.

    A shard has counted its own phrases, so counts are dealt out as they are: a task's
    shards have few phrases in common, and a hash map of them all would fill its memory.
    """
    return stored(found.repartition("lang", "phrase", "size").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.min_count), "phrases")


def word_counts(index: DataFrame, p: PhraseParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column("words")[r].values
                yield from counted(batch.column("lang")[r].as_py(), 1, np.frombuffer(batch.column("counts")[r].as_py(), "<i8"), lambda a, z, own=own: own[a:z])

    return summed(index.select("lang", "words", "counts").mapInArrow(run, COUNTED), p)


def filter_of_words(frequent: DataFrame, p: PhraseParams) -> np.ndarray:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in set(batch.column("lang").to_pylist()):
                words = batch.filter(pc.equal(batch.column("lang"), lang)).column("phrase").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(word_hashes(lang, words).view(np.int64))], names=["h"])

    return bloom(frequent.select("lang", "phrase").mapInArrow(hashes, "h bigint"), frequent.count(), p.max_bits)


@dataclass
class Filters:
    """Bloom filters of frequent words, pairs and longer phrases, in this order."""

    words: list[np.ndarray]
    parts: int

    def ready(self) -> list[Bloom]:
        return [Bloom(w) for w in self.words]

    def cell(self, h: np.ndarray) -> np.ndarray:
        """The part of a hash and 32 of its bits: what phrases are counted by before they are known to be frequent."""
        return (h % U(self.parts)) << U(32) | h >> U(32)


def phrases_of(lang: str, own: pa.Array, ids: np.ndarray, deepest: int, f: Filters, known: list[Bloom]) -> Iterator[tuple[int, Patterns, np.ndarray]]:
    """Size, patterns and hashes of a shard's phrases up to ``deepest`` words that the filters let pass."""
    h = np.concatenate((np.zeros(1, np.uint64), word_hashes(lang, own.to_pylist())))
    ids = joined(np.where(np.concatenate(([False], known[0].holds(h[1:])))[ids], ids, 0))
    if len(known) > 1:  # cut between the words of pairs that are too rare
        cut = np.flatnonzero((ids[1:] == 0) | (ids[:-1] == 0) | ~known[1].holds(f.cell(gram_hashes(h, np.stack((ids[:-1], ids[1:]), 1)))))
        ids = joined(np.insert(ids, cut + 1, 0))
        lone = (ids[:-2] == 0) & (ids[2:] == 0)
        ids = joined(np.where(np.concatenate(([False], lone, [False])), 0, ids))
    if not ids.any():
        return
    fm = FMIndex(ids, deepest)
    found, side = fm.words(), 0
    for size in range(2, deepest + 1):
        found, side = fm.extended(found, side), 1 - side
        keep = np.ones(len(found.size), bool)
        if 2 < size - 1 < len(known) + 1:
            for inner in (found.ids[:, 1:], found.ids[:, :-1]):
                keep &= known[size - 2].holds(f.cell(gram_hashes(h, inner)))
        key = gram_hashes(h, found.ids)
        if 2 < size < len(known) + 1:
            keep &= known[size - 1].holds(f.cell(key))
        found, key = found.taken(keep), key[keep]
        yield size, found, key


def filter_of_phrases(index: DataFrame, size: int, f: Filters, p: PhraseParams) -> np.ndarray:
    """The filter of phrases of ``size`` words that are frequent, or share their 32 bits and part with such.

    A shard sends each part the bits of its phrases, packed: without counts those that it has once.
    """
    spark = index.sparkSession
    shared, parts = spark.sparkContext.broadcast(f), f.parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        known = f.ready()
        for batch in batches:
            for r in range(batch.num_rows):
                for s, found, key in phrases_of(batch.column("lang")[r].as_py(), batch.column("words")[r].values, ids_of(batch.column("ids")[r]), size, f, known):
                    if s < size:
                        continue
                    cell = f.cell(key)
                    order = np.argsort(cell)
                    cell, n = cell[order], found.size[order]
                    ends = np.searchsorted(cell, np.arange(1, parts + 1, dtype=np.uint64) << U(32))
                    rows, a = [], 0
                    for part, z in enumerate(ends.tolist()):
                        if z > a:
                            bits, many = cell[a:z].astype(np.uint32), n[a:z] > 1
                            rows.append((part, bits[~many].tobytes(), bits[many].tobytes(), n[a:z][many].astype(np.int64).tobytes()))
                        a = z
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "once", "bits", "n"])
                pa.default_memory_pool().release_unused()

    least, hold = p.min_count, 1 << 22

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bits, n, held = None, [], [], 0

        def thinned() -> tuple[np.ndarray, np.ndarray]:
            all_, count = np.concatenate(bits), np.concatenate(n)
            order = np.argsort(all_, kind="stable")
            all_, count = all_[order], count[order]
            head = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1])))
            return all_[head], np.add.reduceat(count, head)

        def frequent() -> pa.RecordBatch:
            all_, count = thinned()
            return pa.RecordBatch.from_arrays([pa.array((U(part) << U(32) | all_[count >= least].astype(np.uint64)).view(np.int64))], names=["h"])

        for batch in batches:
            for k, once, many, count in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "bits", "n")), strict=True):
                if k != part:
                    if bits:
                        yield frequent()
                    part, bits, n, held = k, [], [], 0
                one = np.frombuffer(once, np.uint32)
                bits += [one, np.frombuffer(many, np.uint32)]
                n += [np.ones(len(one), np.int64), np.frombuffer(count, np.int64)]
                held += len(one) + len(n[-1])
                if held > 2 * hold:
                    x, c = thinned()
                    bits, n, held = [x], [c], len(x)
        if bits:
            yield frequent()

    sent = index.select("lang", "words", "ids").mapInArrow(send, "part int, once binary, bits binary, n binary")
    cells = stored(sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "h bigint"), "cells")
    return bloom(cells, cells.count(), p.max_bits)


PACKED = "lang string, part int, size int, phrases string, n binary"


def sent_phrases(index: DataFrame, f: Filters, p: PhraseParams) -> DataFrame:
    """The phrases of two words and more that the filters let pass: of each shard and size a row for each part, with their texts, by lines, and their counts."""
    shared, parts = index.sparkSession.sparkContext.broadcast(f), f.parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        known = f.ready()
        for batch in batches:
            for r in range(batch.num_rows):
                lang, own = batch.column("lang")[r].as_py(), batch.column("words")[r].values
                for size, found, key in phrases_of(lang, own, ids_of(batch.column("ids")[r]), p.most_words, f, known):
                    if not len(key):
                        continue
                    part = (key % U(parts)).astype(np.int32)
                    order = np.argsort(part, kind="stable")
                    part = part[order]
                    head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    ends = np.concatenate((head, [len(part)])).astype(np.int32)
                    phrases = pc.binary_join_element_wise(*(own.take(pa.array(c - 1)) for c in found.ids[order].T), " ")
                    n = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends * 8), pa.py_buffer(found.size[order].astype("<i8"))])
                    columns = [pa.repeat(lang, len(head)), pa.array(part[head]), pa.repeat(pa.scalar(size, pa.int32()), len(head)), pc.binary_join(pa.ListArray.from_arrays(ends, phrases), "\n"), n]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "part", "size", "phrases", "n"])
                pa.default_memory_pool().release_unused()

    return index.select("lang", "words", "ids").mapInArrow(send, PACKED)


def unpacked(rows: pa.RecordBatch) -> pa.Table:
    phrases = pc.split_pattern(rows.column("phrases"), "\n")
    at = pa.array(np.repeat(np.arange(rows.num_rows), pc.list_value_length(phrases).to_numpy()))
    n = np.frombuffer(b"".join(rows.column("n").to_pylist()), "<i8")
    return pa.table({"lang": rows.column("lang").take(at), "phrase": phrases.flatten(), "size": rows.column("size").take(at), "n": n})


def phrase_counts(index: DataFrame, f: Filters, p: PhraseParams) -> DataFrame:
    """Counts of the frequent phrases of two words and more, summed within parts."""
    least = p.min_count

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows, most = None, [], 0, HELD

        def once() -> pa.Table:
            sums = pa.concat_tables(held).group_by(["lang", "phrase", "size"], use_threads=False).aggregate([("n", "sum")])
            return sums.rename_columns(["lang", "phrase", "size", "n"])

        def frequent() -> list[pa.RecordBatch]:
            sums = once()
            return sums.filter(pc.greater_equal(sums.column("n"), least)).to_batches(max_chunksize=ROWS)

        for batch in batches:
            of = batch.column("part").to_numpy()
            head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
            for a, z in zip(head, [*head[1:], len(of)], strict=True):
                if of[a] != part:
                    if held:
                        yield from frequent()
                    part, held, rows, most = of[a], [], 0, HELD
                held.append(unpacked(batch.slice(a, z - a)))
                rows += held[-1].num_rows
                if rows > most:
                    held = [once()]
                    rows = held[0].num_rows
                    most = max(HELD, 2 * rows)
        if held:
            yield from frequent()

    sent = sent_phrases(index, f, p).repartition("part").sortWithinPartitions("part")
    return stored(sent.mapInArrow(add, COUNTED), "phrases")


def frequent_phrases(docs: DataFrame, params: PhraseParams | None = None) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size, n of all frequent words and phrases; and lang, n: the word occurrences of each language."""
    p = params or PhraseParams()
    index = stored(shards(docs, p), "shards")
    totals = index.groupBy("lang").agg(F.sum("n").alias("n"))
    words = word_counts(index, p)
    total = index.agg(F.sum("n")).first()[0] or 0
    f = Filters([filter_of_words(words, p)], max(partitions(docs.sparkSession), -(-total // p.part_words)))
    for size in range(2, p.most_words):
        f = Filters([*f.words, filter_of_phrases(index, size, f, p)], f.parts)
    return words.unionByName(phrase_counts(index, f, p)), totals


def collocations(docs: DataFrame, params: PhraseParams | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language of ``docs`` (text, lang)."""
    p = params or PhraseParams()
    known, totals = frequent_phrases(docs, p)
    phrases = known.filter(F.col("size") > 1).select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    around = phrases.filter(F.col("size") > 2).select("lang", "a", F.explode(F.array(F.slice("w", F.lit(1), F.col("size") - 1), F.slice("w", F.lit(2), F.col("size") - 1))).alias("w"))
    around = around.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    # a phrase two words longer has no more occurrences than the one between
    left = phrases.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < p.covered_percent * F.col("a")))
    cut = left.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    of = lambda part, n: known.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cut = cut.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr(f"cast(a as decimal(20, 0)) * {p.scale} div (cast(l as decimal(20, 0)) + r)")
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= p.top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
