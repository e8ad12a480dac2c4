"""Substring dedup by relative Lempel-Ziv parsing.

Each document is parsed greedily, left to right, into factors copied from
earlier text.  At a word whose window of ``window`` words stands earlier in a
reference block the parser takes the longest match there: it follows the source
as long as the text agrees, and emits one factor.  The windows that straddle the
factor's end are looked up next, so a repeat that begins inside a factor and
outlasts it starts the following factor.  Words covered by factors are removed.

The reference blocks cover the whole corpus.  A block's index maps window hashes
to their first place, and is dealt out by anchors: windows with the same words
have the same minimum among the hashes of their 5-word grams, about one anchor
for every eight words.  There are two kinds of blocks.  Each task first parses
its own texts, chunk by chunk, against the chunk, so that a passage which many
documents share leaves a task once.  What is left is shuffled to index parts,
whose number follows the bytes of the input; a part that a passage of very many
chunks makes large is parsed and thinned out to first places whenever it has
doubled.  The last step puts the matches of each document together: matches that
go on along the same source are one, and the greedy parse runs over them, so the
longest match at a word may reach over anchors, chunks and parts.

Windows are compared by their hashes, never by words: 48 bits of the window and
64 of its anchor (128 bits within a chunk).  At 10^13 windows fewer than 10^-7
pairs of different windows are expected to agree.  Documents are told apart by
doc_id and 64 bits of a text hash.

Edge cases: null text has no words; texts shorter than a window keep all words;
repeated rows are one document, neither is earlier than the other; rows of one
doc_id with different texts are different documents, in the order of their text
hashes; a null doc_id is the smallest; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, partitions

GRAM = 5
#: Bytes of text that are hashed at once, and that a task gathers before it sends entries.
BLOCK, CHUNK = 1 << 20, 3 << 20
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
U = np.uint64


@dataclass(frozen=True)
class SubstringParams:
    window: int = 20
    seed: int = 11
    #: bytes of text for each index part; a task works on one part at a time
    part_bytes: int = 16 << 20
    #: parts for each task, and the least number of parts for each shuffle partition
    parts: int = 4
    #: bytes of entries of one part that are held before they are thinned out
    hold: int = 64 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def hash_words(texts: list[bytes], seed: int, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash per word of all texts, block by block, and the number of words of each text.

    ``blank`` marks the bytes between words; a line feed must be one of them.
    """
    data = b"\n".join(texts)
    out, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    letters = odd_numbers(256, seed)
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not blank[data[end]]:
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        full = ~blank[b]
        edge = np.diff(np.concatenate(([0], full.view(np.int8), [0])))
        begin = np.flatnonzero(edge == 1)
        sizes = np.flatnonzero(edge == -1) - begin
        if sizes.size:
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
            value = letters[b[full]] * odd_numbers(int(sizes.max()), seed + 1)[place]
            out.append(mixed(np.add.reduceat(value, first) + sizes.astype(np.uint64)))
            starts.append(begin + at)
        at = end
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(out), np.diff(np.searchsorted(np.concatenate(starts), offset))


def rolled(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``k`` values."""
    n = max(0, len(h) - k + 1)
    total = np.zeros(n, np.uint64)
    for j, m in enumerate(odd_numbers(k, seed)):
        total += h[j : j + n] * m
    return mixed(total)


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each run of ``k`` values, by doubling."""
    size = 1
    while size < k:
        step = min(size, k - size)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        size += step
    return x


def first_places(key: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """For each window the number of the first one with its key (and group)."""
    order = np.argsort(key, kind="stable") if group is None else np.lexsort((key, group))
    k = key[order]
    new = k[1:] != k[:-1]
    if group is not None:
        new |= group[order][1:] != group[order][:-1]
    head = np.flatnonzero(np.concatenate(([True], new)))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(order[head], np.diff(np.append(head, len(k))))
    return out


def match_length(key: np.ndarray, i: int, j: int, most: int) -> int:
    """How many windows from ``i`` agree with those from ``j``; the first one does."""
    n, step = 1, 16
    while n < most:
        m = min(step, most - n)
        same = key[i + n : i + n + m] == key[j + n : j + n + m]
        if not same.all():
            return n + int(same.argmin())
        n, step = n + m, 4 * step
    return n


def parse(key: np.ndarray, known: np.ndarray, src: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parse of windows in order: the first window of each factor and its number of windows.

    ``known`` lists the windows that stand earlier, ``src`` has that place, ``end``
    the end of each window's stretch of neighbours.  A factor follows its source as
    far as both stretches agree; the next one starts at the next known window.
    """
    first, size, at, total = [], [], 0, len(known)
    while at < total:
        i = int(known[at])
        j = int(src[i])
        n = match_length(key, i, j, min(int(end[i]) - i, int(end[j]) - j))
        first.append(i)
        size.append(n)
        at += n  # all windows of the match are known
    return np.array(first, np.int64), np.array(size, np.int64)


class Runs:
    """Stretches of neighbouring windows with one anchor: doc, sig, pos, count, anchor of each, and all keys."""

    FIELDS = (("doc", np.int64), ("anchor", np.uint64), ("sig", np.int64), ("pos", np.int32), ("count", np.uint16))

    def __init__(self, doc: np.ndarray, anchor: np.ndarray, sig: np.ndarray, pos: np.ndarray, count: np.ndarray, key: np.ndarray):
        self.doc, self.anchor, self.sig, self.pos, self.count, self.key = doc, anchor, sig, pos, count, key

    @classmethod
    def of_windows(cls, doc: np.ndarray, sig: np.ndarray, pos: np.ndarray, anchor: np.ndarray, key: np.ndarray) -> Runs:
        new = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1]) | (pos[1:] != pos[:-1] + 1)
        start = np.flatnonzero(np.concatenate(([True], new | (np.arange(1, len(pos)) % 32768 == 0)))) if len(pos) else np.zeros(0, np.int64)
        return cls(doc[start], anchor[start], sig[start], pos[start], np.diff(np.append(start, len(pos))), key)

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Runs:
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        for blob in blobs:
            runs, n = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
            at = 16
            for out, (kind, size) in zip(parts, (*((k, runs) for _, k in cls.FIELDS), (np.uint32, n), (np.uint16, n)), strict=True):
                out.append(np.frombuffer(blob, kind, size, at))
                at += size * np.dtype(kind).itemsize
        doc, anchor, sig, pos, count, high, low = (np.concatenate(x) for x in parts)
        return cls(doc, anchor, sig, pos.astype(np.int64), count.astype(np.int64), (high.astype(np.uint64) << U(16)) | low)

    def take(self, own: np.ndarray) -> Runs:
        """The runs of these numbers, with their keys."""
        begin = np.cumsum(self.count) - self.count
        count = self.count[own]
        at = np.repeat(begin[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return Runs(self.doc[own], self.anchor[own], self.sig[own], self.pos[own], count, self.key[at])

    def packed(self) -> bytes:
        fields = [getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS]
        keys = [(self.key >> U(16)).astype(np.uint32).tobytes(), self.key.astype(np.uint16).tobytes()]
        return b"".join((len(self.doc).to_bytes(8, "little"), len(self.key).to_bytes(8, "little"), *fields, *keys))

    def spread(self) -> tuple[np.ndarray, ...]:
        """doc, sig, pos and end of each window."""
        last = np.cumsum(self.count)
        step = np.arange(int(self.count.sum())) - np.repeat(last - self.count, self.count)
        return np.repeat(self.doc, self.count), np.repeat(self.sig, self.count), np.repeat(self.pos, self.count) + step, np.repeat(last, self.count)


PIECE = pa.schema([("doc", pa.int64()), ("sig", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("src_doc", pa.int64()), ("src_sig", pa.int64()), ("src_start", pa.int64())])


def pieces(doc: np.ndarray, sig: np.ndarray, pos: np.ndarray, key: np.ndarray, src: np.ndarray, end: np.ndarray, window: int) -> pa.RecordBatch:
    """The factors among these windows, in words."""
    known = np.flatnonzero((src != np.arange(len(src))) & ((doc[src] != doc) | (sig[src] != sig) | (pos[src] != pos)))
    i, n = parse(key, known, src, end)
    j = src[i]
    columns = (doc[i], sig[i], pos[i], n + window - 1, doc[j], sig[j], pos[j])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)


def index_entries(docs: list[tuple[int, int, bytes]], p: SubstringParams, parts: int) -> tuple[list[tuple[int, bytes]], pa.RecordBatch]:
    """Entries of one chunk of documents by index part, and the factors found within the chunk."""
    docs.sort(key=lambda x: x[:2])
    h, size = hash_words([t for _, _, t in docs], p.seed)
    if len(h) < p.window:
        return [], pa.RecordBatch.from_pylist([], schema=PIECE)
    row = np.repeat(np.arange(len(size)), size)
    n = len(h) - p.window + 1
    valid = row[:n] == row[p.window - 1 :]
    pos = (np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size))[:n][valid]
    anchor = sliding_min(rolled(h, GRAM, p.seed + 2), p.window - GRAM + 1)[valid]
    key = rolled(h, p.window, p.seed + 3)[valid]
    row = row[:n][valid]
    if not len(row):
        return [], pa.RecordBatch.from_pylist([], schema=PIECE)
    doc, sig = np.array([d for d, _, _ in docs], np.int64)[row], np.array([x for _, x, _ in docs], np.int64)[row]
    src = first_places(key)
    src = np.where(anchor[src] == anchor, src, np.arange(len(src)))
    end = np.cumsum(np.bincount(row, minlength=len(size)))[row]
    found = pieces(doc, sig, pos, key, src, end, p.window)
    left = src == np.arange(len(src))
    runs = Runs.of_windows(doc[left], sig[left], pos[left], anchor[left], key[left] >> U(16))
    part = (mixed(runs.anchor) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0, [True])))
    return [(int(part[order[a]]), runs.take(order[a:b]).packed()) for a, b in zip(cut[:-1], cut[1:], strict=True)], found


def resolve(blobs: list[bytes], window: int) -> tuple[pa.RecordBatch, bytes]:
    """Factors among the entries of one index part, and the entries of first places."""
    runs = Runs.unpacked(blobs)
    order = np.argsort(runs.anchor, kind="stable")
    a = runs.anchor[order]
    again = np.concatenate(([False], a[1:] == a[:-1]))
    shared, group = np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    shared[order], group[order] = again | np.append(again[1:], False), np.cumsum(~again)
    own = np.flatnonzero(shared)
    own = own[np.lexsort((runs.pos[own], runs.sig[own], runs.doc[own]))]
    met = runs.take(own)
    doc, sig, pos, end = met.spread()
    src = first_places(met.key, np.repeat(group[own], met.count)) if len(doc) else np.zeros(0, np.int64)
    found = pieces(doc, sig, pos, met.key, src, end, window)
    left = src == np.arange(len(src))
    first = Runs.of_windows(doc[left], sig[left], pos[left], np.repeat(met.anchor, met.count)[left], met.key[left])
    alone = runs.take(np.flatnonzero(~shared))
    both = [np.concatenate((getattr(alone, c), getattr(first, c))) for c in ("doc", "anchor", "sig", "pos", "count", "key")]
    return found, Runs(*both).packed()


def compose(matches: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Greedy parse of one document over its matches (start, size, src_doc, src_sig, src_start).

    Matches that go on along the same source are joined first.  At each word the
    longest match is a factor; the windows that straddle its end are looked up next.
    """
    joined: list[list[int]] = []  # start, end, source and its offset
    for start, size, d, s, at in sorted(matches, key=lambda x: (x[2], x[3], x[4] - x[0], x[0])):
        source = [d, s, at - start]
        if joined and joined[-1][2:] == source and start <= joined[-1][1] - window + 1:
            joined[-1][1] = max(joined[-1][1], start + size)
        else:
            joined.append([start, start + size, *source])
    joined.sort()
    out, at, k, best = [], 0, 0, None  # at: the first window that is not parsed
    while True:
        while k < len(joined) and joined[k][0] <= at:
            if best is None or joined[k][1] > best[1]:
                best = joined[k]
            k += 1
        if best is not None and best[1] - window >= at:
            out.append((at, best[1] - at, best[2], best[3], at + best[4]))
            at = best[1] - window + 1
        elif k < len(joined):
            at = joined[k][0]
        else:
            return out


ENTRY = "part int, blob binary, doc bigint, sig bigint, start bigint, size bigint, src_doc bigint, src_sig bigint, src_start bigint"
FACTOR = "doc bigint, sig bigint, start bigint, size bigint, src_doc bigint, src_sig bigint, src_start bigint"


def find_matches(docs: DataFrame, params: SubstringParams | None = None) -> DataFrame:
    """All matches of the reference blocks: doc (NULL_ID for a null doc_id), sig, start, size, src_doc, src_sig, src_start, in words."""
    p = params or SubstringParams()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession) * p.parts, -(-total // p.part_bytes))
    width = -(-parts // p.parts)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            blobs, found = index_entries(held, p, parts)
            # factors of the chunk travel with the index parts, spread over them
            n, m = len(blobs), found.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary()), *[pa.nulls(n, f.type) for f in PIECE]], names=["part", "blob", *PIECE.names])
            if m:
                yield pa.RecordBatch.from_arrays([pa.array((mixed(found.column(0).to_numpy().astype(np.uint64)) % U(parts)).astype(np.int32)), pa.nulls(m, pa.binary()), *found.columns], names=["part", "blob", *PIECE.names])

        for batch in batches:
            for d, x, t in zip(batch.column("doc").to_pylist(), batch.column("sig").to_pylist(), batch.column("text"), strict=True):
                data = t.as_py() or b""
                held.append((d, x, data))
                size += len(data)
                if size >= CHUNK:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs, held, limit = None, [], 0, p.hold
        for batch in batches:
            blob = batch.column("blob")
            passing = batch.filter(blob.is_null())
            if passing.num_rows:
                yield passing.select(PIECE.names)
            own = batch.filter(blob.is_valid())
            for part, b in zip(own.column("part").to_pylist(), own.column("blob").to_pylist(), strict=True):
                if part != current and blobs:
                    yield resolve(blobs, p.window)[0]
                    blobs, held, limit = [], 0, p.hold
                current = part
                blobs.append(b)
                held += len(b)
                if held >= limit and len(blobs) > 1:
                    found, rest = resolve(blobs, p.window)
                    yield found
                    blobs, held, limit = [rest], len(rest), max(p.hold, 2 * len(rest))
        if blobs:
            yield resolve(blobs, p.window)[0]

    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("sig"), F.col("text").cast("binary").alias("text"))
    dealt = rows.mapInArrow(entries, ENTRY).repartition(width, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(look_up, FACTOR)


def substring_dedup(docs: DataFrame, params: SubstringParams | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one blank), factors.

    ``docs`` needs doc_id and text.  factors: array of struct start, size, src_doc,
    src_start in words, in order; a factor may begin inside the one before it.
    """
    p = params or SubstringParams()
    names = ("start", "size", "src_doc", "src_sig", "src_start")
    found = find_matches(docs, p).groupBy("doc", "sig").agg(F.collect_list(F.struct(*names)).alias("matches"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("sig"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(found, ["doc", "sig"], "left").select("doc_id", "text", "matches")
    item = pa.struct([(x, pa.int64()) for x in ("start", "size", "src_doc", "src_start")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, texts, lists = [], [], [], []
            column = batch.column("matches")
            offset, fields = column.offsets.to_pylist(), [column.values.field(x).to_pylist() for x in names]
            for t, a, z in zip(batch.column("text"), offset, offset[1:], strict=False):
                ws = (t.as_py() or b"").split()
                factors = compose(list(zip(*(f[a:z] for f in fields), strict=True)), p.window) if z > a else []
                gone, kept, at = 0, [], 0
                for start, size, *_ in factors:
                    b = start + size
                    if start > at:
                        kept += ws[at:start]
                    gone += b - max(at, start)
                    at = b
                kept = kept + ws[at:] if at else ws
                total.append(len(ws))
                removed.append(gone)
                texts.append(b" ".join(kept))
                lists.append([(a, n, None if d == NULL_ID else d, s) for a, n, d, _, s in factors])
            flat = [x for own in lists for x in own]
            values = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(4)], fields=list(item))
            ends = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(ends, values)],
                names=["doc_id", "n_words", "n_removed", "kept_text", "factors"],
            )

    return joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, factors array<struct<start:bigint,size:bigint,src_doc:bigint,src_start:bigint>>")
