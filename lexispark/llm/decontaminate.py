"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Symbols are words (letters and digits, lower case).  A benchmark item of m words
leaks into a document where a run of words is within ``floor((1 - similarity) * m)``
word edits of it.

Every position of every document starts a window of each item size class.  The
CGK random walk reads a sequence and, at step j, writes the current symbol and
moves on if a hashed coin for (j, symbol) says so; the edit distance of two
sequences thereby bounds the Hamming distance of what they write.  One hash
table samples a few steps of one walk; ``tables`` independent walks bring the
recall to the target (tests measure it against brute force).  Candidates
are verified by bit-parallel edit distance with a free end.

Before the walks, windows that cannot match are passed over without loss: with
at most k edits, ``SPARE`` of an item's k + SPARE rarest words (by the first texts
of a task; any choice is right) must stand in the window, each at most k places off.

Items below ``min_words`` words, where one edit is more than the similarity allows
or chance alone would find it, are looked up by their exact words.

The benchmark is a stated query set: it is read in blocks of at most
``block_words`` words; ``blocks_per_pass`` of them are broadcast and held against
all documents in one pass.

Edge cases: null and empty texts have no hits; items that are null or have no word
are no queries; repeated items are separate items; rows of one doc_id with
different texts are different documents; repeated rows give repeated hits; an empty table on either
side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, wrapped
from .substring import hash_words, mixed, odd_numbers, rolled

U = np.uint64
#: Words are runs of ASCII letters, digits and bytes of other characters.
BREAK = np.array([not (b >= 128 or 48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
CHUNK = 2 << 20
SPARE = 4
HIT = "doc_id bigint, sig bigint, item_id bigint, start_word bigint, n_words bigint, distance int, similarity double"


@dataclass(frozen=True)
class LeakParams:
    similarity: float = 0.8
    min_words: int = 8
    tables: int = 40
    #: steps of a walk that a table samples
    sampled: int = 2
    #: widths of the size classes, in words
    class_width: int = 8
    block_words: int = 1_000_000
    blocks_per_pass: int = 4
    #: items from this length on make a document leave (``drop_leaks``); a shorter run of words stands anywhere
    drop_words: int = 5
    seed: int = 7


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def edit_prefix(item: list[int], window: list[int], most: int) -> tuple[int, int]:
    """(distance, length) of the best prefix of ``window`` against the whole item; distance above ``most``: none.

    Myers' bit vectors, with the distance between the whole item and each prefix.
    """
    m = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(window, 1):
        eq = at.get(w, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | (full & ~(d0 | vp)), vp & d0
        if hp & top:
            score += 1
        if hn & top:
            score -= 1
        hp, hn = (hp << 1 | 1) & full, hn << 1 & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
        if score < best[0]:
            best = (score, j)
    return best if best[0] <= most else (most + 1, 0)


class Index:
    """The hash tables of one block of items."""

    def __init__(self, items: list[tuple[int, str]], p: LeakParams):
        self.p = p
        every = [(i, hash_words([plain(t)], p.seed, BREAK)[0]) for i, t in items]
        known = [(i, h) for i, h in every if len(h) >= p.min_words]
        #: short items by their number of words: sorted hashes of their words, and who they are
        self.short: list[tuple[int, np.ndarray, list[int]]] = []
        for n in range(1, p.min_words):
            own = sorted((int(rolled(h, n, p.seed + 5)[0]), i) for i, h in every if len(h) == n)
            if own:
                self.short.append((n, np.array([k for k, _ in own], np.uint64), [i for _, i in own]))
        self.ids = [i for i, _ in known]
        self.words = np.unique(np.concatenate([h for _, h in known])) if known else np.zeros(0, np.uint64)
        self.items = [np.searchsorted(self.words, h) for _, h in known]
        self.anchors: tuple[np.ndarray, ...] | None = None
        self.classes: list[tuple] = []
        self.kind = np.array([len(it) // p.class_width for it in self.items], np.int64)
        self.sizes = [len(it) for it in self.items]
        for c in np.unique(self.kind):
            own = np.flatnonzero(self.kind == c)
            shortest, longest = min(len(self.items[k]) for k in own), max(len(self.items[k]) for k in own)
            padded = np.full((len(own), longest), len(self.words), np.int64)
            for r, k in enumerate(own):
                padded[r, : len(self.items[k])] = self.items[k]
            # steps are sampled where even the shortest item's walk has not run out
            keys = self.keys(padded, 2 * shortest)
            order = np.argsort(keys, axis=1, kind="stable")
            self.classes.append((int(c), shortest, longest + max(self.edits(k) for k in own), np.take_along_axis(keys, order, 1), own[order]))

    def choose(self, code: np.ndarray) -> None:
        """The anchors of each item, its rarest words in the texts with these word codes, grouped by word."""
        seen = np.bincount(code, minlength=len(self.words) + 1)
        word, item, offset = [], [], []
        for k, it in enumerate(self.items):
            rarest = np.argsort(seen[it], kind="stable")[: self.edits(k) + SPARE]
            word += it[rarest].tolist()
            item += [k] * len(rarest)
            offset += rarest.tolist()
        word, item, offset = (np.array(x, np.int64) for x in (word, item, offset))
        order = np.argsort(word, kind="stable")
        number = np.bincount(word, minlength=len(self.words) + 1)
        self.anchors = number, np.cumsum(number) - number, item[order], offset[order]

    def windows(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item class, start) of the windows that the anchors leave, distinct."""
        if self.anchors is None:
            self.choose(code)
        number, begin, item, offset = self.anchors
        spot = np.flatnonzero(number[code])
        n = number[code[spot]]
        entry = np.repeat(begin[code[spot]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item, guess = item[entry], np.repeat(spot, n) - offset[entry]
        span = len(code) + 1_000_000
        key = np.sort(item * (3 * span) + guess + span)
        if len(key) < SPARE:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = key[: len(key) - SPARE + 1], key[SPARE - 1 :]
        item = low // (3 * span)
        edits = np.array([self.edits(k) for k in range(len(self.items))], np.int64)[item]
        ok = (high - low <= 2 * edits) & (high // (3 * span) == item)
        low, high, item, edits = low[ok], high[ok], item[ok], edits[ok]
        first, size = high - edits, low - high + 2 * edits + 1
        start = np.repeat(first - item * (3 * span) - span - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        kind = np.repeat(self.kind[item], size)
        inside = (start >= 0) & (start < len(code))
        both = np.unique(kind[inside] * len(code) + start[inside])
        return both // len(code), both % len(code)

    def edits(self, k: int) -> int:
        return int((1 - self.p.similarity) * len(self.items[k]) + 1e-9)

    def keys(self, rows: np.ndarray, steps: int) -> np.ndarray:
        """tables x rows: hash of the sampled steps of each table's walk over each row."""
        p = self.p
        rng = np.random.default_rng(p.seed)
        chosen = np.argsort(rng.random((p.tables, steps)), axis=1) < min(p.sampled, steps)
        coin = odd_numbers(2 * p.tables * steps, p.seed).reshape(2, p.tables, steps, 1)
        width = rows.shape[1]
        padded = np.concatenate([rows, np.full((len(rows), 1), len(self.words), np.int64)], axis=1).astype(np.uint64).ravel()
        base = np.arange(len(rows)) * (width + 1)
        at, key = np.zeros((p.tables, len(rows)), np.int64), np.zeros((p.tables, len(rows)), np.uint64)
        for j in range(int(np.flatnonzero(chosen.any(0)).max()) + 1):
            symbol = padded[base + at]
            own = chosen[:, j]
            key[own] = mixed(key[own] * U(3) + symbol[own] + U(1))
            at += ((symbol * coin[0, :, j] + coin[1, :, j]) >> U(63)).astype(np.int64)
            np.minimum(at, width, out=at)
        return key

    def hits(self, data: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (plain form) its hits (item number, start, words, distance)."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in data]
        h, size = hash_words(data, self.p.seed, BREAK)
        if not self.items or not len(h):
            return out
        none = len(self.words)
        code = np.minimum(np.searchsorted(self.words, h), none - 1)
        code = np.where(self.words[code] == h, code, none)
        row = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        last = (first + size)[row]  # end of the text of each position
        pairs: set[tuple[int, int]] = set()
        kinds, starts = self.windows(code)
        for c, shortest, reach, sorted_keys, who in self.classes:
            start = starts[kinds == c]
            for a in range(0, len(start), 4_000):
                s = start[a : a + 4_000]
                spot = s[:, None] + np.arange(reach)
                rows = np.where(spot < last[s][:, None], code[np.minimum(spot, len(code) - 1)], none)
                for mine, own, key in zip(sorted_keys, who, self.keys(rows, 2 * shortest), strict=True):
                    lo, hi = np.searchsorted(mine, key, "left"), np.searchsorted(mine, key, "right")
                    for r in np.flatnonzero(hi > lo):
                        pairs.update((int(s[r]), int(k)) for k in own[lo[r] : hi[r]])
        for s, k in sorted(pairs):
            most = self.edits(k)
            window = code[s : min(s + len(self.items[k]) + most, last[s])].tolist()
            d, n = edit_prefix(self.items[k].tolist(), window, most)
            if d <= most:
                r = int(row[s])
                out[r].append((k, int(s - first[r]), n, d))
        return [best(x) for x in out]


    def exact(self, data: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text (plain form) the places of short items: (item id, start, words), the first of overlapping ones."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in data]
        if not self.short:
            return out
        h, size = hash_words(data, self.p.seed, BREAK)
        row, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        for n, keys, ids in self.short:
            window = rolled(h, n, self.p.seed + 5)
            lo, hi = np.searchsorted(keys, window, "left"), np.searchsorted(keys, window, "right")
            last: dict[tuple[int, int], int] = {}
            for s in np.flatnonzero(hi > lo).tolist():
                r = int(row[s])
                if row[s + n - 1] != r:
                    continue
                for k in range(int(lo[s]), int(hi[s])):
                    if last.get((r, k), -n) + n <= s:
                        last[r, k] = s
                        out[r].append((ids[k], int(s - first[r]), n))
        return out


def best(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping hits of one item the nearest, then the first."""
    out: list[tuple[int, int, int, int]] = []
    for k, s, n, d in sorted(hits, key=lambda x: (x[0], x[3], x[1])):
        if not any(o[0] == k and s < o[1] + o[2] and o[1] < s + n for o in out):
            out.append((k, s, n, d))
    return sorted(out)


def item_blocks(benchmark: DataFrame, p: LeakParams) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, in the order of their ids."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    block, size = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        n = len(r["text"]) // 4 + 1
        if block and size + n > p.block_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def hit_rows(docs: DataFrame, benchmark: DataFrame, p: LeakParams) -> DataFrame:
    """Columns of HIT: every hit, and of which text of a doc_id (sig)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("sig"), "text")
    blocks, found = item_blocks(benchmark, p), None
    names = [x.split()[0] for x in HIT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
    while group := list(islice(blocks, p.blocks_per_pass)):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = [Index(block, p) for block in shared.value]

            def search(ids: list[tuple], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
                for index in indexes:
                    hits = [(*d, index.ids[k], s, n, e, round(1 - e / index.sizes[k], 6)) for d, own in zip(ids, index.hits(texts), strict=True) for k, s, n, e in own]
                    hits += [(*d, i, s, n, 0, 1.0) for d, own in zip(ids, index.exact(texts), strict=True) for i, s, n in own]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in hits], t) for c, t in enumerate(kinds)], names=names)

            ids, texts, size = [], [], 0
            for batch in batches:
                for d, x, t in zip(batch.column("doc_id").to_pylist(), batch.column("sig").to_pylist(), batch.column("text"), strict=True):
                    ids.append((d, x))
                    texts.append(plain(t.as_py()))
                    size += len(texts[-1])
                    if size >= CHUNK:
                        yield from search(ids, texts)
                        ids, texts, size = [], [], 0
            if ids:
                yield from search(ids, texts)

        part = rows.mapInArrow(run, HIT)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], HIT) if found is None else found


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams | None = None) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity of every hit.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text.
    """
    return hit_rows(docs, benchmark, params or LeakParams()).drop("sig")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams | None = None) -> DataFrame:
    """The documents without a hit of ``drop_words`` words or more, all columns unchanged."""
    p = params or LeakParams()
    hits = hit_rows(docs, benchmark, p).filter(F.col("n_words") + F.col("distance") >= p.drop_words)
    leaked = stored(hits.select(F.col("doc_id").alias("_leaked"), F.col("sig").alias("_leaked_sig")).distinct(), "leaks")
    rows = wrapped(docs, _id=F.col("doc_id"), _sig=F.xxhash64("text"))
    return rows.join(leaked, F.col("_id").eqNullSafe(F.col("_leaked")) & (F.col("_sig") == F.col("_leaked_sig")), "left_anti").select("_row.*")
