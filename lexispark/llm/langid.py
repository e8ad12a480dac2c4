"""Language identification by error-correcting output codes.

Every language has a codeword; one binary linear classifier over hashed byte
n-grams predicts each bit.  Decoding adds up the logistic loss of each bit
against each codeword, weighted by how reliable the bit's classifier was in
training, and takes the codeword with the least loss; a small margin to the
next one flags the document as ambiguous.

The classifiers are fitted on a bounded sample: about ``per_lang`` labelled
training documents of each language (twice as many at most), drawn by a hash of
doc_id and text; with very many languages fewer of each, so that the sample stays
near ``max_sample``, but never below ``least_per_lang``.  A language of which the draw
takes nothing (few different rows) gives its first ``least_per_lang`` rows, so every
labelled language is learned.  N-grams are counted on the executors before the sample
is cut; the driver holds only these sparse counts and makes them dense block by block.  The fitted
matrix has ``dims`` rows and a column for each bit, and is broadcast.

Edge cases: null text and texts without a letter (Unicode category L) give ``und``
with score 0; any number of languages can be learned;
null languages and held-out documents are never learned from; without any
labelled document everything is ``und``; with one language it is the answer
for every text with a letter; ties go to the language that sorts first; a null
doc_id is not held out; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: ASCII other than a-z becomes a blank before n-grams are taken.
PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class LangParams:
    per_lang: int = 500
    max_sample: int = 20_000
    least_per_lang: int = 20
    #: documents whose counts are dense at once
    block: int = 4096
    #: buckets of the hashed n-grams
    dims: int = 8192
    steps: int = 120
    #: lengths of random codewords per log2 of the number of languages
    bits_per_log: int = 10
    min_margin: float = 0.1
    seed: int = 3


@dataclass
class LangModel:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    reliability: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngram_buckets(text: str, dims: int) -> np.ndarray:
    """Bucket numbers of all byte 1-, 2- and 3-grams of the whole text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(PLAIN) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    spread = [(x * np.uint32(2654435761)) >> np.uint32(19) for x in (b + np.uint32(1 << 24), two + np.uint32(1 << 25), three)]
    return np.concatenate(spread).astype(np.int64) % dims


def codewords(n: int, p: LangParams) -> np.ndarray:
    """All column splits for up to five languages, else the best of many random codes."""
    if n <= 5:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.float32).T.reshape(n, -1)
    rng = np.random.default_rng(p.seed)
    if n > 1000:  # distances of so many random codewords hardly differ
        return rng.choice(np.array([-1, 1], np.float32), (n, int(np.ceil(p.bits_per_log * np.log2(n)))))
    best, gap = None, -1.0
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.float32), (n, int(np.ceil(p.bits_per_log * np.log2(n)))))
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if apart.min() > gap:
            best, gap = code, apart.min()
    return best


def fit(docs: DataFrame, p: LangParams) -> LangModel | None:
    """Fit the bit classifiers on the bounded sample of labelled training documents."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # written, so that Spark knows how small it is and joins without shuffling texts
    sizes = stored(labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n")), "lang-sizes")
    n_langs = sizes.count()
    if not n_langs:
        return None
    per_lang = min(p.per_lang, max(p.least_per_lang, p.max_sample // n_langs))
    labelled = labelled.withColumn("draw", F.xxhash64("doc_id", "text", F.lit(p.seed)))
    chance = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.join(sizes, F.col("lang") == F.col("_lang")).filter(chance * F.col("_n") < per_lang).select("lang", "draw", "text")
    dims = p.dims

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(ngram_buckets(t, dims), return_counts=True) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("draw"), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))],
                names=["lang", "draw", "bucket", "n"],
            )

    def taken(rows: DataFrame, most: int) -> DataFrame:
        first = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
        return rows.withColumn("_r", first).filter(F.col("_r") <= most).drop("_r")

    def counts(rows: DataFrame) -> DataFrame:
        return rows.select("lang", "draw", "text").mapInArrow(count, "lang string, draw bigint, bucket array<int>, n array<int>")

    got = taken(counts(drawn), 2 * per_lang).toArrow()
    if pc.count_distinct(got.column("lang")).as_py() < n_langs:
        missed = labelled.join(drawn.select("lang").distinct(), "lang", "left_anti")
        got = pa.concat_tables([got, counts(taken(missed, p.least_per_lang)).toArrow()])
    got = got.sort_by([("draw", "ascending"), ("lang", "ascending")])
    langs = sorted(set(got.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    y = np.array([at[x] for x in got.column("lang").to_pylist()])
    columns = [got.column(c).combine_chunks() for c in ("bucket", "n")]
    ends = columns[0].offsets.to_numpy()
    bucket, n = (c.values.to_numpy() for c in columns)

    def dense(a: int, z: int) -> np.ndarray:
        """Shares of the n-grams of the documents from a to z, in hundredths."""
        x, own = np.zeros((z - a, dims), np.float32), slice(ends[a], ends[z])
        rows = np.repeat(np.arange(z - a), np.diff(ends[a : z + 1]))
        total = np.bincount(rows, n[own], z - a)
        x[rows, bucket[own]] = n[own] / total[rows] * 100
        return x

    blocks = [(a, min(a + p.block, len(y))) for a in range(0, len(y), p.block)]
    held = dense(*blocks[0]) if len(blocks) == 1 else None
    code = codewords(len(langs), p)
    bits = code.shape[1]
    weights, bias = np.zeros((dims, bits), np.float32), np.zeros(bits, np.float32)
    balance = (1.0 / np.bincount(y, minlength=len(langs)).clip(1))[y].astype(np.float32)[:, None]
    balance /= balance.sum()
    seen_w, seen_b = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    for _ in range(p.steps if bits else 0):
        gw, gb = 1e-5 * weights, np.zeros_like(bias)
        for a, z in blocks:
            x, target = dense(a, z) if held is None else held, code[y[a:z]]
            slope = -target * balance[a:z] / (1 + np.exp(np.clip(target * (x @ weights + bias), -30, 30)))
            gw += x.T @ slope
            gb += slope.sum(0)
        seen_w += gw**2
        seen_b += gb**2
        weights -= 0.3 * gw / np.sqrt(seen_w)
        bias -= 0.3 * gb / np.sqrt(seen_b)
    right = np.zeros(bits, np.float32)
    for a, z in blocks if bits else ():
        right += ((code[y[a:z]] * ((dense(a, z) if held is None else held) @ weights + bias) > 0) * balance[a:z]).sum(0)
    return LangModel(langs, code, weights, bias, np.maximum(2 * right - 1, 0.01).astype(np.float32))


def decode(model: LangModel, f: np.ndarray) -> tuple[str, float, float]:
    """The language with the least weighted loss, its share of the softmax, the margin to the next."""
    if not f.size:
        return model.langs[0], 1.0, 1.0
    loss = (np.logaddexp(0, -model.code * f) * model.reliability).sum(1)
    p = np.exp(loss.min() - loss)
    p /= p.sum()
    first = int(p.argmax())
    rest = np.delete(p, first)
    return model.langs[first], float(min(1.0, p[first])), float(p[first] - rest.max())


def identify(docs: DataFrame, params: LangParams | None = None, model: LangModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row of ``docs`` (doc_id, text, lang)."""
    p = params or LangParams()
    model = model or fit(docs, p)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dims, least = p.dims, p.min_margin

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for value in batch.column("text"):
                text = value.as_py()
                if m is None or text is None or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, True))
                    continue
                at = ngram_buckets(text, dims)
                counts = np.bincount(at, minlength=dims).astype(np.float32)
                lang, score, margin = decode(m, counts @ m.weights * np.float32(100 / len(at)) + m.bias)
                out.append((lang, score, margin < least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")
