"""Mixing sources to target weights by Poisson replication.

Each source gets the mean repetition rate ``total * weight / (sum of weights *
documents of the source)``.  A document's copies are Poisson distributed with
that mean: uniform numbers hashed from the seed and the doc_id are inverted
through the distribution function, so a rerun, a retry or another cluster size
gives the same mix.  The copies are exploded and dealt out by a hashed key, a
global shuffle that no source or document can skew.

Source sizes are pre-aggregated; the rates are broadcast while there are at most
``max_broadcast_sources`` of them, and joined on (source, salt) beyond that, so
that a hot source is split.

Edge cases: a null source is a source of its own; a null doc_id hashes as the
word null; repeated rows draw the same count; a source without a weight, or with
weight 0, has rate 0 and leaves; an empty table gives no rows; text is carried
unchanged, null included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, stored, wrapped

#: Largest mean that is inverted at once; larger ones are sums of equal parts.
PART = 16
#: Terms of the distribution function: at a mean of 16 the rest is below 2**-53.
TERMS = 72
HEX = 13


@dataclass(frozen=True)
class MixParams:
    #: weight of each source; None gives all sources the same weight
    weights: dict[str, float] | None = None
    #: documents after mixing; None keeps the input's number
    total: int | None = None
    seed: int = 17
    max_broadcast_sources: int = 10_000
    salts: int = 32


def hashed(seed: int, tag: str, *parts: Column) -> Column:
    """An integer below 16**13 from the seed and the parts."""
    key = F.concat_ws(":", F.lit(f"{seed}{tag}"), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HEX), 16, 10).cast("long")


def cdf(mean: Column) -> Column:
    """Distribution function of Poisson(mean) at 0, 1, ... TERMS - 1."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda a, k: bind(
            a["p"] * mean / k,
            lambda p: F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c")),
        ),
        lambda a: a["c"],
    )


def rates(docs: DataFrame, p: MixParams) -> DataFrame:
    """One row per source: _source, _rate, the number of equal parts and a part's distribution function."""
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_n"))
    if p.weights is None:
        sizes = sizes.withColumn("_weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in p.weights.items()], "_named string, _weight double")
        sizes = sizes.join(given, F.col("_source") == F.col("_named"), "left").drop("_named").withColumn("_weight", F.coalesce("_weight", F.lit(0.0)))
    sums = sizes.agg(F.sum("_weight").alias("_all"), (F.lit(p.total) if p.total is not None else F.sum("_n")).cast("double").alias("_total"))
    rate = F.when(F.col("_all") > 0, F.col("_total") * F.col("_weight") / (F.col("_all") * F.col("_n"))).otherwise(F.lit(0.0))
    df = sizes.crossJoin(F.broadcast(sums)).withColumn("_rate", rate)  # sums: one row
    df = df.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART).cast("int")))
    return df.select("_source", "_rate", "_parts", cdf(F.col("_rate") / F.col("_parts")).alias("_cdf"))


def mix(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """The mixed corpus in shuffled order: all columns of ``docs`` and copy, shuffle_key.

    Rows of a partition are in the order of shuffle_key; partitions are dealt by it.
    """
    p = params or MixParams()
    taken = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    table = stored(rates(docs, p), "rates")
    rows = wrapped(docs.select(taken), _id=F.col("doc_id"), _from=F.col("source"))
    if table.count() <= p.max_broadcast_sources:
        joined = rows.join(F.broadcast(table), F.col("_from").eqNullSafe(F.col("_source")))
    else:
        spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
        salted = rows.withColumn("_own", F.pmod(F.xxhash64("_id"), F.lit(p.salts)).cast("int"))
        joined = salted.join(spread, F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt")))
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        F.lit(0),
        lambda a, j: a + bind(hashed(p.seed, "u", F.col("_id"), j) / float(16**HEX), lambda u: F.size(F.filter("_cdf", lambda c: c <= u))),
    )
    copies = joined.withColumn("_count", drawn).filter(F.col("_count") > 0)
    copies = copies.select("_row", "_id", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("_copy"))
    keyed = copies.select("_row", "_id", "_copy", hashed(p.seed, "s", F.col("_id"), F.col("_copy")).alias("_key"))
    dealt = keyed.repartition("_key").sortWithinPartitions("_key", "_id", "_copy")
    return dealt.select("_row.*", F.col("_copy").alias("copy"), F.col("_key").alias("shuffle_key"))
