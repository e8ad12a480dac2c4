"""Bloom filters of bounded size, built by Spark jobs and shared with all tasks.

A filter may let strangers pass, more of them the fuller it is, and never loses a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring import mixed, odd_numbers

U = np.uint64
PROBES = 4


class Bloom:
    """A filter of 64-bit hashes; ``words`` has a power of two of 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def places(h: np.ndarray, bits: int) -> np.ndarray:
        return np.concatenate([mixed(h + m) & U(bits - 1) for m in odd_numbers(PROBES, 5)])

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h, 64 * len(self.words))
        return (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool).reshape(PROBES, -1).all(0)


def bloom(hashes: DataFrame, members: int, max_bits: int) -> np.ndarray:
    """The words of a filter for the one long column of ``hashes``, of about ``members`` rows: at most ``max_bits`` bits, the bound of what reaches the driver."""
    bits = min(max_bits, max(1 << 16, 1 << (16 * members).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = Bloom.places(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int64)), pa.array((at & U(63)).astype(np.int32))], names=["slot", "bit"])

    got = hashes.mapInArrow(places, "slot bigint, bit int").groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("w")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("slot").to_numpy()] = got.column("w").to_numpy().view(np.uint64)
    return out
