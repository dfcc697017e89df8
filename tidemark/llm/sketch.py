"""Bloom filters of 64-bit keys with a fixed size, built by the executors.

A filter answers "maybe" or "certainly not"; it is used only to leave out work that cannot matter, and every
result is exact whatever its answers. ``fitting`` gives a size for a number of keys, within fixed limits: beyond the upper one
a fuller filter says "maybe" more often. What reaches the driver is at most ``bits`` bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U64, mix

BITS = 1 << 23
MOST_BITS = 1 << 27


def fitting(keys: int) -> int:
    """Bits of a filter that answers "maybe" to about one other key in seventy, 16 MB at most."""
    return min(MOST_BITS, max(BITS, 1 << (16 * max(1, keys) - 1).bit_length()))


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys.astype(U64) ^ U64(0x5851F42D4C957F2D))
    return np.concatenate([h & U64(bits - 1), (h >> U64(32)) & U64(bits - 1)])


class Bloom:
    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.words = np.zeros(bits // 64, U64)

    def add(self, keys: np.ndarray) -> Bloom:
        at = _places(keys, self.bits)
        np.bitwise_or.at(self.words, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        return self

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], U64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        at = _places(keys, self.bits)
        hit = (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)
        return (hit[: len(keys)] & hit[len(keys) :]).astype(bool)


def bloom(keys: DataFrame, bits: int = BITS) -> Bloom:
    """A filter of the first column of keys, a long."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bits)
        for batch in batches:
            own.add(np.asarray(batch.column(0)).astype(np.int64).view(U64))
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.words[at].view(np.int64))], ["at", "word"])

    out = Bloom(bits)
    parts = keys.select(F.col(keys.columns[0]).cast("long")).mapInArrow(partial, "at long, word long")
    found = parts.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out.words[np.asarray(found["at"])] = np.asarray(found["word"]).view(U64)
    return out
