"""Parity sketches of feature sets: an exact lower bound on the number of features in which two sets differ.

A sketch has two to four bits a feature. A feature flips one bit, so two sketches differ in no more bits than their sets
differ in features; a longer one is folded to the other's length first. A pair that differs in more bits than its
threshold allows is ruled out without its features, which are some twenty times larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS = 64
SETS_AT_ONCE = 1_024
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of each size: a power of two of at least twice as many."""
    return np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(np.maximum(sizes, 1) * 2)).astype(np.int64))


def sketches(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Sketches of sets whose features follow each other."""
    bits = sketch_bits(sizes)
    start = np.cumsum(bits) - bits
    mixed = flat.view(np.uint64) * _FACTOR
    mixed ^= mixed >> np.uint64(32)
    at = np.repeat(start, sizes) + (mixed & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
    return [packed[a // 8:(a + b) // 8].tobytes() for a, b in zip(start.tolist(), bits.tolist(), strict=True)]


def least_differences(a: bytes, b: bytes) -> int:
    """No two sets with these sketches differ in fewer features."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def sketched(sets: DataFrame) -> DataFrame:
    """``(set_id, n, sketch)`` of ``sets(set_id, n, features)``."""
    kind = sets.schema["set_id"].dataType.simpleString()

    def make(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, frame.num_rows, SETS_AT_ONCE):
                part = frame.slice(start, SETS_AT_ONCE)
                lists = part.column(0)
                sizes = np.diff(lists.offsets.to_numpy())
                found = sketches(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(sizes.astype(np.int32)), pa.array(found, pa.binary())], names=["set_id", "n", "sketch"])

    rows = sets.select(F.col("features").cast("array<bigint>").alias("features"), "set_id")
    return rows.mapInArrow(make, f"set_id {kind}, n int, sketch binary")


def possible_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs(a, b)`` of a set of each side that may be at the threshold by their sketches."""
    return undecided_pairs(pairs, sketched(left), sketched(right), threshold)


def undecided_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs(a, b)`` that sketches ``(set_id, n, sketch)`` of each side do not rule out."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("a", "b").schema.fields)
    share = threshold / (1 + threshold)

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            total = frame.column(2).to_numpy().astype(np.int64) + frame.column(4).to_numpy()
            most = (total - 2 * np.ceil(share * total - 1e-9)).tolist()
            good = [least_differences(x, y) <= m for x, y, m in zip(
                frame.column(3).to_pylist(), frame.column(5).to_pylist(), most, strict=True)]
            yield frame.select([0, 1]).filter(pa.array(good, pa.bool_()))

    met = pairs.join(left.toDF("a", "n_a", "sketch_a"), "a").join(right.toDF("b", "n_b", "sketch_b"), "b")
    return met.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(check, kinds)
