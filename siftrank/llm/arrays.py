"""Shared pieces of the text operators: packed number arrays, text blocks and stored steps.

A *block* is one row that holds many whole texts of one input partition. Operators that
look millions of keys up per block (n-grams, words, anchors) send each distinct key of a
block once instead of once for each place it stands at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftrank.session import scratch_path

BLOCK_BYTES = 4 << 20


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Bytes of a number array; rising arrays are stored as differences."""
    if rising and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    if len(values) and values.dtype.itemsize > 1:
        # Byte planes: the high bytes of small numbers are runs of zeros.
        values = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpack(data: bytes, dtype, rising: bool = False) -> np.ndarray:
    """The array that :func:`pack` was given."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    if size > 1 and len(raw):
        raw = np.ascontiguousarray(raw.reshape(size, -1).T)
    values = raw.reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if rising else values


#: Bytes of rows that are handed to a Python worker at a time (more, if one row has more).
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes: ten thousand long texts in one batch would fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Spark's setting that removes the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write a step to the cluster's shared folder and read it back.

    Cuts the lineage, freezes values that depend on partition numbers, and keeps column
    pruning for its readers. The folder is the one ``spark.checkpoint.dir`` names. With
    ``clean`` the shuffle files of the writing query go when it ends: nothing needs them again.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true" if clean else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    step = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[step] = path
    return step


def dropped(*steps: DataFrame) -> None:
    """Delete the folders of stored steps that nothing reads any more, such as those whose successor is stored."""
    for step in steps:
        spark, where = step.sparkSession, _FOLDERS.pop(step)
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remainder_of_id(id_col: str | Column, divisor: int) -> Column:
    """crc32 of an id's decimal text, modulo ``divisor``: a fixed split of the records."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % divisor


def batches(schema: pa.Schema, rows: Iterator[tuple], per_batch: int = 64) -> Iterator[pa.RecordBatch]:
    """Record batches of row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= per_batch:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def block_rows(
    frames: Iterator[pa.RecordBatch], make: Callable[[list, list, list], tuple], size: int = BLOCK_BYTES
) -> Iterator[tuple]:
    """Cut the rows (id, flag, text) of one partition into blocks and call ``make`` on each.

    ``make(ids, flags, texts)`` gets UTF-8 texts (null: empty) and returns what follows the
    block number, which is the partition's number and a running number.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    number, ids, flags, texts, held = 0, [], [], [], 0
    for frame in frames:
        for i, flag, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(),
                                 frame.column(2).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            if held and held + len(data) > size:
                yield (part << 32 | number, *make(ids, flags, texts))
                number, ids, flags, texts, held = number + 1, [], [], [], 0
            ids.append(i)
            flags.append(flag)
            texts.append(data)
            held += len(data)
    if ids:
        yield (part << 32 | number, *make(ids, flags, texts))


class Places:
    """Position of keys in a sorted array of distinct keys; most are found in one table step."""

    def __init__(self, keys: np.ndarray, bits: int = 23):
        self.keys, self.bits = keys, bits
        self.table = np.zeros(1 << bits, np.uint32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.uint32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys``, all of which must be among the known keys."""
        place = self.table[self._slot(keys)]
        missed = np.flatnonzero(self.keys[place] != keys) if len(keys) else place
        if len(missed):
            place[missed] = np.searchsorted(self.keys, keys[missed])
        return place
