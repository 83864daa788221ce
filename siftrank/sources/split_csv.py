"""CSV files with quoted line breaks, read by many tasks each.

A line begins a record where an even number of quotes stands before it. Every split of a file counts its quotes
once; their running parity over the splits tells each split how it begins, so all splits are cut into records at
the same time. Only the records that reach over the border of a split are put together afterwards.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftrank.session import durable

_PLACE = "file string, start bigint"
_SUMMARY = f"{_PLACE}, quotes bigint, if_even bigint, if_odd bigint, header string"
_PIECES = f"{_PLACE}, number bigint, kind int, text string"
WHOLE, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order; a carriage return stays at a line's end."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(frame: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Parts of a batch that belong to one split."""
    files = frame.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = frame.column(1).to_numpy(zero_copy_only=False)
    new = np.flatnonzero(np.r_[True, (files[1:] != files[:-1]) | (starts[1:] != starts[:-1])]) if frame.num_rows else []
    for low, high in zip(new, [*new[1:], frame.num_rows]):
        part = frame.slice(low, high - low)
        yield (part.column(0)[0].as_py(), part.column(1)[0].as_py()), part


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _blank(values: pa.Array) -> np.ndarray:
    return pc.is_in(values, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def _summaries(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each split, how many records begin in it if it begins outside or inside quotes, and a file's header."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("if_even", pa.int64()),
                        ("if_odd", pa.int64()), ("header", pa.string())])
    here, total, even, odd, header = None, 0, 0, 0, []

    def row() -> pa.RecordBatch:
        text = "\n".join(header) if header else None
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*here, total, even, odd, text)))], schema)

    for frame in frames:
        for place, part in _runs(frame):
            if place != here:
                if here is not None:
                    yield row()
                here, total, even, odd, header, wanted = place, 0, 0, 0, [], place[1] == 0
            quotes, blank = _quotes(part.column(2)), _blank(part.column(2))
            before = (total + np.cumsum(quotes) - quotes) % 2 == 1
            even += int((~before & ~blank).sum())
            odd += int((before & ~blank).sum())
            for i in range(part.num_rows if wanted else 0):
                if not header and blank[i]:
                    continue
                header.append(part.column(2)[i].as_py())
                if sum(line.count('"') for line in header) % 2 == 0:
                    wanted = False
                    break
            total += int(quotes.sum())
    if here is not None:
        yield row()


def _pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split from rows (file, start, value, parity): whole ones, and the parts at its borders.

    A part that ends or only continues a record is a ``TAIL`` (several, if the record covers whole splits), one that
    begins a record without ending it a ``HEAD``; only the last piece of a split can be open.
    """
    here, total, number, held, begun = None, 0, 0, [], False
    out: list[tuple] = []

    def send() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)],
            names=["file", "start", "number", "kind", "text"])

    def close(kind: int) -> None:
        nonlocal number, held, begun
        out.append((*here, number if kind != TAIL else None, kind, "\n".join(held)))
        number += kind != TAIL
        held, begun = [], False

    for frame in frames:
        for place, part in _runs(frame):
            if place != here:
                if held:
                    close(HEAD if begun else TAIL)
                here, total, number, held, begun = place, part.column(3)[0].as_py(), 0, [], False
            quotes, blank = _quotes(part.column(2)), _blank(part.column(2))
            after = (total + np.cumsum(quotes)) % 2 == 1
            before = np.r_[total % 2 == 1, after[:-1]]
            total += int(quotes.sum())
            for text, inside, open_, empty in zip(part.column(2).to_pylist(), before, after, blank, strict=True):
                if not inside and not open_:
                    if not empty:
                        out.append((*here, number, WHOLE, text))
                        number += 1
                    continue
                begun = begun or not inside
                held.append(text)
                if not open_:
                    close(WHOLE if begun else TAIL)
            if len(out) >= 4_096:
                yield send()
    if held:
        close(HEAD if begun else TAIL)
    if out:
        yield send()


def header_names(headers: list[str]) -> list[str]:
    """Column names of all headers; files that differ are an error."""
    parsed = {tuple(next(csv.reader([h.lstrip("﻿").rstrip("\r")]))) for h in headers}
    if len(parsed) > 1:
        raise ValueError(f"CSV headers differ: {sorted(parsed)}")
    return list(parsed.pop()) if parsed else []


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(``record``, ``ord``) of all files, in the order of paths and lines from 1, and the column names.

    Empty lines are no records. What reaches one task in sum are a few numbers for each split and the pieces of
    records that lie over borders.
    """
    lines = _lines(spark, path)
    splits = lines.mapInArrow(_summaries, _SUMMARY)
    inside = F.sum("quotes").over(Window.partitionBy("file").orderBy("start")) - F.col("quotes")
    splits = splits.withColumn("parity", (inside % 2).cast("bigint"))
    begun = F.when(F.col("parity") == 0, F.col("if_even")).otherwise(F.col("if_odd"))
    records = begun - F.when((F.col("start") == 0) & F.col("header").isNotNull(), 1).otherwise(0)
    earlier = F.sum(records).over(Window.orderBy("file", "start")) - records
    splits = durable(splits.select("file", "start", "parity", earlier.alias("earlier"), "header"))
    headers = [r[0] for r in splits.where("header IS NOT NULL").groupBy(
        F.regexp_replace("header", "^﻿|\r$", "").alias("h")).agg(F.count("*")).limit(2).collect()]
    names = header_names(headers)
    placed = lines.join(F.broadcast(splits.select("file", "start", "parity")), ["file", "start"]).select("file", "start", "value", "parity")
    pieces = placed.mapInArrow(_pieces, _PIECES).join(F.broadcast(splits.select("file", "start", "earlier")), ["file", "start"])
    # The first record of a file is its header, which has no number.
    numbered = pieces.withColumn("ord", F.col("earlier") + F.col("number") + F.when(F.col("start") == 0, 0).otherwise(1))
    whole = numbered.where(F.col("kind") == WHOLE).select("file", "start", "number", "text", "ord")
    parts = numbered.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    parts = parts.withColumn("one", F.count_if(F.col("kind") == HEAD).over(order))
    joined = parts.groupBy("file", "one").agg(
        F.sort_array(F.collect_list(F.struct("start", (-F.col("kind")).alias("kind"), "text"))).alias("texts"),
        F.min("start").alias("start"), F.min("number").alias("number"), F.min("ord").alias("ord"))
    joined = joined.select("file", "start", "number", F.array_join(F.col("texts.text"), "\n").alias("text"), "ord")
    rows = whole.unionByName(joined)
    is_header = (F.col("start") == 0) & (F.col("number") == 0)
    return rows.where(~is_header).select(F.regexp_replace("text", "\r$", "").alias("record"), "ord"), names


def read_csv_splits(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files as strings, and ``ord``, the position of the row from 1.

    Quotes stand at the ends of a cell only, and are doubled inside it; line breaks inside quotes count as ``\\n``.
    """
    records, names = read_records(spark, path)
    if not names:
        return records.select("ord").where(F.lit(False))
    fields = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = F.from_csv(F.regexp_replace("record", "\r\n", "\n"), fields, {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    rows = records.select(parsed.alias("cells"), "ord")
    return rows.select(*[F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)], "ord")
