"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftrank.session import durable

HOT_ROWS = 1_000_000
#: The most keys that are ever broadcast: heavier ones than a share of 1 / MOST_HOT of all rows.
MOST_HOT = 10_000
SPREAD = 997


def attach_per_key(
    rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str,
    how: str = "left", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join one-row-per-key columns to many rows without piling a hot key on one task.

    ``per_key[weight]`` is the number of rows of the key.  The per-key table is
    stored first (it is read more than once) and checked for keys heavier than
    ``hot_rows`` and than ``1 / MOST_HOT`` of all rows; without any this is a
    plain join.  Otherwise the heavy keys, fewer than ``MOST_HOT`` whatever the
    data, are broadcast, the other keys are joined by shuffle, and rows already
    served by the broadcast are spread over many partitions there.
    """
    per_key = durable(per_key)
    top, total = per_key.agg(F.coalesce(F.max(weight), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    limit = max(hot_rows, total // MOST_HOT)
    heavy = F.col(weight) > limit
    if top <= limit:
        return rows.join(per_key, keys, how).select(
            *rows.columns, *[c for c in per_key.columns if c not in keys]
        )
    values = [c for c in per_key.columns if c not in keys]
    hot = per_key.where(heavy).select(*keys, F.struct(*values).alias("_hot"))
    cold = per_key.where(~heavy).select(
        *keys, F.lit(0).cast("bigint").alias("_spread"), F.struct(*values).alias("_cold")
    )
    spread = F.when(
        F.col("_hot").isNotNull(),
        F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SPREAD)) + 1,
    ).otherwise(F.lit(0)).cast("bigint")
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_spread", spread)
        .join(cold, [*keys, "_spread"], "left")
    )
    found = F.coalesce("_hot", "_cold")
    if how == "inner":
        joined = joined.where(found.isNotNull())
    picked = [found[v].alias(v) for v in values]
    return joined.select(*[F.col(c) for c in rows.columns], *picked)


def attach_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """:func:`attach_per_key` for a table without weights: the rows of its keys are counted first."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    joined = attach_per_key(rows, per_key.join(counts, keys), keys, "_rows", how)
    return joined.drop("_rows")


def first_per_key(df: DataFrame, keys: list[str], order: Column, columns: list[str] | None = None) -> DataFrame:
    """First row per key by ``order``; aggregated map-side, so hot keys shrink before the shuffle."""
    names = columns or [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*names), order).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def rank_positions(
    df: DataFrame, score: str = "priority_score", ordinal: str = "ord", name: str = "rank_position"
) -> DataFrame:
    """0-based position by (score descending, ordinal), lazily and without one global window.

    Scores are rounded to three decimals, so there are few distinct ones.  Rows
    are counted per (score, block of 2^20 ordinals); running totals of these
    few counts are the offsets, and only rows of one block are ever sorted
    together.
    """
    block = F.floor(F.col(ordinal) / (1 << 20)).cast("bigint")
    scored = df.withColumns({"_score": F.coalesce(F.col(score), F.lit(0.0)), "_block": block})
    counts = scored.groupBy("_score", "_block").agg(F.count("*").alias("_n"))
    totals = counts.groupBy("_score").agg(F.sum("_n").alias("_total"))
    before_score = totals.select(
        "_score",
        (F.sum("_total").over(Window.orderBy(F.desc("_score"))) - F.col("_total")).alias("_above"),
    )
    inside = Window.partitionBy("_score").orderBy("_block")
    offsets = (
        counts.withColumn("_earlier", F.sum("_n").over(inside) - F.col("_n"))
        .join(before_score, "_score")
        .select("_score", "_block", (F.col("_above") + F.col("_earlier")).alias("_offset"))
    )
    local = Window.partitionBy("_score", "_block").orderBy(ordinal)
    return (
        scored.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, ["_score", "_block"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_score", "_block", "_n", "_offset", "_local")
    )


def dense_positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position in a total order, for any number of rows and any key type.

    The rows are range-partitioned and sorted, the place inside the partition
    is frozen by a checkpoint, and the partition offsets (one row per
    partition) are added.
    """
    placed = durable(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset")
    )
    inside = F.col("_place") - F.shiftleft(F.shiftright("_place", 33), 33)
    return (
        placed.withColumns({"_part": part, "_inside": inside})
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_part", "_inside", "_place", "_offset")
    )
