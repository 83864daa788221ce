"""Bounded samples of labelled records, the same for the same data wherever its rows lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, group_col: str, per_group: int, id_col: str = "id") -> DataFrame:
    """At most ``per_group`` rows of each group, those with the smallest hashes of their ids.

    A first pass counts the groups and sets a hash limit for each that lets through a little more
    than ``per_group`` rows, so only those few are numbered.
    """
    span = 1 << 62
    sizes = rows.groupBy(group_col).agg(F.count("*").alias("_n")).select(
        F.col(group_col).alias("_group"), F.least(F.lit(1.0), F.lit(1.1 * per_group + 50) / F.col("_n")).alias("_share"))
    hashed = rows.withColumn("_hash", F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(span - 1))
    chosen = hashed.join(F.broadcast(sizes.limit(100_000)), F.col(group_col).eqNullSafe(F.col("_group"))).where(
        F.col("_hash") <= F.col("_share") * float(span))
    order = Window.partitionBy(group_col).orderBy("_hash", id_col)
    return chosen.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_group).drop(
        "_hash", "_group", "_share", "_place")
