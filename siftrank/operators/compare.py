"""Comparison of two runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions.keys import comparison_key
from siftrank.functions.numbers import round_dp, to_number
from siftrank.functions.text import filled, strip, values_differ
from siftrank.operators.joins import first_per_key


def dedupe_first(df: DataFrame, key: str, position: str) -> DataFrame:
    """First row per key by position."""
    return first_per_key(df, [key], F.col(position))


def with_comparison_key(df: DataFrame, position: str = "rank_position") -> DataFrame:
    return df.withColumn(
        "comparison_key", comparison_key("molecule_id", "canonical_smiles", "input_smiles", position)
    )


def compare_runs(a: DataFrame, b: DataFrame, position: str = "rank_position") -> DataFrame:
    """Full outer join of two runs on the comparison key.

    Both sides' columns get ``_a`` / ``_b``, the score change exists only with
    two numbers, and the change flags are false unless the key is on both
    sides.  ``sort_label`` carries the label of the output order.
    """
    types = dict(a.dtypes) | dict(b.dtypes)
    left, right = _side(a, "a", position, types), _side(b, "b", position, types)
    joined = left.join(right, "comparison_key", "full")
    here, there = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    both = here & there
    flags = {
        flag: both & reduce(lambda x, y: x | y, [values_differ(f"{c}_a", f"{c}_b") for c in columns])
        for flag, columns in V.CHANGE_FLAGS.items()
    }
    change = to_number("priority_score_b") - to_number("priority_score_a")
    pairs = [f"{c}_{s}" for c in V.COMPARED_COLUMNS for s in ("a", "b")]
    return joined.select(
        "comparison_key",
        F.coalesce("molecule_id_a", "molecule_id_b").alias("molecule_id"),
        F.when(both, "both").when(here, "only_in_run_a").otherwise("only_in_run_b").alias("presence"),
        *pairs,
        round_dp(change, 6).alias("priority_score_change"),
        *[v.alias(k) for k, v in flags.items()],
        F.when(here, _sort_label("a")).otherwise(_sort_label("b")).alias("sort_label"),
    )


def _side(df: DataFrame, suffix: str, position: str, types: dict[str, str]) -> DataFrame:
    names = ["molecule_id", *V.COMPARED_COLUMNS]
    filledup = df.withColumns({
        n: F.lit(None).cast(types.get(n, "string")) for n in names if n not in df.columns
    })
    rows = dedupe_first(
        with_comparison_key(filledup, position).select("comparison_key", position, *names),
        "comparison_key", position,
    )
    return rows.select(
        "comparison_key", *[F.col(n).alias(f"{n}_{suffix}") for n in names],
        F.lit(True).alias(f"in_{suffix}"),
    )


def _sort_label(suffix: str) -> Column:
    names = [filled(strip(f"{c}_{suffix}")) for c in ("molecule_id", "canonical_smiles")]
    return F.coalesce(*names, F.lit(""))


def in_comparison_order(rows: DataFrame, collation: str | None = None) -> DataFrame:
    """By label, in a locale order such as ``UNICODE`` if named; the key makes the order total."""
    label = F.collate("sort_label", collation) if collation else F.col("sort_label")
    return rows.orderBy(label, "comparison_key")


def comparison_summary(rows: DataFrame) -> DataFrame:
    """One row of eight counts; zeros on empty input."""
    flags = [F.count_if(F.col(f)).alias(f) for f in V.CHANGE_FLAGS]
    return rows.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("presence") == "both").alias("shared"),
        F.count_if(F.col("presence") == "only_in_run_a").alias("only_in_run_a"),
        F.count_if(F.col("presence") == "only_in_run_b").alias("only_in_run_b"),
        *flags,
    )


def largest_changes(rows: DataFrame, limit: int = V.TOP_CHANGES) -> DataFrame:
    """Rows on both sides with the largest absolute score change."""
    both = rows.where((F.col("presence") == "both") & F.col("priority_score_change").isNotNull())
    return both.orderBy(
        F.abs("priority_score_change").desc(), "sort_label", "comparison_key"
    ).limit(limit)


def key_classes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two tables and where they occur."""
    tagged = a.select(key, F.lit(1).alias("side")).unionByName(b.select(key, F.lit(2).alias("side")))
    sides = tagged.groupBy(key).agg(F.bit_or("side").alias("sides"))
    return sides.select(
        key,
        F.when(F.col("sides") == 3, "both").when(F.col("sides") == 1, "only_in_run_a")
        .otherwise("only_in_run_b").alias("presence"),
    )


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()
