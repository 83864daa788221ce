"""Row filters of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions.keys import safe_job_id
from siftrank.functions.numbers import is_false, is_true, to_number
from siftrank.functions.text import filled, title_label


def evidence_filter(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Conjunction of the given filters; a blank filter is off.

    Plain equality on the filterable columns (so it reaches the file scan),
    ``priority_score_min`` and ``valid_molecule`` = ``valid`` / ``invalid``.
    """
    for name in V.FILTER_COLUMNS:
        wanted = filters.get(name)
        if wanted not in (None, ""):
            df = df.where(_equals(df, name, str(wanted)))
    minimum = filters.get("priority_score_min")
    if minimum not in (None, ""):
        df = df.where(F.col("priority_score") >= float(minimum))
    if filters.get("valid_molecule") == "valid":
        df = df.where(is_true("valid_molecule"))
    elif filters.get("valid_molecule") == "invalid":
        df = df.where(is_false("valid_molecule"))
    return df


def _equals(df: DataFrame, name: str, wanted: str) -> Column:
    if df.schema[name].dataType.typeName() == "boolean":
        return F.col(name) if wanted.lower() == "true" else ~F.col(name)
    return F.col(name) == wanted


def with_status_in(df: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows of these review statuses; a blank status counts as unreviewed."""
    return df.where(F.coalesce(filled("review_status"), F.lit("unreviewed")).isin(*statuses))


def completed_runs(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("status") == "completed") & filled(F.col("completed_at").cast("string")).isNotNull())


def plottable(df: DataFrame) -> DataFrame:
    """Rows with two finite coordinates."""
    both = [to_number(c).isNotNull() for c in ("chemical_space_x", "chemical_space_y")]
    return df.where(reduce(lambda a, b: a & b, both))


def known_jobs(requested: DataFrame, runs: DataFrame) -> DataFrame:
    """Requested job ids that are safe names and exist."""
    return requested.where(safe_job_id("job_id")).join(runs.select("job_id"), "job_id", "left_semi")


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-blank values with their labels."""
    values = df.select(F.col(column).cast("string").alias("value")).where(filled("value").isNotNull()).distinct()
    return values.withColumn("label", title_label("value")).orderBy("value")
