"""Review annotations on result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.functions.keys import annotation_key
from siftrank.functions.text import filled


def with_review(df: DataFrame, annotations: DataFrame, position: str = "rank_position") -> DataFrame:
    """Add key, status and note of the row's annotation in its own job.

    Rows with the same id share one annotation; annotations of other jobs do
    not apply.
    """
    right = annotations.select(
        "job_id", F.col("annotation_key").alias("review_annotation_key"), "review_status", "review_note"
    )
    keyed = df.withColumn("review_annotation_key", annotation_key("molecule_id", position))
    return keyed.join(right, ["job_id", "review_annotation_key"], "left").select(
        *df.columns, "review_annotation_key",
        F.coalesce(filled("review_status"), F.lit("unreviewed")).alias("review_status"),
        F.coalesce("review_note", F.lit("")).alias("review_note"),
    )


def review_counts(df: DataFrame) -> DataFrame:
    """``(position, review_status, label, rows)`` over all statuses in fixed order, zeros included."""
    counts = df.groupBy(F.coalesce(filled("review_status"), F.lit("unreviewed")).alias("review_status")).agg(
        F.count("*").alias("rows")
    )
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(s).alias("review_status"), F.lit(label).alias("label"))
        for i, (s, label) in enumerate(V.REVIEW_LABELS.items())
    ])
    statuses = df.sparkSession.range(1).select(F.explode(entries).alias("e")).select("e.*")
    return statuses.join(counts, "review_status", "left").select(
        "position", "review_status", "label", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def review_text(df: DataFrame) -> DataFrame:
    """One row ``review_summary``: ``Unreviewed: 3, Selected: 0, …``."""
    status = F.coalesce(filled("review_status"), F.lit("unreviewed"))
    parts = [
        F.concat(F.lit(f"{label}: "), F.count_if(status == s).cast("string"))
        for s, label in V.REVIEW_LABELS.items()
    ]
    text = F.when(F.count("*") > 0, F.concat_ws(", ", *parts)).otherwise(V.NOT_AVAILABLE)
    return df.agg(text.alias("review_summary"))
