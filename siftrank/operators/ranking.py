"""Ranking and previews of prioritised rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank import vocab as V


def ranked(df: DataFrame, score: str = "priority_score", ordinal: str = "ord") -> DataFrame:
    """Score descending; equal scores keep the input order."""
    return df.orderBy(F.desc(score), F.asc(ordinal))


def preview(df: DataFrame, position: str = "rank_position", rows: int = V.PREVIEW_LIMIT) -> DataFrame:
    """First rows of a filtered table."""
    return df.orderBy(position).limit(rows)
