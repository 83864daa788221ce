"""Run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank import vocab as V
from siftrank.operators.filters import completed_runs


def _on(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def history_view(runs: DataFrame) -> DataFrame:
    """The history columns of runs; the overall flag is true if any lookup was requested."""
    each = {f: _on(f) for f in V.LOOKUP_FLAGS}
    overall = _on("public_lookup_requested")
    for flag in each.values():
        overall = overall | flag
    return runs.select(
        *[c for c in V.HISTORY_COLUMNS if c != "row_count"],
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        overall.alias("public_lookup_requested"),
        *[v.alias(k) for k, v in each.items()],
    )


def run_history(runs: DataFrame, limit: int = V.HISTORY_LIMIT) -> DataFrame:
    """Completed runs, newest first."""
    recent = completed_runs(runs).orderBy(F.desc("completed_at"), "job_id").limit(limit)
    return history_view(recent)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest completed run (first by id among equals): one row, or none."""
    return completed_runs(runs).orderBy(F.desc("completed_at"), "job_id").limit(1)


def latest_rows(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of the newest completed run; only its partition is read."""
    newest = latest_run(runs).select("job_id").first()
    if newest is None:
        return results.limit(0)
    return results.where(F.col("job_id") == newest["job_id"])


def merge_history(history: DataFrame, run: DataFrame) -> DataFrame:
    """Replace the runs with the same ids and sort newest first."""
    others = history.join(run.select("job_id").distinct(), "job_id", "left_anti")
    return others.unionByName(history_view(run)).orderBy(F.desc("completed_at"), "job_id")
