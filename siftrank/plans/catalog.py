"""All registered queries."""

from __future__ import annotations

from siftrank.plans import queries_lookup, queries_output, queries_rows, queries_runs, queries_similar  # noqa: F401
from siftrank.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
