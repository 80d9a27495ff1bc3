"""Registered queries over the given tables, each with its SQL form."""

from martwright.plans import (  # noqa: F401
    checks,
    differences,
    history,
    incremental,
    ingest,
    lineage,
    marts,
    metrics,
    reconcile,
    revenue,
    semantic,
    sketches,
    streams,
    sweep,
    tests,
    writes,
)
from martwright.plans.registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
