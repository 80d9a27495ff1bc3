"""Name, Spark form and SQL form of each query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Register a function under its own name."""

    def keep(build: Build) -> Build:
        if build.__name__ in REGISTRY:
            raise ValueError(f"query {build.__name__} is registered twice")
        REGISTRY[build.__name__] = Query(build, sql)
        return build

    return keep
