"""Registry of the bound queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``key`` with an optional DuckDB twin."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def load_all() -> None:
    """Import every query module once."""
    from gradelake.plans import (  # noqa: F401
        q_text,
        q_grade,
        q_pages,
        q_eval,
        q_request,
        q_tree,
        q_layout,
        q_scaffold,
        q_geometry,
        q_raster,
    )
