"""The registered queries: each a DataFrame builder, most with equal SQL to check it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)`; `sql` is the same result in DuckDB's dialect."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    from folioscope.plans import (  # noqa: F401
        queries_assembly,
        queries_budget,
        queries_documents,
        queries_graph,
        queries_grounding,
        queries_operations,
        queries_search,
        queries_streams,
        queries_text,
    )
