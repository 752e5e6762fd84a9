"""Registry of named queries: each is ``fn(spark, sf_dir) -> DataFrame`` plus,
where the result is SQL-expressible, the DuckDB text that must give the same
rows (column names aliased identically on both sides)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from quarry.plans import (  # noqa: F401
        eda_queries, quality_queries, clean_queries, feature_queries,
        chart_queries, metric_queries, model_queries, io_queries, report_queries)
