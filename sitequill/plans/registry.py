"""Registry of named queries: a Spark builder and, where SQL can say it, a
DuckDB oracle over the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, oracle: str | None = None, headline: bool = False):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        if headline:
            HEADLINE.append(name)
        return fn

    return wrap


def load_all() -> None:
    """Import every query module so its registrations run."""
    from . import q_assets, q_consolidate, q_fusion, q_html, q_library, q_pipeline, q_progress, q_tree, q_urls  # noqa: F401
