"""Collects the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.catalog.proxies import Inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Inputs], DataFrame]], Callable]:
    """Register a function of the inputs under ``name``, with its SQL twin."""

    def add(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            TWINS[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    """Round double columns (all of them by default) for comparison."""
    from pyspark.sql import functions as F

    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})
