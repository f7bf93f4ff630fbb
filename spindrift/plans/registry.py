"""All queries by name, with the SQL that DuckDB runs over the same tables for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """df with the named doubles to six places."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


from spindrift.plans import queries_crawl, queries_graph, queries_rules, queries_tables  # noqa: E402, F401
