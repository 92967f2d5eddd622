"""All registered queries, by name, with their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import changes, layout, reads, upkeep, writes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in (reads, changes, layout, writes, upkeep) for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in (reads, changes, layout, writes, upkeep) for name, (_, sql) in part.QUERIES.items() if sql}
