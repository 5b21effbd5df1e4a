"""All queries over the given tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.plans import functions, logins, report, search

PARTS = (logins, search, report, functions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
