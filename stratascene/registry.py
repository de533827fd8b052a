"""Where queries register, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.adapters import duckdb_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *used: str):
    """Register a query and, over the scene views that it uses, its SQL; SQL that goes on with more views starts with a comma, after ``RECURSIVE`` if one of them is."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            views = duckdb_views(*used).rstrip() if used else ""
            rest = sql.removeprefix("RECURSIVE")
            if rest != sql:
                views = views.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLE_SQL[name] = f"{views}{rest}" if rest.startswith(",") else f"{views} {rest}" if views else rest
        return f

    return register


def rounded(c: str | Column, alias: str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(alias)
