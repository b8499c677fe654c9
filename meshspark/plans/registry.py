"""Where queries and the SQL that gives the same rows are put down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.fixtures import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Register a function under its name, with SQL over the derived tables named."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return put


def r6(c, name: str) -> Column:
    """Six digits, no minus zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def s6(sql: str, name: str) -> str:
    """The same in SQL."""
    return f"round({sql}, 6) + 0e0 AS {name}"
