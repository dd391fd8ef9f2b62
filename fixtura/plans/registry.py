"""Queries and their SQL twins by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, cast: dict[str, str] | None = None):
    """Register a function (spark, sf_dir) under its name, with the DuckDB SQL of the same rows; ``cast``: columns whose SQL type differs."""

    def put(f):
        key = f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql and cast:
            SQL[key] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in cast.items())}) FROM ({sql})"
        elif sql:
            SQL[key] = sql
        return f

    return put


def six(c: Column | str, name: str | None = None) -> Column:
    """Six decimals for comparison with SQL."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if isinstance(name or c, str) else out
