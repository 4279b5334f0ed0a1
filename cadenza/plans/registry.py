"""Named queries (Spark) and their DuckDB oracle SQL.

Each registered callable takes ``(spark, sf_dir)`` and returns a DataFrame over
the whole driver tables. Doubles are rounded to 6 places on both sides and
integers are ``bigint`` on both sides so the order-insensitive compare sees
equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> None:
    from . import (q_features, q_ingest, q_io, q_model, q_search, q_sessions, q_stream,  # noqa: F401
                   q_text, q_vectors)


def sql_str(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"
