"""Registry of named queries over the driver tables and their DuckDB oracle SQL.

A plan module registers ``@query(name, sql=...)`` functions taking
``(spark, sf_dir)`` and returning a DataFrame.  ``sql=None`` marks a query
with no SQL equivalent (stateful streaming, Python plug-ins); those are
checked against brute force in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r6(c: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Doubles are compared after rounding to 6 places on both sides (9 where
    exact decimal ties at the 7th place are common, e.g. slopes of 4-decimal
    values over small integer spans)."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits)
    return out.alias(name or (c if isinstance(c, str) else "value"))
