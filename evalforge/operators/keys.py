"""Joins on keys that may be NULL: a NULL key is a group of its own, as in GROUP BY."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys meet NULL keys; the key columns of ``left`` stay."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    r = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(r, on, how).drop(*names.values())
