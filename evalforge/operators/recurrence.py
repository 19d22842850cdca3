"""Exponential moving averages of runs of any length, exact and without one task per run.

``ema_i = a * ema_(i-1) + (1 - a) * x_i`` with ``ema_0 = x_0`` is the recurrence ``v_i = a * v_(i-1) + b_i`` from 0, with
``b_0 = x_0`` and ``b_i = (1 - a) * x_i``.  Inside a chunk of rows it is a running sum, scaled:
``v_k = a ** k * sum(b_j * a ** -j for j <= k) + a ** (k + 1) * carry``.  A chunk is as long as the scale stays inside a
double (1e140), CHUNK rows at most.  The last values of the chunks follow the same recurrence with ``a ** chunk`` in
place of ``a``, so carries are found by the same scan over one row a chunk, level by level, until the decay of a whole
chunk is below 1e-70 and the row before is all that counts.

Rows find their place in the run with ``ordering.along`` (windows inside spans of steps); all columns go along, so a
caller joins nothing back.  The levels follow from ``a`` alone, never from the number of rows; every history counts in
full, and the result differs from the loop only in rounding.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keys import null_safe_join
from .ordering import along

CHUNK, LEVELS = 4096, 4  # 4096 ** 4 rows a run, at a decay of 1, before a top window exceeds a chunk
SCALE, TINY = 140, 1e-70


def chunk_rows(a: float) -> int:
    """Rows whose decay stays within 10 ** SCALE."""
    return CHUNK if a >= 1 else max(2, min(CHUNK, int(SCALE / -math.log10(a))))


def _scan(rows: DataFrame, run: str, a: float, levels: int = LEVELS) -> DataFrame:
    """``rows`` (run, _i from 0, _b, _skip, ...) with ``_v``: ``v_i = a v_(i-1) + b_i`` from 0.

    A row with ``_skip`` adds nothing: it stands behind the row of the same ``_i``."""
    if a < TINY:
        was = along(rows, [run], "_i", lags={"_was": F.col("_b")}) if a > 0 else rows.withColumn("_was", F.lit(0.0))
        return was.withColumn("_v", F.col("_b") + F.lit(a) * F.coalesce("_was", F.lit(0.0))).drop("_was")
    size = chunk_rows(a) if levels else 1 << 62
    power = lambda k: F.pow(F.lit(a), k)
    w = Window.partitionBy(run, "_g").orderBy("_i", "_skip").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = (rows.withColumn("_g", F.floor(F.col("_i") / size)).withColumn("_k", F.col("_i") - F.col("_g") * size)
             .withColumn("_l", power(F.col("_k")) * F.sum(F.col("_b") * power(-F.col("_k"))).over(w)))
    if not levels:
        return parts.withColumnRenamed("_l", "_v").drop("_g", "_k")
    ends = parts.groupBy(run, F.col("_g").alias("_i")).agg(F.max_by("_l", "_i").alias("_b")).withColumn("_skip", F.lit(False))
    carried = _scan(ends, run, a ** size, levels - 1).select(run, (F.col("_i") + 1).alias("_g"), F.col("_v").alias("_carry"))
    out = null_safe_join(parts, carried, [run, "_g"], "left")
    return (out.withColumn("_v", F.col("_l") + power(F.col("_k") + 1) * F.coalesce("_carry", F.lit(0.0)))
            .drop("_g", "_k", "_l", "_carry"))


def scan_ema(batches: DataFrame, run: str, step: str, x: str, alpha: float, name: str = "ema") -> DataFrame:
    """All columns of ``batches`` and ``name``.  A row without a value has no average and leaves the others' alone; a NULL
    run is a run of its own; steps are unique within a run."""
    a, b = float(alpha), round(1.0 - float(alpha), 12)
    if not 0 <= a <= 1:
        raise ValueError("alpha must be from 0 to 1")
    v = F.col(x).cast("double")
    numbered = along(batches, [run], step, sums={"_n": F.when(F.col(x).isNotNull(), F.lit(1).cast("long"))})
    rows = (numbered.withColumn("_i", F.coalesce(F.col("_n") - 1, F.lit(-1).cast("long"))).withColumn("_skip", F.col(x).isNull())
            .withColumn("_b", F.when(F.col("_i") == 0, v).otherwise(F.lit(b) * v)).drop("_n"))
    if a == 0:
        scanned = rows.withColumn("_v", v)
    else:
        scanned = _scan(rows, run, a)
    return scanned.withColumn(name, F.when(~F.col("_skip"), F.col("_v"))).drop("_i", "_skip", "_b", "_v")
