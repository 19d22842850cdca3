"""Global positions without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row to
one task.  Instead: range-partition on the order, sort within partitions,
number rows inside each partition (``monotonically_increasing_id`` encodes
the partition index in the high bits), and add the per-partition offsets,
computed from a table with one row per *partition* (bounded by the number
of partitions, not the data).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .keys import null_safe_join


def global_position(df: DataFrame, order: Sequence[Column], num_partitions: int | None = None,
                    name: str = "position") -> DataFrame:
    """0-based position of each row in the total order ``order`` (must be a
    strict order, e.g. ending in a unique key)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    # the write pins the sampled range boundaries and ids, so a retried
    # task after an executor loss cannot renumber rows
    ranged = staged(ranged, "positions")
    ranged = ranged.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
    per_part = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a tiny frame, so the unpartitioned window is bounded
    offsets = per_part.select(
        "_pid", (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + (F.col("_mid") - F.shiftleft(F.col("_pid"), 33)))
            .drop("_mid", "_pid", "_off"))


def stage_of(position: Column, total: Column | int, stages: int) -> Column:
    """Equal-width stages over positions (like ``ntile`` when total % stages == 0)."""
    t = total if isinstance(total, Column) else F.lit(int(total))
    return F.floor(position * F.lit(int(stages)) / t).cast("int")


def group_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank",
               num_partitions: int | None = None) -> DataFrame:
    """1-based rank inside each group without a per-group window.

    The rows are ranked globally by ``(group..., order...)`` with
    ``global_position`` (range partitioning splits a hot group across many
    tasks); a group's rank is its global position minus the position of the
    group's first row, found by a partial ``min`` aggregate.  Adds ``name``
    and ``<name>_count`` (the group size)."""
    ordered = [F.col(g).asc() for g in group] + list(order)
    pos = global_position(df, ordered, num_partitions, name="_gpos")
    starts = pos.groupBy(*group).agg(F.min("_gpos").alias("_gstart"), F.count(F.lit(1)).alias(f"{name}_count"))
    return (null_safe_join(pos, starts, group)
            .withColumn(name, F.col("_gpos") - F.col("_gstart") + 1)
            .drop("_gpos", "_gstart"))


CHUNK_STEPS = 4096


def along(df: DataFrame, group: Sequence[str], step: str, sums: Mapping[str, Column] | None = None,
          lags: Mapping[str, Column] | None = None, size: int = CHUNK_STEPS) -> DataFrame:
    """Running sums and previous values in the order of a numeric ``step`` inside each group.

    A group is cut into spans of ``size`` steps: windows run inside (group, span), and one row a
    span (its total and last values) carries what came before, so a group of any length is spread
    over many tasks.  NULL groups are groups; steps are unique within a group."""
    sums, lags = dict(sums or {}), dict(lags or {})
    own = df.withColumns({"_span": F.floor(F.col(step) / size), **{f"_s{i}": c for i, c in enumerate(sums.values())},
                          "_v": F.struct(F.lit(0).alias("_0"), *[c.alias(f"v{i}") for i, c in enumerate(lags.values())])})
    spans = own.groupBy(*group, "_span").agg(*[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(sums))],
                                             F.max_by("_v", step).alias("_end"))
    by_span = Window.partitionBy(*group).orderBy("_span")
    before = by_span.rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*group, "_span", *[F.sum(f"_t{i}").over(before).alias(f"_b{i}") for i in range(len(sums))],
                           F.lag("_end").over(by_span).alias("_was"))
    w = Window.partitionBy(*group, "_span").orderBy(step)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.when(F.row_number().over(w) == 1, F.col("_was")).otherwise(F.lag("_v").over(w))
    out = null_safe_join(own, carried, [*group, "_span"])
    new = {}
    for i, name in enumerate(sums):
        here = F.sum(f"_s{i}").over(so_far)
        new[name] = F.coalesce(F.col(f"_b{i}") + here, F.col(f"_b{i}"), here)
    for i, name in enumerate(lags):
        new[name] = last[f"v{i}"]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[c.alias(n) for n, c in new.items()])


BRACKET = 10_000  # accuracy of the sketch: a rank is off by at most 1 in BRACKET


def exact_percentile(df: DataFrame, group: Sequence[str], value: str, p: float, name: str = "percentile",
                     accuracy: int = BRACKET) -> DataFrame:
    """Exact percentile with linear interpolation (``percentile`` / ``quantile_cont``: position ``(n - 1) * p``) per
    group, by selection: no value is sorted but the few around the position.

    1. A mergeable quantile sketch a group, one partial aggregate, brackets the position: its ranks are off by at
       most n / accuracy, and the bracket is taken 3 n / accuracy wide to either side (a group of up to ``accuracy``
       rows is its own bracket).
    2. A second pass counts the values below the bracket and, each distinct value once, those inside it; both are
       partial aggregates, so a group with a third of the rows is no hot task.  Running counts over the distinct
       values inside, some 6 n / accuracy rows a group at most, then name the two values at the position.

    Only groups of more than ``accuracy`` rows have a bracket, so there are at most rows / accuracy of them: they are
    broadcast, and no row moves to the task of its group.

    NULL values are ignored; a NULL group is a group; NaN is the largest value."""
    group, p = list(group), float(p)
    v = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    low, high = p - 3.0 / accuracy, p + 3.0 / accuracy
    cuts = F.percentile_approx("_v", [max(0.0, low), min(1.0, high)], accuracy)
    seen = v.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                 cuts.alias("_q"))
    brackets = seen.where(F.col("_n") > accuracy).select(
        *group, "_n", F.when(F.lit(low <= 0), F.col("_min")).otherwise(F.get("_q", F.lit(0))).alias("_lo"),
        F.when(F.lit(high >= 1), F.col("_max")).otherwise(F.get("_q", F.lit(1))).alias("_hi"))
    near = (null_safe_join(v, F.broadcast(brackets), group, "left").where(F.col("_n").isNull() | (F.col("_v") <= F.col("_hi")))
            .groupBy(*group, F.when(F.col("_n").isNull() | (F.col("_v") >= F.col("_lo")), F.col("_v")).alias("_v"))  # null: below
            .agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n")))
    up_to = F.sum("_c").over(Window.partitionBy(*group).orderBy(F.col("_v").asc_nulls_first())
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.coalesce(F.col("_n"), F.sum("_c").over(Window.partitionBy(*group)))  # without a bracket all rows are here
    at = (total - 1) * F.lit(p)
    first_over = lambda k: F.min(F.when(F.col("_up") > k, F.col("_v")))
    got = near.withColumn("_up", up_to).withColumn("_at", at).groupBy(*group).agg(
        first_over(F.floor("_at")).alias("_a"), first_over(F.ceil("_at")).alias("_b"), F.first("_at").alias("_at"))
    return got.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias(name))
