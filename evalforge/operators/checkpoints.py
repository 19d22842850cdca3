"""Checkpoint selection and naming.

The set of checkpoints is small metadata (one row per saved checkpoint),
but every operator here is still a distributed aggregate: the best pick is
a single ``min_by`` over ``(-metric, name)``, so no sort and no driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CHECKPOINT_PREFIX = "checkpoint-"
SELECTION_METRICS = ("avg_fine_tuned_score", "avg_fine_tuned_reward_normalized", "avg_improvement",
                     "avg_reward_improvement")
DEFAULT_SELECTION_METRIC = "avg_fine_tuned_reward_normalized"
KEEP_LAST = 3


def is_checkpoint(name: Column) -> Column:
    """Names starting with ``checkpoint-``."""
    return F.startswith(name, F.lit(CHECKPOINT_PREFIX))


def _num(name: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).try_cast("bigint")


def parse_checkpoint_name(name: Column) -> list[Column]:
    """epoch ``e<n>``, batch ``b<n>``, step ``gs<n>`` (or a bare trailing
    number), ``end`` / ``final`` flags.  Unparseable parts are NULL (the
    reference's ``int(last piece)`` raises on the documented names)."""
    epoch = _num(name, r"(^|-)e([0-9]+)(-|$)")
    batch = _num(name, r"(^|-)b([0-9]+)(-|$)")
    gs = _num(name, r"(^|-)gs([0-9]+)(-|$)")
    trailing = _num(name, r"(-)([0-9]+)$")
    return [epoch.alias("epoch"), batch.alias("batch"), F.coalesce(gs, trailing).alias("step"),
            F.regexp_like(name, F.lit(r"(^|-)end(-|$)")).alias("is_end"),
            F.regexp_like(name, F.lit(r"(^|-)final(-|$)")).alias("is_final")]


def best_checkpoint(stats: DataFrame, name: str = "checkpoint",
                    metric: str = DEFAULT_SELECTION_METRIC) -> DataFrame:
    """O2: one row: best checkpoint by ``metric`` (NULL/NaN skipped, ties to
    the first name), its value, and the number of checkpoints; "no best"
    still yields the row with NULLs."""
    if metric not in SELECTION_METRICS:
        raise ValueError(f"unknown selection metric {metric!r}")
    m = F.when(~F.isnan(F.col(metric)), F.col(metric))
    order = F.when(m.isNotNull(), F.struct((-m).alias("neg"), F.col(name).alias("n")))
    return stats.agg(F.min_by(F.col(name), order).alias("best_checkpoint"),
                     F.max(m).alias("best_metric_value"),
                     F.count(F.lit(1)).alias("num_checkpoints"),
                     F.lit(metric).alias("selection_metric"))


def retain_latest(ckpts: DataFrame, step: str = "step", keep: int = KEEP_LAST) -> DataFrame:
    """The newest ``keep`` checkpoints by step (TakeOrderedAndProject)."""
    return ckpts.orderBy(F.col(step).desc_nulls_last()).limit(int(keep))


def expand_checkpoints(scored: DataFrame, listing: DataFrame) -> DataFrame:
    """Every checkpoint of ``listing`` beside every row of ``scored`` (a struct ``ckpt``).

    The listing is metadata, one row a saved checkpoint; it reaches the rows as one scalar subquery, so nothing is
    collected or broadcast by hand.  Score before you expand: what is wide (texts) should not be in ``scored``."""
    saved = listing.agg(F.collect_list(F.struct(*listing.columns)).alias("saved")).scalar()
    return scored.withColumn("ckpt", F.explode(saved))
