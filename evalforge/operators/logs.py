"""Run-summary log views: fixed column projection (P8), nested flatten (P9),
tail (O4).  Flattening walks the *schema* on the driver (metadata only) and
emits aliased column references, so the data side is a pure projection that
prunes every unused nested field at the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The column paths of the batch and epoch views, in order.
BATCH_COLUMNS = (
    "ts_iso", "epoch", "batch_idx", "global_step", "batch_size", "generation_backend",
    "timing_s.generation", "timing_s.scoring", "timing_s.training", "timing_s.total",
    "tokens.gen_raw", "tokens.gen_kept",
    "throughput_tok_s.gen_raw_overall", "throughput_tok_s.gen_kept_overall", "throughput_tok_s.training",
    "samples.dup_filtered", "samples.diversity_ratio", "rewards.mean",
    "reward_gain.gain_from_baseline", "reward_gain.gain_vs_prev_batch", "reward_gain.ema_reward",
    "reward_gain.ema_gain_from_baseline", "loss.loss",
)
EPOCH_COLUMNS = (
    "ts_iso", "epoch", "generation_backend", "epoch_time_s", "avg_reward", "avg_loss", "reward_trend",
    "loss_trend", "api.calls", "api.cache_hit_rate", "diversity.unique_ratio",
    "performance.generation.tok_s_raw", "performance.generation.tok_s_kept", "performance.training.tok_s",
)


def _ref(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def flatten_columns(schema: StructType, parents: tuple[str, ...] = ()) -> list[Column]:
    """Every leaf of a nested struct as a column named by its dotted
    path (a key may hold dots itself); arrays and maps are kept whole; an
    empty struct vanishes."""
    out: list[Column] = []
    for f in schema.fields:
        path = (*parents, f.name)
        if isinstance(f.dataType, StructType):
            out.extend(flatten_columns(f.dataType, path))
        else:
            out.append(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)))
    return out


def flatten(df: DataFrame) -> DataFrame:
    return df.select(*flatten_columns(df.schema))


def _has_path(schema: StructType, path: str) -> bool:
    t = schema
    for p in path.split("."):
        if not isinstance(t, StructType) or p not in t.fieldNames():
            return False
        t = t[p].dataType
    return True


def project_log(df: DataFrame, columns: Sequence[str] = BATCH_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """The fixed dotted paths in order; a path missing from the log
    schema becomes a NULL column (rendered as empty text by the viewer)."""
    cols = [F.col(k) for k in keep]
    for c in columns:
        if c in df.columns:                   # already flattened: the dotted name is one column
            ref = F.col(f"`{c}`")
        elif _has_path(df.schema, c):         # nested: walk the struct path
            ref = _ref(c)
        else:
            ref = F.lit(None).cast("string")
        cols.append(ref.alias(c))
    return df.select(*cols)
