"""Run-log analytics: batch/epoch aggregates, trends, gains, running totals.

Grain matters for scale: samples are first reduced to one row per batch by
a partial (map-side combined) aggregate.  Running sums and previous values go
through ``ordering.along``: windows inside spans of a run's steps and one
carried row a span, so a run of any length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import null_safe_join
from .ordering import along

# Fixed values (documented defaults of the reference's configuration).
BASELINE_BATCHES = 15          # baseline = mean reward of the first 15 batches
EMA_ALPHA = 0.8                # ema = alpha * prev + (1 - alpha) * x
KL_START, KL_TARGET, KL_GAIN = 0.10, 0.075, 0.1
HEALTH_GRACE_BATCHES = 3
HEALTH_INTERVAL_BATCHES = 5
HEALTH_GEN_BOTTLENECK_PCT = 85.0
HEALTH_GEN_TARGET_TPS = 6.0
HEALTH_FRAGMENTATION_GB = 10.0
HEALTH_CACHE_GB = 3.0
HEALTH_GROWTH_GB = 0.75
GC_COOLDOWN_BATCHES = 10


def reward_profile(samples: DataFrame, keys: Sequence[str], reward: str = "reward") -> DataFrame:
    """Mean, std, min, max, variance (population form) per batch."""
    r = F.col(reward)
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batch_size"), F.avg(r).alias("reward_mean"),
        F.stddev_pop(r).alias("reward_std"), F.min(r).alias("reward_min"), F.max(r).alias("reward_max"),
        F.var_pop(r).alias("reward_var"))


def epoch_summary(samples: DataFrame, run: str, epoch: str, reward: str, loss: str, tokens: str) -> DataFrame:
    """A10: per (run, epoch): avg reward, avg loss, reward variance, samples, API tokens."""
    return samples.groupBy(run, epoch).agg(
        F.avg(reward).alias("avg_reward"), F.avg(loss).alias("avg_loss"),
        F.var_pop(reward).alias("reward_variance"), F.count(F.lit(1)).alias("num_samples"),
        F.sum(tokens).alias("api_tokens"))


def epoch_trends(epochs: DataFrame, run: str, epoch: str, reward: str = "avg_reward",
                 loss: str = "avg_loss") -> DataFrame:
    """Reward trend = current - previous; loss trend = previous - current."""
    was = along(epochs, [run], epoch, lags={"_reward": F.col(reward), "_loss": F.col(loss)})
    return (was.withColumn("reward_trend", F.col(reward) - F.col("_reward"))
            .withColumn("loss_trend", F.col("_loss") - F.col(loss)).drop("_reward", "_loss"))


def batch_numbers(batches: DataFrame, run: str, order: Sequence[str], name: str = "step") -> DataFrame:
    """1-based batch number inside a run (bounded window: batch rows per run)."""
    w = Window.partitionBy(run).orderBy(*order)
    return batches.withColumn(name, F.row_number().over(w))


def baseline_reward(batches: DataFrame, run: str, step: str = "step", reward: str = "reward_mean",
                    n: int = BASELINE_BATCHES) -> DataFrame:
    """Average reward over the first ``n`` batches of each run."""
    return batches.groupBy(run).agg(
        F.avg(F.when(F.col(step) <= n, F.col(reward))).alias("baseline_reward"))


def reward_gains(batches: DataFrame, run: str, step: str = "step", reward: str = "reward_mean",
                 n: int = BASELINE_BATCHES) -> DataFrame:
    """W5 + J7: gain vs previous batch and vs the run's baseline.

    The baseline is a per-run aggregate joined back on ``run`` (J7); both
    sides are at batch grain, Catalyst picks the join strategy from sizes."""
    base = baseline_reward(batches, run, step, reward, n)
    was = along(batches, [run], step, lags={"_was": F.col(reward)})
    return (null_safe_join(was, base, [run])
            .withColumn("gain_vs_prev_batch", F.col(reward) - F.col("_was"))
            .withColumn("gain_from_baseline", F.col(reward) - F.col("baseline_reward")).drop("_was"))


def running_totals(batches: DataFrame, run: str, step: str, cols: Sequence[str]) -> DataFrame:
    """Cumulative sums per run (rows unbounded preceding .. current row)."""
    return along(batches, [run], step, sums={f"cum_{c}": F.col(c) for c in cols})


def best_of_n(samples: DataFrame, batch_keys: Sequence[str], prompt: str, reward: str = "reward") -> DataFrame:
    """Per batch, the mean over prompts of each prompt's best sample reward."""
    best = samples.groupBy(*batch_keys, prompt).agg(F.max(reward).alias("_best"))
    return best.groupBy(*batch_keys).agg(F.avg("_best").alias("best_of_n"),
                                         F.count(F.lit(1)).alias("num_prompts"))


def reward_slope(batches: DataFrame, run: str, epoch: str, x: str, y: str = "reward_mean") -> DataFrame:
    """W17 (decision: least squares): slope of reward over batch index per epoch."""
    return batches.groupBy(run, epoch).agg(F.regr_slope(F.col(y), F.col(x)).alias("reward_slope"),
                                           F.count(F.lit(1)).alias("num_batches"))


def timing_shares(batches: DataFrame, keys: Sequence[str], parts: Sequence[str], total: str) -> DataFrame:
    """Each part's share of total time in percent (NULL on zero total)."""
    aggs = [F.sum(total).alias("_tot")] + [F.sum(p).alias(f"_{p}") for p in parts]
    g = batches.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.try_divide(F.col(f"_{p}"), F.col("_tot")) * 100).alias(f"{p}_pct")
                             for p in parts])


def perf_summary(samples: DataFrame, keys: Sequence[str], tok_s: str, tokens: str,
                 exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Avg and p99 tokens/s, sample count, total tokens.

    ``exact`` selects the interpolated p99 (``ordering.exact_percentile``: a
    sketch brackets the rank, counts inside the bracket decide), so a group
    holding a third of all samples is never sorted or buffered; ``exact=False``
    uses the mergeable ``percentile_approx`` sketch alone (one pass)."""
    base = samples.groupBy(*keys).agg(F.avg(tok_s).alias("avg_tok_s"),
                                      F.count(F.lit(1)).alias("num_samples"),
                                      F.sum(tokens).alias("total_tokens"))
    if not exact:
        p99 = samples.groupBy(*keys).agg(F.percentile_approx(F.col(tok_s), 0.99, accuracy).alias("p99_tok_s"))
    else:
        from .ordering import exact_percentile
        p99 = exact_percentile(samples, keys, tok_s, 0.99, name="p99_tok_s")
    return null_safe_join(base, p99, keys, "left").select(*keys, "avg_tok_s", "p99_tok_s", "num_samples",
                                                     "total_tokens")


def api_usage(samples: DataFrame, epoch: str, sent: Column, received: Column) -> DataFrame:
    """Tokens sent/received per epoch plus the run total in one ROLLUP
    (the total row has ``epoch`` NULL and ``is_total`` true)."""
    return (samples.rollup(epoch)
            .agg(F.sum(sent).alias("tokens_sent"), F.sum(received).alias("tokens_received"),
                 F.count(F.lit(1)).alias("api_calls"), F.grouping(epoch).alias("_g"))
            .withColumn("is_total", F.col("_g") == 1).drop("_g"))


def cache_hit_rate(samples: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    """Calls and hits / lookups per group."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("hits"),
        F.try_divide(F.count_if(hit).cast("double"), F.count(F.lit(1)).cast("double")).alias("cache_hit_rate"))


def diversity(samples: DataFrame, keys: Sequence[str], output: str, exact: bool = True) -> DataFrame:
    """Unique outputs / outputs and duplicates filtered.  Exact distinct
    counts shuffle (key, SHA-256 of the output), never the texts; ``exact=False``
    uses HyperLogLog."""
    uniq = F.count_distinct(F.unhex(F.sha2(output, 256))) if exact else F.approx_count_distinct(output)
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("outputs"), uniq.alias("unique_outputs")) \
        .withColumn("unique_ratio", F.try_divide(F.col("unique_outputs").cast("double"),
                                                 F.col("outputs").cast("double"))) \
        .withColumn("dup_filtered", F.col("outputs") - F.col("unique_outputs"))


SKETCH_BITS = 12               # a distinct sketch has 2 ** SKETCH_BITS registers: standard error 1.04 / 2 ** 6, some 1.6 %
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def diversity_sketches(samples: DataFrame, keys: Sequence[str], output: str) -> DataFrame:
    """A15, to be stored: outputs and a mergeable distinct sketch of their digests per ``keys`` (a run and epoch, say).
    NULL outputs count as outputs and are no value."""
    digest = F.unhex(F.sha2(F.col(output).cast("string"), 256))
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("outputs"), F.hll_sketch_agg(digest, SKETCH_BITS).alias("sketch"))


def diversity_over(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A15 over any span of stored sketches: united to the coarser ``keys`` without reading an output again.
    ``unique_low`` and ``unique_high`` bound the distinct count at three standard errors."""
    g = sketches.groupBy(*keys).agg(F.sum("outputs").alias("outputs"),
                                    F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_estimate"))
    off = F.lit(3 * SKETCH_ERROR)
    return g.select(*keys, "outputs", "unique_estimate", F.floor(F.col("unique_estimate") / (1 + off)).alias("unique_low"),
                    F.ceil(F.col("unique_estimate") / (1 - off)).alias("unique_high"),
                    F.try_divide(F.col("unique_estimate").cast("double"), F.col("outputs").cast("double")).alias("unique_ratio"))


def memory_growth(batches: DataFrame, run: str, step: str, driver_gb: str, current_gb: str) -> DataFrame:
    """W10 fragmentation proxy (driver-allocated - current-allocated) and
    W9 its growth since the previous batch of the run."""
    frag = F.col(driver_gb) - F.col(current_gb)
    was = along(batches.withColumn("fragmentation_gb", frag), [run], step, lags={"_was": F.col("fragmentation_gb")})
    return was.withColumn("growth_gb", F.col("fragmentation_gb") - F.col("_was")).drop("_was")
