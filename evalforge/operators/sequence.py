"""Order-dependent run analytics: EMA, adaptive KL, health checks,
clean-up cooldown, score-cache expiry and load-phase profiles.

* Closed forms where the recurrence allows one (W11: the KL coefficient is
  ``c0 * exp(gain * running sum)``).
* Scaled running sums in chunks for W4 (``recurrence``).
* Greedy anchors for W14 and W16 by time buckets and pointer doubling
  (``anchors``).
One path each, whatever the size of a run or key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import expiry_anchors
from .keys import null_safe_join
from .ordering import along
from .recurrence import scan_ema
from .runlog import (EMA_ALPHA, GC_COOLDOWN_BATCHES, HEALTH_CACHE_GB, HEALTH_FRAGMENTATION_GB,
                     HEALTH_GEN_BOTTLENECK_PCT, HEALTH_GEN_TARGET_TPS, HEALTH_GRACE_BATCHES,
                     HEALTH_GROWTH_GB, HEALTH_INTERVAL_BATCHES, KL_GAIN, KL_START, KL_TARGET)

CACHE_TTL_SECONDS = 14400      # teacher score cache expiry (fixed value)
SLOW_LAST_PHASE_FACTOR = 1.2   # last phase slower than 1.2 x mean of the first three
MIN_LOAD_SAMPLES = 5           # the profile runs only for more than 4 samples


def ema(batches: DataFrame, run: str, step: str, x: str, alpha: float = EMA_ALPHA,
        name: str = "ema") -> DataFrame:
    """``ema = alpha * prev + (1 - alpha) * x`` seeded with the first value, as running sums of scaled
    values in chunks (``recurrence.scan_ema``) for runs of any length; all columns stay."""
    return scan_ema(batches, run, step, x, alpha, name)


def adaptive_kl(batches: DataFrame, run: str, step: str, observed: str, c0: float = KL_START,
                target: float = KL_TARGET, gain: float = KL_GAIN, name: str = "kl_coef") -> DataFrame:
    """``c <- c * exp(gain * (observed - target))`` after each batch,
    i.e. ``c0 * exp(gain * running_sum(observed - target))``."""
    run_sum = along(batches, [run], step, sums={"_sum": F.col(observed) - F.lit(float(target))})
    return run_sum.withColumn(name, F.lit(float(c0)) * F.exp(F.lit(float(gain)) * F.col("_sum"))).drop("_sum")


def health_check(batches: DataFrame, run: str, step: str, gen_share_pct: str, gen_tps: str,
                 fragmentation_gb: str, cache_gb: str, gain_from_baseline: str,
                 grace: int = HEALTH_GRACE_BATCHES, interval: int = HEALTH_INTERVAL_BATCHES,
                 gen_pct: float = HEALTH_GEN_BOTTLENECK_PCT, gen_target_tps: float = HEALTH_GEN_TARGET_TPS,
                 frag_gb: float = HEALTH_FRAGMENTATION_GB, cache_limit_gb: float = HEALTH_CACHE_GB,
                 growth_gb: float = HEALTH_GROWTH_GB) -> DataFrame:
    """W13 (+ W9 growth since previous batch): evaluated after the grace
    period every ``interval`` batches; ``OK`` or ``WARN`` with the issues."""
    was = along(batches, [run], step, lags={"_was": F.col(fragmentation_gb)})
    b = was.withColumn("fragmentation_growth_gb", F.col(fragmentation_gb) - F.col("_was")).drop("_was")
    issues = F.array_compact(F.array(
        F.when(F.col(gen_share_pct) > gen_pct, F.lit("gen_bottleneck")),
        F.when(F.col(gen_tps) < gen_target_tps, F.lit("low_gen_tps")),
        F.when(F.col(fragmentation_gb) > frag_gb, F.lit("fragmentation")),
        F.when(F.col(cache_gb) > cache_limit_gb, F.lit("cache_size")),
        F.when(F.col("fragmentation_growth_gb") > growth_gb, F.lit("fragmentation_growth")),
        F.when(F.col(gain_from_baseline) <= 0, F.lit("no_gain_vs_baseline"))))
    due = (F.col(step) > grace) & (F.col(step) % interval == 0)
    return (b.where(due)
            .withColumn("issues", issues)
            .withColumn("status", F.when(F.size("issues") == 0, F.lit("OK")).otherwise(F.lit("WARN"))))


def gc_cooldown(batches: DataFrame, run: str, step: str, fragmentation_gb: str,
                threshold: float = HEALTH_FRAGMENTATION_GB, cooldown: int = GC_COOLDOWN_BATCHES) -> DataFrame:
    """Trigger a clean-up when fragmentation exceeds the threshold, at
    most once per ``cooldown`` batches since the last trigger.

    The triggers are the greedy anchors of the batches that want a clean-up,
    with the cooldown as the expiry (``anchors.expiry_anchors``): no run is
    gathered.  An unknown fragmentation wants none; a NULL run is a run."""
    wants = F.coalesce(F.col(fragmentation_gb) > F.lit(float(threshold)), F.lit(False))
    b = batches.select(run, step, wants.alias("wants_gc"))
    wanting = b.where("wants_gc").select(run, F.col(step).cast("bigint").alias("_s"))
    fired = expiry_anchors(wanting, [run], "_s", "_s", int(cooldown)).withColumn("_fired", F.lit(True))
    out = null_safe_join(b.withColumn("_s", F.col(step).cast("bigint")), fired, [run, "_s"], "left")
    return out.select(run, step, "wants_gc", F.col("_fired").isNotNull().alias("triggered"))


def cache_ttl(events: DataFrame, keys: Sequence[str], ts: str, tie: str,
              ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """W16 (decision: hits do not refresh the stamp; age == TTL is a miss).

    The misses are found with TTL-wide time buckets and pointer doubling
    (``anchors.expiry_anchors``): no key's rows are gathered in one task, so a
    key holding a third of all events is spread like any other.  An event
    without a time is a miss that stamps nothing.  Output: the input keys
    (NULL keys are keys), ``tie`` (unique per key) and ``cache_hit``."""
    ttl_us = int(ttl_seconds) * 1_000_000
    e = events.select(*keys, F.col(tie).cast("bigint").alias("_id"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    misses = expiry_anchors(e.where(F.col("_t").isNotNull()), keys, "_t", "_id", ttl_us).withColumn("_miss", F.lit(True))
    out = null_safe_join(e, misses, [*keys, "_id"], "left")
    return out.select(*keys, F.col("_id").cast(events.schema[tie].dataType).alias(tie),
                      (F.col("_miss").isNull() & F.col("_t").isNotNull()).alias("cache_hit"))


def cache_stamps(events: DataFrame, keys: Sequence[str], ts: str, tie: str,
                 ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """State of the score cache after ``events``: keys and ``stamp``, the time of the key's last miss in microseconds.
    The live form of W16 starts from it."""
    hits = cache_ttl(events, keys, ts, tie, ttl_seconds).where(~F.col("cache_hit"))
    timed = events.select(*keys, F.col(tie), F.unix_micros(F.col(ts).cast("timestamp")).alias("stamp"))
    return (null_safe_join(hits, timed, [*keys, tie]).where(F.col("stamp").isNotNull())
            .groupBy(*keys).agg(F.max("stamp").alias("stamp")))


def ddl(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def load_phases(samples: DataFrame, run: str, order: Sequence[str], elapsed: str, process_gb: str,
                system_gb: str, min_samples: int = MIN_LOAD_SAMPLES) -> DataFrame:
    """W8 + A18: four phases of each run's samples (``n // 4`` samples in
    phases 0-2, the remainder in the last, not ``ntile``), then per phase:
    duration, start -> end, peak and delta of both memory series.  Runs with
    fewer than ``min_samples`` samples are skipped."""
    from .ordering import group_rank
    # rank inside each run without a per-run window: a run holding a third of
    # all samples is still sorted by many range partitions
    ranked = group_rank(samples, [run], [F.col(c).asc() for c in order], name="_rn") \
        .withColumnRenamed("_rn_count", "_n").where(F.col("_n") >= min_samples)
    q = F.floor(F.col("_n") / 4)
    phased = ranked.withColumn("phase", F.least(F.lit(3), F.floor((F.col("_rn") - 1) / q)).cast("int"))
    rn = F.col("_rn")
    return phased.groupBy(run, "phase").agg(
        F.count(F.lit(1)).alias("num_samples"),
        (F.max_by(elapsed, rn) - F.min_by(elapsed, rn)).alias("duration"),
        F.min_by(process_gb, rn).alias("process_start"), F.max_by(process_gb, rn).alias("process_end"),
        F.max(process_gb).alias("process_peak"),
        (F.max_by(process_gb, rn) - F.min_by(process_gb, rn)).alias("process_delta"),
        F.min_by(system_gb, rn).alias("system_start"), F.max_by(system_gb, rn).alias("system_end"),
        F.max(system_gb).alias("system_peak"),
        (F.max_by(system_gb, rn) - F.min_by(system_gb, rn)).alias("system_delta"))


def slow_last_phase(phases: DataFrame, run: str, factor: float = SLOW_LAST_PHASE_FACTOR) -> DataFrame:
    """Last phase slower than ``factor`` x the mean of the first three."""
    g = phases.groupBy(run).agg(
        F.avg(F.when(F.col("phase") < 3, F.col("duration"))).alias("avg_first_three"),
        F.max(F.when(F.col("phase") == 3, F.col("duration"))).alias("last_phase"))
    return g.select(run, "avg_first_three", "last_phase",
                    (F.col("last_phase") > F.lit(float(factor)) * F.col("avg_first_three")).alias("slow_last"),
                    F.try_divide(F.col("last_phase"), F.col("avg_first_three")).alias("ratio"))


def unix_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)
