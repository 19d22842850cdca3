"""Run-log queries fed from ``events``.

Mapping: a user is a training run (``run_id = user_id``); an event is one
generated sample with ``reward = value / 100`` and ``loss = 1 - reward``;
``tokens`` is ``props.k``; the day (counted from 1970) is the epoch and the hour the
batch.  Event types stand for phases: ``view`` generation, ``click``
scoring, ``purchase`` training; ``error`` rows are duplicates filtered.
Batch metrics (seconds, memory proxies) are sums of ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runlog as RL
from ..operators import sequence as SQ
from ..functions.scoring import throughput_guarded
from ..operators.keys import null_safe_join
from ..session import staged
from .registry import query, r6
from .tables import EPOCH_DAY_SQL, epoch_day, table

SAMPLES_SQL = f"""
samples AS (
  SELECT user_id AS run_id, event_id, ts, event_type, value,
         {EPOCH_DAY_SQL} AS epoch, CAST(hour(ts) AS INTEGER) AS batch_idx,
         value / 100 AS reward, 1 - value / 100 AS loss,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens
  FROM events
)"""

BATCHES_SQL = SAMPLES_SQL + """,
batches0 AS (
  SELECT run_id, epoch, batch_idx, count(*) AS batch_size,
         CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / (count(*) * 100) AS reward_mean,
         coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0) / 10 AS gen_s,
         coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) / 10 AS score_s,
         coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) / 10 AS train_s,
         CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / 10 AS total_s,
         CAST(sum(tokens) AS BIGINT) AS tokens_raw,
         CAST(coalesce(sum(tokens) FILTER (WHERE event_type <> 'error'), 0) AS BIGINT) AS tokens_kept,
         count(*) FILTER (WHERE event_type = 'error') AS dup_filtered,
         1 - CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / (count(*) * 100) AS loss, avg(reward) * 0.1 AS kl,
         sum(value) / 4 AS driver_alloc_gb, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) / 4 AS current_alloc_gb,
         max(value) / 10 AS cache_gb, min(ts) AS ts0
  FROM samples GROUP BY run_id, epoch, batch_idx
),
batches AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY epoch, batch_idx) AS INTEGER) AS step,
         driver_alloc_gb - current_alloc_gb AS fragmentation_gb,
         CASE WHEN gen_s > 0 THEN tokens_raw / gen_s ELSE 0.0 END AS gen_tps,
         CASE WHEN total_s = 0 THEN NULL ELSE gen_s / total_s * 100 END AS gen_share_pct
  FROM batches0
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return e.select(F.col("user_id").alias("run_id"), "event_id", "ts", "event_type", "value",
                    epoch_day().alias("epoch"), F.hour("ts").alias("batch_idx"),
                    (F.col("value") / 100).alias("reward"), (F.lit(1) - F.col("value") / 100).alias("loss"),
                    F.get_json_object("props", "$.k").cast("long").alias("tokens"))


def _dsum(col):
    return F.sum(F.col(col).cast("decimal(12,2)")).cast("double")


def _sum_if(cond, col):
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (run, epoch, batch) with a per-run batch number ``step``."""
    s = samples(spark, sf_dir)
    t = F.col("event_type")
    b = s.groupBy("run_id", "epoch", "batch_idx").agg(
        F.count(F.lit(1)).alias("batch_size"),
        # exact decimal sums: identical doubles whatever the summation order
        (_dsum("value") / (F.count(F.lit(1)) * 100)).alias("reward_mean"),
        (_sum_if(t == "view", "value") / 10).alias("gen_s"),
        (_sum_if(t == "click", "value") / 10).alias("score_s"),
        (_sum_if(t == "purchase", "value") / 10).alias("train_s"),
        (_dsum("value") / 10).alias("total_s"),
        F.sum("tokens").alias("tokens_raw"), _sum_if(t != "error", "tokens").alias("tokens_kept"),
        F.count_if(t == "error").alias("dup_filtered"),
        (F.lit(1) - _dsum("value") / (F.count(F.lit(1)) * 100)).alias("loss"), (F.avg("reward") * 0.1).alias("kl"),
        (F.sum("value") / 4).alias("driver_alloc_gb"), (_sum_if(t == "click", "value") / 4).alias("current_alloc_gb"),
        (F.max("value") / 10).alias("cache_gb"), F.min("ts").alias("ts0"))
    b = RL.batch_numbers(b, "run_id", ["epoch", "batch_idx"])
    return (b.withColumn("fragmentation_gb", F.col("driver_alloc_gb") - F.col("current_alloc_gb"))
            .withColumn("gen_tps", throughput_guarded(F.col("tokens_raw"), F.col("gen_s")))
            .withColumn("gen_share_pct", F.try_divide(F.col("gen_s"), F.col("total_s")) * 100))


@query("reward_profile", sql=f"""WITH {SAMPLES_SQL}
SELECT run_id, epoch, batch_idx, count(*) AS batch_size, round(avg(reward), 6) AS reward_mean,
       round(stddev_pop(reward), 6) AS reward_std, round(min(reward), 6) AS reward_min,
       round(max(reward), 6) AS reward_max, round(var_pop(reward), 6) AS reward_var
FROM samples GROUP BY run_id, epoch, batch_idx""")
def reward_profile(spark, sf_dir):
    p = RL.reward_profile(samples(spark, sf_dir), ["run_id", "epoch", "batch_idx"])
    return p.select("run_id", "epoch", "batch_idx", "batch_size",
                    *[r6(c) for c in ("reward_mean", "reward_std", "reward_min", "reward_max", "reward_var")])


EPOCH_SQL = SAMPLES_SQL + """,
epochs AS (
  SELECT run_id, epoch, avg(reward) AS avg_reward, avg(loss) AS avg_loss, var_pop(reward) AS reward_variance,
         count(*) AS num_samples, CAST(sum(tokens) AS BIGINT) AS api_tokens
  FROM samples GROUP BY run_id, epoch
)"""


def _epochs(spark, sf_dir):
    return RL.epoch_summary(samples(spark, sf_dir), "run_id", "epoch", "reward", "loss", "tokens")


@query("epoch_summary", sql=f"""WITH {EPOCH_SQL}
SELECT run_id, epoch, round(avg_reward, 6) AS avg_reward, round(avg_loss, 6) AS avg_loss,
       round(reward_variance, 6) AS reward_variance, num_samples, api_tokens FROM epochs""")
def epoch_summary(spark, sf_dir):
    e = _epochs(spark, sf_dir)
    return e.select("run_id", "epoch", r6("avg_reward"), r6("avg_loss"), r6("reward_variance"),
                    "num_samples", "api_tokens")


@query("epoch_trend", sql=f"""WITH {EPOCH_SQL}
SELECT run_id, epoch,
       round(avg_reward - lag(avg_reward) OVER (PARTITION BY run_id ORDER BY epoch), 6) AS reward_trend,
       round(lag(avg_loss) OVER (PARTITION BY run_id ORDER BY epoch) - avg_loss, 6) AS loss_trend
FROM epochs""")
def epoch_trend(spark, sf_dir):
    t = RL.epoch_trends(_epochs(spark, sf_dir), "run_id", "epoch")
    return t.select("run_id", "epoch", r6("reward_trend"), r6("loss_trend"))


GAINS_SQL = BATCHES_SQL + """,
base AS (SELECT run_id, avg(reward_mean) FILTER (WHERE step <= 15) AS baseline_reward FROM batches GROUP BY run_id),
gains AS (
  SELECT b.*, base.baseline_reward,
         reward_mean - lag(reward_mean) OVER (PARTITION BY b.run_id ORDER BY step) AS gain_vs_prev_batch,
         reward_mean - base.baseline_reward AS gain_from_baseline
  FROM batches b JOIN base USING (run_id)
)"""


def _gains(spark, sf_dir):
    return RL.reward_gains(batches(spark, sf_dir), "run_id", "step", "reward_mean")


@query("reward_gain", sql=f"""WITH {GAINS_SQL}
SELECT run_id, step, round(reward_mean, 6) AS reward_mean, round(baseline_reward, 6) AS baseline_reward,
       round(gain_vs_prev_batch, 6) AS gain_vs_prev_batch, round(gain_from_baseline, 6) AS gain_from_baseline
FROM gains""")
def reward_gain(spark, sf_dir):
    g = _gains(spark, sf_dir)
    return g.select("run_id", "step", r6("reward_mean"), r6("baseline_reward"), r6("gain_vs_prev_batch"),
                    r6("gain_from_baseline"))


@query("running_tokens", sql=f"""WITH {BATCHES_SQL}
SELECT run_id, step,
       CAST(sum(tokens_raw) OVER w AS BIGINT) AS cum_tokens_raw,
       CAST(sum(tokens_kept) OVER w AS BIGINT) AS cum_tokens_kept,
       CAST(sum(batch_size) OVER w AS BIGINT) AS cum_batch_size
FROM batches WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_tokens(spark, sf_dir):
    r = RL.running_totals(batches(spark, sf_dir), "run_id", "step", ["tokens_raw", "tokens_kept", "batch_size"])
    return r.select("run_id", "step", "cum_tokens_raw", "cum_tokens_kept", "cum_batch_size")


@query("best_of_n", sql=f"""WITH {SAMPLES_SQL},
best AS (SELECT run_id, epoch, batch_idx, event_type, max(reward) AS b FROM samples GROUP BY ALL)
SELECT run_id, epoch, batch_idx, round(avg(b), 6) AS best_of_n, count(*) AS num_prompts
FROM best GROUP BY run_id, epoch, batch_idx""")
def best_of_n(spark, sf_dir):
    b = RL.best_of_n(samples(spark, sf_dir), ["run_id", "epoch", "batch_idx"], "event_type")
    return b.select("run_id", "epoch", "batch_idx", r6("best_of_n"), "num_prompts")


@query("reward_slope", sql=f"""WITH {BATCHES_SQL}
SELECT run_id, epoch,
       round(CASE WHEN var_pop(batch_idx) = 0 THEN NULL ELSE regr_slope(reward_mean, batch_idx) END, 9) AS reward_slope,
       count(*) AS num_batches
FROM batches GROUP BY run_id, epoch""")
def reward_slope(spark, sf_dir):
    s = RL.reward_slope(batches(spark, sf_dir), "run_id", "epoch", "batch_idx")
    return s.select("run_id", "epoch", r6("reward_slope", digits=9), "num_batches")


@query("ema_reward", sql=f"""WITH RECURSIVE {BATCHES_SQL[1:]},
emas(run_id, step, reward_mean, ema) AS (
  SELECT run_id, step, reward_mean, reward_mean FROM batches WHERE step = 1
  UNION ALL
  SELECT b.run_id, b.step, b.reward_mean, 0.8 * e.ema + 0.2 * b.reward_mean
  FROM emas e JOIN batches b ON b.run_id = e.run_id AND b.step = e.step + 1
)
SELECT run_id, step, round(reward_mean, 6) AS reward_mean, round(ema, 6) AS ema FROM emas""")
def ema_reward(spark, sf_dir):
    e = SQ.ema(batches(spark, sf_dir), "run_id", "step", "reward_mean")
    return e.select("run_id", "step", r6("reward_mean"), r6("ema"))


@query("adaptive_kl", sql=f"""WITH {BATCHES_SQL}
SELECT run_id, step, round(kl, 6) AS kl,
       round(0.1 * exp(0.1 * sum(kl - 0.075) OVER (PARTITION BY run_id ORDER BY step
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS kl_coef
FROM batches""")
def adaptive_kl(spark, sf_dir):
    k = SQ.adaptive_kl(batches(spark, sf_dir), "run_id", "step", "kl")
    return k.select("run_id", "step", r6("kl"), r6("kl_coef"))


@query("health_check", sql=f"""WITH {GAINS_SQL},
h AS (
  SELECT run_id, step, gen_share_pct, gen_tps, fragmentation_gb, cache_gb, gain_from_baseline,
         fragmentation_gb - lag(fragmentation_gb) OVER (PARTITION BY run_id ORDER BY step) AS growth
  FROM gains
)
SELECT run_id, step,
       CASE WHEN len(iss) = 0 THEN 'OK' ELSE 'WARN' END AS status, array_to_string(iss, ',') AS issues
FROM (
  SELECT run_id, step, list_filter([
      CASE WHEN gen_share_pct > 85.0 THEN 'gen_bottleneck' END,
      CASE WHEN gen_tps < 6.0 THEN 'low_gen_tps' END,
      CASE WHEN fragmentation_gb > 10.0 THEN 'fragmentation' END,
      CASE WHEN cache_gb > 3.0 THEN 'cache_size' END,
      CASE WHEN growth > 0.75 THEN 'fragmentation_growth' END,
      CASE WHEN gain_from_baseline <= 0 THEN 'no_gain_vs_baseline' END], lambda x: x IS NOT NULL) AS iss
  FROM h WHERE step > 3 AND step % 5 = 0)""")
def health_check(spark, sf_dir):
    h = SQ.health_check(_gains(spark, sf_dir), "run_id", "step", "gen_share_pct", "gen_tps",
                        "fragmentation_gb", "cache_gb", "gain_from_baseline")
    return h.select("run_id", "step", "status", F.array_join("issues", ",").alias("issues"))


@query("gc_cooldown", sql=f"""WITH RECURSIVE {BATCHES_SQL[1:]},
b AS (SELECT run_id, step, fragmentation_gb > 10.0 AS wants FROM batches),
r AS (
  SELECT run_id, step, wants, wants AS triggered, CASE WHEN wants THEN step END AS last FROM b WHERE step = 1
  UNION ALL
  SELECT b.run_id, b.step, b.wants,
         b.wants AND (r.last IS NULL OR b.step - r.last >= 10),
         CASE WHEN b.wants AND (r.last IS NULL OR b.step - r.last >= 10) THEN b.step ELSE r.last END
  FROM r JOIN b ON b.run_id = r.run_id AND b.step = r.step + 1
)
SELECT run_id, step, wants AS wants_gc, triggered FROM r""")
def gc_cooldown(spark, sf_dir):
    g = SQ.gc_cooldown(batches(spark, sf_dir), "run_id", "step", "fragmentation_gb")
    return g.select("run_id", "step", "wants_gc", "triggered")


@query("score_cache_ttl", sql="""WITH RECURSIVE
e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, event_type, event_id, rn, t AS stamp, false AS hit FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_type, e.event_id, e.rn,
         CASE WHEN e.t - r.stamp < 14400000000 THEN r.stamp ELSE e.t END,
         e.t - r.stamp < 14400000000
  FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.rn = r.rn + 1
)
SELECT user_id, event_type, event_id, hit AS cache_hit FROM r""")
def score_cache_ttl(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    c = SQ.cache_ttl(e, ["user_id", "event_type"], "ts", "event_id")
    return c.select("user_id", "event_type", "event_id", "cache_hit")


LOAD_SQL = """
ls AS (
  SELECT user_id AS run_id, epoch_us(ts) / 1000000.0 AS elapsed, value / 10 AS process_gb,
         CAST(json_extract_string(props, '$.k') AS BIGINT) / 10 AS system_gb,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events
),
ph AS (
  SELECT run_id, CAST(least(3, (rn - 1) // (n // 4)) AS INTEGER) AS phase, count(*) AS num_samples,
         arg_max(elapsed, rn) - arg_min(elapsed, rn) AS duration,
         arg_min(process_gb, rn) AS process_start, arg_max(process_gb, rn) AS process_end,
         max(process_gb) AS process_peak, arg_max(process_gb, rn) - arg_min(process_gb, rn) AS process_delta,
         arg_min(system_gb, rn) AS system_start, arg_max(system_gb, rn) AS system_end,
         max(system_gb) AS system_peak, arg_max(system_gb, rn) - arg_min(system_gb, rn) AS system_delta
  FROM ls WHERE n >= 5 GROUP BY run_id, phase
)"""

_PH_COLS = ["duration", "process_start", "process_end", "process_peak", "process_delta",
            "system_start", "system_end", "system_peak", "system_delta"]


def _phases(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "props")
    s = e.select(F.col("user_id").alias("run_id"), "ts", "event_id", SQ.unix_seconds(F.col("ts")).alias("elapsed"),
                 (F.col("value") / 10).alias("process_gb"),
                 (F.get_json_object("props", "$.k").cast("long") / 10).alias("system_gb"))
    return SQ.load_phases(s, "run_id", ["ts", "event_id"], "elapsed", "process_gb", "system_gb")


@query("load_phases", sql=f"""WITH {LOAD_SQL}
SELECT run_id, phase, num_samples, {", ".join(f"round({c}, 6) AS {c}" for c in _PH_COLS)} FROM ph""")
def load_phases(spark, sf_dir):
    p = _phases(spark, sf_dir)
    return p.select("run_id", "phase", "num_samples", *[r6(c) for c in _PH_COLS])


@query("slow_last_phase", sql=f"""WITH {LOAD_SQL},
g AS (SELECT run_id, avg(duration) FILTER (WHERE phase < 3) AS a, max(duration) FILTER (WHERE phase = 3) AS l
      FROM ph GROUP BY run_id)
SELECT run_id, round(a, 6) AS avg_first_three, round(l, 6) AS last_phase, l > 1.2 * a AS slow_last,
       round(CASE WHEN a = 0 THEN NULL ELSE l / a END, 6) AS ratio FROM g""")
def slow_last_phase(spark, sf_dir):
    s = SQ.slow_last_phase(_phases(spark, sf_dir), "run_id")
    return s.select("run_id", r6("avg_first_three"), r6("last_phase"), "slow_last", r6("ratio"))


@query("timing_shares", sql=f"""WITH {BATCHES_SQL}
SELECT run_id,
       round(CASE WHEN sum(total_s) = 0 THEN NULL ELSE sum(gen_s) / sum(total_s) END * 100, 6) AS gen_s_pct,
       round(CASE WHEN sum(total_s) = 0 THEN NULL ELSE sum(score_s) / sum(total_s) END * 100, 6) AS score_s_pct,
       round(CASE WHEN sum(total_s) = 0 THEN NULL ELSE sum(train_s) / sum(total_s) END * 100, 6) AS train_s_pct
FROM batches GROUP BY run_id""")
def timing_shares(spark, sf_dir):
    t = RL.timing_shares(batches(spark, sf_dir), ["run_id"], ["gen_s", "score_s", "train_s"], "total_s")
    return t.select("run_id", r6("gen_s_pct"), r6("score_s_pct"), r6("train_s_pct"))


@query("api_usage", sql=f"""WITH {SAMPLES_SQL}
SELECT epoch, CAST(sum(tokens) AS BIGINT) AS tokens_sent,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN tokens END) AS BIGINT) AS tokens_received,
       count(*) AS api_calls, grouping(epoch) = 1 AS is_total
FROM samples GROUP BY ROLLUP (epoch)""")
def api_usage(spark, sf_dir):
    s = samples(spark, sf_dir)
    return RL.api_usage(s, "epoch", F.col("tokens"), F.when(F.col("event_type") == "purchase", F.col("tokens")))


@query("cache_hit_rate", sql=f"""WITH {SAMPLES_SQL}
SELECT epoch, count(*) AS calls, count(*) FILTER (WHERE event_type = 'view') AS hits,
       round(count(*) FILTER (WHERE event_type = 'view') / count(*), 6) AS cache_hit_rate
FROM samples GROUP BY epoch""")
def cache_hit_rate(spark, sf_dir):
    c = RL.cache_hit_rate(samples(spark, sf_dir), ["epoch"], F.col("event_type") == "view")
    return c.select("epoch", "calls", "hits", r6("cache_hit_rate"))


@query("diversity_sketch", sql="""
SELECT event_type AS run_id, count(*) AS outputs, count(DISTINCT value) AS unique_outputs, TRUE AS within
FROM events GROUP BY event_type""")
def diversity_sketch(spark, sf_dir):
    """A15 over any span: distinct sketches stored a (run, epoch) and united to the run, beside the exact count, which
    three standard errors of the sketch must hold."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("ts").cast("date").alias("epoch"), "value")
    stored = staged(RL.diversity_sketches(e, ["run_id", "epoch"], "value"), "diversity-sketches")
    exact = e.groupBy("run_id").agg(F.count_distinct("value").alias("unique_outputs"))
    both = null_safe_join(RL.diversity_over(stored, ["run_id"]), exact, ["run_id"])
    return both.select("run_id", "outputs", "unique_outputs",
                       F.col("unique_outputs").between(F.col("unique_low"), F.col("unique_high")).alias("within"))


@query("diversity", sql="""
SELECT source, count(*) AS outputs, count(DISTINCT text) AS unique_outputs,
       round(count(DISTINCT text) / count(*), 6) AS unique_ratio, count(*) - count(DISTINCT text) AS dup_filtered
FROM documents GROUP BY source""")
def diversity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "text")
    r = RL.diversity(d, ["source"], "text")
    return r.select("source", "outputs", "unique_outputs", r6("unique_ratio"), "dup_filtered")


@query("memory_growth", sql=f"""WITH {BATCHES_SQL}
SELECT run_id, step, round(driver_alloc_gb - current_alloc_gb, 6) AS fragmentation_gb,
       round((driver_alloc_gb - current_alloc_gb)
             - lag(driver_alloc_gb - current_alloc_gb) OVER (PARTITION BY run_id ORDER BY step), 6) AS growth_gb
FROM batches""")
def memory_growth(spark, sf_dir):
    """W9 + W10: fragmentation proxy per batch and its growth."""
    b = batches(spark, sf_dir).drop("fragmentation_gb")
    g = RL.memory_growth(b, "run_id", "step", "driver_alloc_gb", "current_alloc_gb")
    return g.select("run_id", "step", r6("fragmentation_gb"), r6("growth_gb"))


@query("training_throughput", sql=f"""WITH {SAMPLES_SQL},
t AS (SELECT run_id, tokens, CASE WHEN value > 0 THEN tokens / (value / 10) ELSE 0.0 END AS tps
      FROM samples WHERE event_type = 'purchase')
SELECT run_id, round(avg(tps), 6) AS avg_tok_s, round(quantile_cont(tps, 0.99), 6) AS p99_tok_s,
       count(*) AS num_samples, CAST(sum(tokens) AS BIGINT) AS total_tokens
FROM t GROUP BY run_id""")
def training_throughput(spark, sf_dir):
    """Training performance per run (training = purchase events; tokens
    consumed over value/10 seconds), avg and p99 tokens/s."""
    s = samples(spark, sf_dir).where(F.col("event_type") == "purchase")
    s = s.withColumn("tps", throughput_guarded(F.col("tokens"), F.col("value") / 10))
    p = RL.perf_summary(s, ["run_id"], "tps", "tokens")
    return p.select("run_id", r6("avg_tok_s"), r6("p99_tok_s"), "num_samples", "total_tokens")
