"""Batch-log views over the nested log built from ``events`` batches.

The nested batch record (the reference's JSON summary line) is assembled
from the run-log batch aggregates; the views then project, flatten, tail
and render it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.format import render_numbers_exact
from ..functions.scoring import throughput_guarded
from ..operators import sequence as SQ
from ..operators.corpus import tail
from ..operators.logs import BATCH_COLUMNS, EPOCH_COLUMNS, flatten, project_log
from .registry import query, r6
from .tables import EPOCH_DAY_SQL
from .runlog import GAINS_SQL, _gains

NESTED_SQL = "RECURSIVE " + GAINS_SQL[1:] + """,
emas(run_id, step, ema) AS (
  SELECT run_id, step, reward_mean FROM batches WHERE step = 1
  UNION ALL
  SELECT b.run_id, b.step, 0.8 * e.ema + 0.2 * b.reward_mean
  FROM emas e JOIN batches b ON b.run_id = e.run_id AND b.step = e.step + 1
),
flat AS (
  SELECT g.run_id, strftime(g.ts0, '%Y-%m-%dT%H:%M:%S') AS "ts_iso", g.epoch AS "epoch", g.batch_idx AS "batch_idx",
         g.step AS "global_step", g.batch_size AS "batch_size", 'mlx' AS "generation_backend",
         g.gen_s AS "timing_s.generation", g.score_s AS "timing_s.scoring", g.train_s AS "timing_s.training",
         g.total_s AS "timing_s.total", g.tokens_raw AS "tokens.gen_raw", g.tokens_kept AS "tokens.gen_kept",
         CASE WHEN g.total_s > 0 THEN g.tokens_raw / g.total_s ELSE 0.0 END AS "throughput_tok_s.gen_raw_overall",
         CASE WHEN g.total_s > 0 THEN g.tokens_kept / g.total_s ELSE 0.0 END AS "throughput_tok_s.gen_kept_overall",
         CASE WHEN g.train_s > 0 THEN g.tokens_kept / g.train_s ELSE 0.0 END AS "throughput_tok_s.training",
         g.dup_filtered AS "samples.dup_filtered", 1 - g.dup_filtered / g.batch_size AS "samples.diversity_ratio",
         g.reward_mean AS "rewards.mean", g.gain_from_baseline AS "reward_gain.gain_from_baseline",
         g.gain_vs_prev_batch AS "reward_gain.gain_vs_prev_batch", e.ema AS "reward_gain.ema_reward",
         e.ema - g.baseline_reward AS "reward_gain.ema_gain_from_baseline", g.loss AS "loss.loss"
  FROM gains g JOIN emas e USING (run_id, step)
)"""

_DOUBLE_PATHS = [c for c in BATCH_COLUMNS if c.split(".")[0] in
                 ("timing_s", "throughput_tok_s", "rewards", "reward_gain", "loss") or c == "samples.diversity_ratio"]


def nested_batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = SQ.ema(_gains(spark, sf_dir), "run_id", "step", "reward_mean")
    tg = throughput_guarded
    return j.select(
        "run_id", F.date_format("ts0", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_iso"), "epoch", "batch_idx",
        F.col("step").alias("global_step"), "batch_size", F.lit("mlx").alias("generation_backend"),
        F.struct(F.col("gen_s").alias("generation"), F.col("score_s").alias("scoring"),
                 F.col("train_s").alias("training"), F.col("total_s").alias("total")).alias("timing_s"),
        F.struct(F.col("tokens_raw").alias("gen_raw"), F.col("tokens_kept").alias("gen_kept")).alias("tokens"),
        F.struct(tg(F.col("tokens_raw"), F.col("total_s")).alias("gen_raw_overall"),
                 tg(F.col("tokens_kept"), F.col("total_s")).alias("gen_kept_overall"),
                 tg(F.col("tokens_kept"), F.col("train_s")).alias("training")).alias("throughput_tok_s"),
        F.struct(F.col("dup_filtered").alias("dup_filtered"),
                 (F.lit(1) - F.col("dup_filtered") / F.col("batch_size")).alias("diversity_ratio")).alias("samples"),
        F.struct(F.col("reward_mean").alias("mean")).alias("rewards"),
        F.struct(F.col("gain_from_baseline").alias("gain_from_baseline"),
                 F.col("gain_vs_prev_batch").alias("gain_vs_prev_batch"), F.col("ema").alias("ema_reward"),
                 (F.col("ema") - F.col("baseline_reward")).alias("ema_gain_from_baseline")).alias("reward_gain"),
        F.struct(F.col("loss").alias("loss")).alias("loss"))


def _sql_cols(paths, rounding=True):
    out = []
    for c in paths:
        if rounding and c in _DOUBLE_PATHS:
            out.append(f'round("{c}", 6) AS "{c}"')
        else:
            out.append(f'"{c}"')
    return ", ".join(out)


@query("flatten_log", sql=f"""WITH {NESTED_SQL}
SELECT run_id, {_sql_cols(BATCH_COLUMNS)} FROM flat""")
def flatten_log(spark, sf_dir):
    v = project_log(flatten(nested_batch_log(spark, sf_dir)), BATCH_COLUMNS, keep=["run_id"])
    return v.select("run_id", *[r6(F.col(f"`{c}`"), c) if c in _DOUBLE_PATHS else F.col(f"`{c}`")
                                for c in BATCH_COLUMNS])


_TAIL = ["ts_iso", "global_step", "rewards.mean", "loss.loss"]


@query("log_tail", sql=f"""WITH {NESTED_SQL}
SELECT run_id, {_sql_cols(_TAIL)} FROM flat ORDER BY "ts_iso" DESC, run_id DESC LIMIT 20""")
def log_tail(spark, sf_dir):
    """The last 20 batch rows of the whole log by time (ties by run)."""
    f = project_log(flatten(nested_batch_log(spark, sf_dir)), _TAIL, keep=["run_id"])
    f = f.withColumn("_ord", F.struct("ts_iso", "run_id"))
    t = tail(f, 20, "_ord").drop("_ord")
    return t.select("run_id", *[r6(F.col(f"`{c}`"), c) if c in _DOUBLE_PATHS else F.col(f"`{c}`") for c in _TAIL])


_RENDER = ["timing_s.total", "throughput_tok_s.gen_raw_overall", "rewards.mean", "reward_gain.ema_reward",
           "loss.loss"]


@query("render_numbers", sql=f"""WITH {NESTED_SQL}
SELECT run_id, "global_step", {", ".join(f'printf(\'%.4g\', round("{c}", 12)) AS "{c}"' for c in _RENDER)} FROM flat""")
def render_numbers(spark, sf_dir):
    """P10: float cells rendered as ``%.4g`` text (of 12 places: the last bits of an average depend on the order of adding)."""
    f = project_log(flatten(nested_batch_log(spark, sf_dir)), ["global_step", *_RENDER], keep=["run_id"])
    texts = f.select("run_id", "global_step", render_numbers_exact([F.round(F.col(f"`{c}`"), 12) for c in _RENDER]).alias("_t"))
    return texts.select("run_id", "global_step", *[F.get("_t", F.lit(i)).alias(c) for i, c in enumerate(_RENDER)])


EPOCH_NESTED_SQL = f"""
ep0 AS (
  SELECT user_id AS run_id, {EPOCH_DAY_SQL} AS epoch, min(ts) AS t0,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS epoch_time_s,
         CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / (count(*) * 100) AS avg_reward,
         1 - CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / (count(*) * 100) AS avg_loss, count(*) AS calls,
         count(*) FILTER (WHERE event_type = 'view') / count(*) AS cache_hit_rate,
         count(DISTINCT event_type) / count(*) AS unique_ratio,
         sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS tok,
         coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (WHERE event_type <> 'error'), 0) AS tok_kept
  FROM events GROUP BY 1, 2
),
eflat AS (
  SELECT run_id, strftime(t0, '%Y-%m-%dT%H:%M:%S') AS "ts_iso", epoch AS "epoch", 'mlx' AS "generation_backend",
         epoch_time_s AS "epoch_time_s", avg_reward AS "avg_reward", avg_loss AS "avg_loss",
         avg_reward - lag(avg_reward) OVER (PARTITION BY run_id ORDER BY epoch) AS "reward_trend",
         lag(avg_loss) OVER (PARTITION BY run_id ORDER BY epoch) - avg_loss AS "loss_trend",
         calls AS "api.calls", cache_hit_rate AS "api.cache_hit_rate", unique_ratio AS "diversity.unique_ratio",
         CASE WHEN epoch_time_s > 0 THEN tok / epoch_time_s ELSE 0.0 END AS "performance.generation.tok_s_raw",
         CASE WHEN epoch_time_s > 0 THEN tok_kept / epoch_time_s ELSE 0.0 END AS "performance.generation.tok_s_kept",
         CASE WHEN epoch_time_s > 0 THEN tok_kept / epoch_time_s ELSE 0.0 END AS "performance.training.tok_s"
  FROM ep0
)"""

_EPOCH_DOUBLES = [c for c in EPOCH_COLUMNS if c not in ("ts_iso", "epoch", "generation_backend", "api.calls")]


def nested_epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 epoch record: A10 + W6 trends + API calls and hit rate (A14),
    diversity (A15) and token rates per epoch."""
    from ..operators.runlog import epoch_trends
    from .runlog import samples as run_samples
    s = run_samples(spark, sf_dir)
    t_us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = s.groupBy("run_id", "epoch").agg(
        F.min("ts").alias("t0"), ((F.max(t_us) - F.min(t_us)) / 1e6).alias("epoch_time_s"),
        # exact decimal sums: identical doubles whatever the summation order
        (F.sum(F.col("value").cast("decimal(12,2)")).cast("double") / (F.count(F.lit(1)) * 100)).alias("avg_reward"),
        (F.lit(1) - F.sum(F.col("value").cast("decimal(12,2)")).cast("double") / (F.count(F.lit(1)) * 100))
        .alias("avg_loss"),
        F.count(F.lit(1)).alias("calls"),
        (F.count_if(F.col("event_type") == "view") / F.count(F.lit(1))).alias("cache_hit_rate"),
        (F.count_distinct("event_type") / F.count(F.lit(1))).alias("unique_ratio"),
        F.sum("tokens").alias("tok"),
        F.coalesce(F.sum(F.when(F.col("event_type") != "error", F.col("tokens"))), F.lit(0)).alias("tok_kept"))
    g = epoch_trends(g, "run_id", "epoch")
    tg = throughput_guarded
    return g.select(
        "run_id", F.date_format("t0", "yyyy-MM-dd'T'HH:mm:ss").alias("ts_iso"), "epoch",
        F.lit("mlx").alias("generation_backend"), "epoch_time_s", "avg_reward", "avg_loss", "reward_trend",
        "loss_trend", F.struct(F.col("calls").alias("calls"), F.col("cache_hit_rate").alias("cache_hit_rate")).alias("api"),
        F.struct(F.col("unique_ratio").alias("unique_ratio")).alias("diversity"),
        F.struct(F.struct(tg(F.col("tok"), F.col("epoch_time_s")).alias("tok_s_raw"),
                          tg(F.col("tok_kept"), F.col("epoch_time_s")).alias("tok_s_kept")).alias("generation"),
                 F.struct(tg(F.col("tok_kept"), F.col("epoch_time_s")).alias("tok_s")).alias("training"))
        .alias("performance"))


@query("epoch_log_view", sql=f"""WITH {EPOCH_NESTED_SQL}
SELECT run_id, {", ".join(f'round("{c}", 6) AS "{c}"' if c in _EPOCH_DOUBLES else f'"{c}"' for c in EPOCH_COLUMNS)}
FROM eflat""")
def epoch_log_view(spark, sf_dir):
    """P8 (epoch grain): the 14 epoch columns of the nested epoch record."""
    v = project_log(nested_epoch_log(spark, sf_dir), EPOCH_COLUMNS, keep=["run_id"])
    return v.select("run_id", *[r6(F.col(f"`{c}`"), c) if c in _EPOCH_DOUBLES else F.col(f"`{c}`")
                                for c in EPOCH_COLUMNS])
