"""Checkpoint queries (3.2 in the survey) fed from ``orders``.

Customers are grouped into 20 checkpoints (``o_custkey % 20``); each group's
name follows one of the documented naming forms (bare step, epoch/batch/
step, step first, ``end``, ``final``) plus one non-checkpoint folder; its
metric is the group's mean order price / 1e6 (group 7 has none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import heuristic_score
from ..operators.checkpoints import (best_checkpoint, expand_checkpoints, is_checkpoint, parse_checkpoint_name,
                                     retain_latest)
from ..session import scratch_path
from .registry import query, r6
from .tables import table

NAMED_SQL = """
ck AS (SELECT o_custkey % 20 AS g, avg(o_totalprice) / 1000000 AS m, count(*) AS n FROM orders GROUP BY 1),
named AS (
  SELECT g, n, CASE WHEN g = 7 THEN NULL ELSE m END AS avg_fine_tuned_reward_normalized,
    CASE g % 5
      WHEN 0 THEN 'checkpoint-' || CAST(g * 500 AS VARCHAR)
      WHEN 1 THEN 'checkpoint-e' || CAST(g AS VARCHAR) || '-b' || CAST(g * 3 AS VARCHAR) || '-gs' || CAST(g * 100 AS VARCHAR)
      WHEN 2 THEN 'checkpoint-gs' || CAST(g * 100 AS VARCHAR) || '-e' || CAST(g AS VARCHAR) || '-b1'
      WHEN 3 THEN 'checkpoint-e' || CAST(g AS VARCHAR) || '-end-gs' || CAST(g * 100 AS VARCHAR)
      ELSE CASE WHEN g = 9 THEN 'ckpt-tmp-9' ELSE 'checkpoint-final-gs' || CAST(g * 100 AS VARCHAR) END
    END AS checkpoint
  FROM ck
),
ckpts AS (
  SELECT *, try_cast(nullif(regexp_extract(checkpoint, '(^|-)e([0-9]+)(-|$)', 2), '') AS BIGINT) AS epoch,
         try_cast(nullif(regexp_extract(checkpoint, '(^|-)b([0-9]+)(-|$)', 2), '') AS BIGINT) AS batch,
         coalesce(try_cast(nullif(regexp_extract(checkpoint, '(^|-)gs([0-9]+)(-|$)', 2), '') AS BIGINT),
                  try_cast(nullif(regexp_extract(checkpoint, '(-)([0-9]+)$', 2), '') AS BIGINT)) AS step,
         regexp_matches(checkpoint, '(^|-)end(-|$)') AS is_end,
         regexp_matches(checkpoint, '(^|-)final(-|$)') AS is_final,
         starts_with(checkpoint, 'checkpoint-') AS is_checkpoint
  FROM named
)"""


def named_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    g = o.groupBy((F.col("o_custkey") % 20).alias("g")).agg(
        (F.avg("o_totalprice") / 1000000).alias("m"), F.count(F.lit(1)).alias("n"))
    s = lambda c: c.cast("string")
    gc = F.col("g")
    name = (F.when(gc % 5 == 0, F.concat(F.lit("checkpoint-"), s(gc * 500)))
            .when(gc % 5 == 1, F.concat(F.lit("checkpoint-e"), s(gc), F.lit("-b"), s(gc * 3), F.lit("-gs"), s(gc * 100)))
            .when(gc % 5 == 2, F.concat(F.lit("checkpoint-gs"), s(gc * 100), F.lit("-e"), s(gc), F.lit("-b1")))
            .when(gc % 5 == 3, F.concat(F.lit("checkpoint-e"), s(gc), F.lit("-end-gs"), s(gc * 100)))
            .when(gc == 9, F.lit("ckpt-tmp-9"))
            .otherwise(F.concat(F.lit("checkpoint-final-gs"), s(gc * 100))))
    n = g.select("g", "n", F.when(gc == 7, F.lit(None).cast("double")).otherwise(F.col("m"))
                 .alias("avg_fine_tuned_reward_normalized"), name.alias("checkpoint"))
    return n.select("*", *parse_checkpoint_name(F.col("checkpoint")),
                    is_checkpoint(F.col("checkpoint")).alias("is_checkpoint"))


@query("checkpoint_names", sql=f"""WITH {NAMED_SQL}
SELECT checkpoint, is_checkpoint, epoch, batch, step, is_end, is_final,
       CAST(CASE WHEN is_checkpoint THEN row_number() OVER (PARTITION BY is_checkpoint ORDER BY checkpoint) END AS INTEGER) AS name_rank,
       CAST(CASE WHEN is_checkpoint THEN row_number() OVER (PARTITION BY is_checkpoint ORDER BY step, checkpoint) END AS INTEGER) AS step_rank
FROM ckpts""")
def checkpoint_names(spark, sf_dir):
    """F29 + P7 + O3: parsed names; evaluation order is by *name*
    (``checkpoint-1000`` before ``checkpoint-500``), summary order by step.
    The ranks run over the checkpoint list (one row per checkpoint)."""
    c = named_checkpoints(spark, sf_dir)
    w_name = Window.partitionBy("is_checkpoint").orderBy("checkpoint")
    w_step = Window.partitionBy("is_checkpoint").orderBy("step", "checkpoint")
    ck = F.col("is_checkpoint")
    return c.select("checkpoint", "is_checkpoint", "epoch", "batch", "step", "is_end", "is_final",
                    F.when(ck, F.row_number().over(w_name)).alias("name_rank"),
                    F.when(ck, F.row_number().over(w_step)).alias("step_rank"))


@query("best_checkpoint", sql=f"""WITH {NAMED_SQL}
SELECT arg_min(checkpoint, (-avg_fine_tuned_reward_normalized, checkpoint))
         FILTER (WHERE avg_fine_tuned_reward_normalized IS NOT NULL) AS best_checkpoint,
       round(max(avg_fine_tuned_reward_normalized), 6) AS best_metric_value,
       count(*) AS num_checkpoints, 'avg_fine_tuned_reward_normalized' AS selection_metric
FROM ckpts WHERE is_checkpoint""")
def best_checkpoint_q(spark, sf_dir):
    c = named_checkpoints(spark, sf_dir).where("is_checkpoint")
    b = best_checkpoint(c)
    return b.select("best_checkpoint", r6("best_metric_value"), "num_checkpoints", "selection_metric")


@query("retain_checkpoints", sql=f"""WITH {NAMED_SQL}
SELECT checkpoint, step FROM ckpts WHERE is_checkpoint ORDER BY step DESC NULLS LAST LIMIT 3""")
def retain_checkpoints(spark, sf_dir):
    c = named_checkpoints(spark, sf_dir).where("is_checkpoint").select("checkpoint", "step")
    return retain_latest(c)


@query("checkpoint_eval", sql=f"""WITH {NAMED_SQL}
SELECT c.checkpoint, count(*) AS num_test_cases,
       round(avg(least(1.0, 0.5 + CASE WHEN length(d.text) > 50 THEN 0.1 ELSE 0.0 END
         + CASE WHEN contains(d.text, 'def ') OR contains(d.text, 'class ') OR contains(d.text, 'fn ') THEN 0.2 ELSE 0.0 END
         + CASE WHEN contains(d.text, chr(10)) THEN 0.1 ELSE 0.0 END) + c.step * 1e-6), 6) AS avg_fine_tuned_score
FROM documents d, (SELECT checkpoint, step FROM ckpts WHERE is_checkpoint) c
GROUP BY c.checkpoint""")
def checkpoint_eval(spark, sf_dir):
    """J6 + 3.2: every checkpoint on every prompt in one job; each prompt is scored once, and the checkpoint
    becomes a grouping column of the scores instead of an outer loop."""
    c = named_checkpoints(spark, sf_dir).where("is_checkpoint").select("checkpoint", "step")
    scored = table(spark, sf_dir, "documents").select(heuristic_score(F.col("text")).alias("score"))
    e = expand_checkpoints(scored, c)
    return e.groupBy(F.col("ckpt.checkpoint").alias("checkpoint")).agg(
        F.count(F.lit(1)).alias("num_test_cases"), r6(F.avg(F.col("score") + F.col("ckpt.step") * F.lit(1e-6)), "avg_fine_tuned_score"))


@query("checkpoint_stats", sql=f"""WITH {NAMED_SQL}
SELECT checkpoint, step, epoch, round(coalesce(avg_fine_tuned_reward_normalized, 0.0), 6) AS avg_reward,
       round(coalesce(1 - avg_fine_tuned_reward_normalized, 0.0), 6) AS avg_loss, n AS num_samples
FROM ckpts WHERE is_checkpoint""")
def checkpoint_stats(spark, sf_dir):
    """One stats JSON document per checkpoint folder, written to the
    shared folder, then read back by glob with the file path as the name;
    missing fields take the documented defaults."""
    c = named_checkpoints(spark, sf_dir).where("is_checkpoint")
    stats = c.select("checkpoint", "step", "epoch",
                     F.col("avg_fine_tuned_reward_normalized").alias("avg_reward"),
                     (F.lit(1) - F.col("avg_fine_tuned_reward_normalized")).alias("avg_loss"),
                     F.col("n").alias("num_samples"))
    root = scratch_path(spark, "checkpoints")
    stats.repartition("checkpoint").write.partitionBy("checkpoint").json(root)
    return read_checkpoint_stats(spark, root)


def read_checkpoint_stats(spark: SparkSession, root: str) -> DataFrame:
    schema = "step BIGINT, epoch BIGINT, avg_reward DOUBLE, avg_loss DOUBLE, num_samples BIGINT"
    raw = (spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.json").json(root)
           .withColumn("path", F.col("_metadata.file_path")))
    name = F.regexp_extract(F.col("path"), r"checkpoint=([^/]+)/[^/]*$", 1)
    return raw.select(name.alias("checkpoint"), "step", "epoch",
                      r6(F.coalesce("avg_reward", F.lit(0.0)), "avg_reward"),
                      r6(F.coalesce("avg_loss", F.lit(0.0)), "avg_loss"),
                      F.coalesce("num_samples", F.lit(0).cast("bigint")).alias("num_samples"))
