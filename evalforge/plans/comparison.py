"""Model comparison queries (3.1 in the survey) fed from ``lineitem``.

Mapping: an order is a prompt (``ord = l_orderkey``), a line is a sample
(``j = l_linenumber``); the baseline model scores ``l_discount*10``, the
tuned model ``l_tax*10`` (as DECIMAL so equal means are exactly equal and
the improvement sign does not depend on summation order).  Codes and
generation numbers are projected from other line columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import throughput_floored
from ..operators.compare import (compare_prompts, example_report, expand_samples, relative_improvement,
                                 run_summary, sample_seed, top_improvements)
from .registry import query, r6
from .tables import table

GEN_SQL = """
WITH gens AS (
  SELECT l_orderkey AS ord, l_linenumber AS j, 'baseline' AS model,
         CAST(l_discount AS DECIMAL(10,4)) * 10 AS score, 'b' || CAST(l_partkey AS VARCHAR) AS code,
         l_quantity AS seconds, CAST(floor(l_extendedprice / 100) AS INTEGER) AS output_tokens,
         l_partkey AS t1, l_suppkey AS t2
  FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_linenumber, 'fine_tuned', CAST(l_tax AS DECIMAL(10,4)) * 10,
         'f' || CAST(l_suppkey AS VARCHAR), l_quantity / 2, CAST(floor(l_extendedprice / 100) AS INTEGER),
         l_partkey, l_suppkey
  FROM lineitem
)"""


def lineitem_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lean form (ord, model, score): the scan reads three columns."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_tax")
    return li.select(F.col("l_orderkey").alias("ord"), F.expr(
        "stack(2, 'baseline', CAST(l_discount AS DECIMAL(10,4)) * 10, "
        "'fine_tuned', CAST(l_tax AS DECIMAL(10,4)) * 10) AS (model, score)"))


def lineitem_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("j"),
        F.expr("""stack(2,
            'baseline', CAST(l_discount AS DECIMAL(10,4)) * 10, concat('b', CAST(l_partkey AS STRING)),
            'fine_tuned', CAST(l_tax AS DECIMAL(10,4)) * 10, concat('f', CAST(l_suppkey AS STRING)))
            AS (model, score, code)"""),
        "l_quantity",
        F.floor(F.col("l_extendedprice") / 100).cast("int").alias("output_tokens"),
        F.col("l_partkey").alias("t1"), F.col("l_suppkey").alias("t2"),
    ).withColumn(  # outside the generator, so Catalyst prunes it (and its input) when unused
        "seconds", F.when(F.col("model") == "baseline", F.col("l_quantity")).otherwise(F.col("l_quantity") / 2)
    ).drop("l_quantity").withColumn("tokens_per_sec", throughput_floored(F.col("output_tokens"), F.col("seconds")))


def _per_prompt(spark, sf_dir, aggregate="mean", **kw):
    return compare_prompts(lineitem_generations(spark, sf_dir), keys=["ord"], aggregate=aggregate,
                           code_col="code", tie_cols=["t1", "t2"], **kw)


PER_PROMPT_SQL = GEN_SQL + """,
per_prompt AS (
  SELECT ord,
         avg(score) FILTER (WHERE model = 'baseline') AS b,
         avg(score) FILTER (WHERE model = 'fine_tuned') AS f
  FROM gens GROUP BY ord
)"""


@query("compare_models", sql=PER_PROMPT_SQL + """
SELECT count(*) AS num_test_cases,
       round(avg(b), 6) AS avg_baseline_score,
       round(avg(f), 6) AS avg_fine_tuned_score,
       round(avg(f - b), 6) AS avg_improvement,
       count(*) FILTER (WHERE f - b > 0) AS num_improved,
       count(*) FILTER (WHERE f - b < 0) AS num_degraded,
       count(*) FILTER (WHERE f - b = 0) AS num_equal
FROM per_prompt""")
def compare_models(spark, sf_dir):
    s = run_summary(compare_prompts(lineitem_scores(spark, sf_dir), keys=["ord"]))
    return s.select("num_test_cases", r6("avg_baseline_score"), r6("avg_fine_tuned_score"),
                    r6("avg_improvement"), "num_improved", "num_degraded", "num_equal")


@query("improvement_distribution", sql=GEN_SQL + """,
per_prompt AS (
  SELECT ord, max(score) FILTER (WHERE model = 'fine_tuned') - max(score) FILTER (WHERE model = 'baseline') AS imp
  FROM gens GROUP BY ord
)
SELECT count(*) FILTER (WHERE imp > 0) AS num_improved,
       count(*) FILTER (WHERE imp < 0) AS num_degraded,
       count(*) FILTER (WHERE imp = 0) AS num_equal,
       count(*) AS num_test_cases
FROM per_prompt""")
def improvement_distribution(spark, sf_dir):
    s = run_summary(compare_prompts(lineitem_scores(spark, sf_dir), keys=["ord"], aggregate="max"))
    return s.select("num_improved", "num_degraded", "num_equal", "num_test_cases")


@query("relative_improvement", sql=PER_PROMPT_SQL + """
SELECT round(avg(b), 6) AS avg_baseline_score, round(avg(f - b), 6) AS avg_improvement,
       round(CASE WHEN avg(b) = 0 THEN NULL ELSE avg(f - b) / avg(b) * 100 END, 6) AS relative_improvement_pct
FROM per_prompt""")
def relative_improvement_q(spark, sf_dir):
    s = relative_improvement(run_summary(compare_prompts(lineitem_scores(spark, sf_dir), keys=["ord"])))
    return s.select(r6("avg_baseline_score"), r6("avg_improvement"), r6("relative_improvement_pct"))


@query("sample_mean", sql=PER_PROMPT_SQL.replace(
    "avg(score) FILTER (WHERE model = 'fine_tuned') AS f",
    "avg(score) FILTER (WHERE model = 'fine_tuned') AS f, min(j) AS pick") + """
SELECT ord, round(b, 6) AS baseline_score, round(f, 6) AS fine_tuned_score, round(f - b, 6) AS improvement,
       pick AS baseline_pick, pick AS fine_tuned_pick
FROM per_prompt""")
def sample_mean(spark, sf_dir):
    p = _per_prompt(spark, sf_dir, aggregate="mean")
    return p.select("ord", r6("baseline_score"), r6("fine_tuned_score"), r6("improvement"),
                    "baseline_pick", "fine_tuned_pick")


MAX_SQL = GEN_SQL + """,
best AS (
  SELECT ord, arg_min({'s': score, 'j': j, 'code': code}, {'a': -score, 'b': j, 'c': t1, 'd': t2})
                FILTER (WHERE model = 'baseline') AS b,
         arg_min({'s': score, 'j': j, 'code': code}, {'a': -score, 'b': j, 'c': t1, 'd': t2})
                FILTER (WHERE model = 'fine_tuned') AS f
  FROM gens GROUP BY ord)
SELECT ord, CAST(round(b.s, 6) AS DOUBLE) AS baseline_score, CAST(round(f.s, 6) AS DOUBLE) AS fine_tuned_score,
       CAST(round(f.s - b.s, 6) AS DOUBLE) AS improvement, b.j AS baseline_pick, f.j AS fine_tuned_pick,
       b.code AS baseline_code, f.code AS fine_tuned_code
FROM best WHERE b IS NOT NULL AND f IS NOT NULL"""


@query("sample_max", sql=MAX_SQL)
def sample_max(spark, sf_dir):
    p = _per_prompt(spark, sf_dir, aggregate="max")
    return p.select("ord", r6("baseline_score"), r6("fine_tuned_score"), r6("improvement"),
                    "baseline_pick", "fine_tuned_pick", "baseline_code", "fine_tuned_code")


@query("sample_pick", sql=GEN_SQL + """,
first AS (
  SELECT ord, arg_min({'j': j, 'code': code}, {'b': j, 'c': t1, 'd': t2}) FILTER (WHERE model = 'baseline') AS b,
         arg_min({'j': j, 'code': code}, {'b': j, 'c': t1, 'd': t2}) FILTER (WHERE model = 'fine_tuned') AS f
  FROM gens GROUP BY ord)
SELECT ord, b.j AS baseline_pick, b.code AS baseline_code, f.j AS fine_tuned_pick, f.code AS fine_tuned_code
FROM first WHERE b IS NOT NULL AND f IS NOT NULL""")
def sample_pick(spark, sf_dir):
    p = _per_prompt(spark, sf_dir, aggregate="mean")
    return p.select("ord", "baseline_pick", "baseline_code", "fine_tuned_pick", "fine_tuned_code")


@query("sample_arrays", sql=GEN_SQL + """
SELECT ord,
       list(CAST(score AS DOUBLE) ORDER BY j, t1, t2, score) FILTER (WHERE model = 'baseline') AS baseline_score_samples,
       list(CAST(score AS DOUBLE) ORDER BY j, t1, t2, score) FILTER (WHERE model = 'fine_tuned') AS fine_tuned_score_samples
FROM gens GROUP BY ord""")
def sample_arrays(spark, sf_dir):
    g = lineitem_generations(spark, sf_dir).withColumn("score", F.col("score").cast("double"))
    p = compare_prompts(g, keys=["ord"], with_samples=True, tie_cols=["t1", "t2"])
    return p.select("ord", "baseline_score_samples", "fine_tuned_score_samples")


@query("top_improvements", sql=PER_PROMPT_SQL.replace(
    "avg(score) FILTER (WHERE model = 'fine_tuned') AS f",
    "avg(score) FILTER (WHERE model = 'fine_tuned') AS f, "
    "arg_min(code, j * 1e12 + t1 * 1e6 + t2) FILTER (WHERE model = 'baseline') AS bc, "
    "arg_min(code, j * 1e12 + t1 * 1e6 + t2) FILTER (WHERE model = 'fine_tuned') AS fc") + """
SELECT ord, round(b, 6) AS baseline_score, round(f, 6) AS fine_tuned_score, round(f - b, 6) AS improvement,
       CASE WHEN length(bc) <= 3 THEN bc ELSE substr(bc, 1, 3) || '...' END AS baseline_code_preview,
       CASE WHEN length(fc) <= 3 THEN fc ELSE substr(fc, 1, 3) || '...' END AS fine_tuned_code_preview
FROM per_prompt ORDER BY f - b DESC, ord LIMIT 3""")
def top_improvements_q(spark, sf_dir):
    top = example_report(top_improvements(_per_prompt(spark, sf_dir), k=3, order_col="ord"), print_chars=3)
    return top.select("ord", r6("baseline_score"), r6("fine_tuned_score"), r6("improvement"),
                      "baseline_code_preview", "fine_tuned_code_preview")


@query("seeded_samples", sql="""
SELECT p_partkey AS ord, j, CAST(0 + p_partkey * 1000 + j AS BIGINT) AS seed,
       CAST(NULL AS BIGINT) AS seed_unseeded
FROM part, range(0, 3) t(j)""")
def seeded_samples(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"))
    s = expand_samples(parts, 3)
    return s.select("ord", F.col("j").cast("bigint").alias("j"),
                    sample_seed(0, F.col("ord"), F.col("j")).alias("seed"),
                    sample_seed(None, F.col("ord"), F.col("j")).alias("seed_unseeded"))


@query("normalized_comparison", sql=GEN_SQL + """,
teacher AS (SELECT o_orderkey AS ord, o_totalprice / 100000 AS teacher_score FROM orders),
r AS (SELECT g.ord, g.model, CAST(g.score AS DOUBLE) / (t.teacher_score + 1e-6) AS reward
      FROM gens g JOIN teacher t ON g.ord = t.ord),
per AS (SELECT ord, avg(reward) FILTER (WHERE model = 'baseline') AS br,
               avg(reward) FILTER (WHERE model = 'fine_tuned') AS fr FROM r GROUP BY ord)
SELECT count(*) AS num_test_cases, round(avg(br), 6) AS avg_baseline_reward_normalized,
       round(avg(fr), 6) AS avg_fine_tuned_reward_normalized, round(avg(fr - br), 6) AS avg_reward_improvement
FROM per""")
def normalized_comparison(spark, sf_dir):
    """A3 + A5 (normalised part) + J1: each prompt's teacher score (its
    order's price / 1e5) joined once per prompt; rewards are student /
    (teacher + eps), aggregated like the scores."""
    from ..functions.scoring import normalized_reward
    g = lineitem_scores(spark, sf_dir)
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"),
                                               (F.col("o_totalprice") / 100000).alias("teacher_score"))
    r = g.join(t, "ord").withColumn("reward", normalized_reward(F.col("score"), F.col("teacher_score")))
    s = run_summary(compare_prompts(r, keys=["ord"], reward_col="reward"))
    return s.select("num_test_cases", r6("avg_baseline_reward_normalized"), r6("avg_fine_tuned_reward_normalized"),
                    r6("avg_reward_improvement"))
