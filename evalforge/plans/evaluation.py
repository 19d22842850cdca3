"""The whole evaluation run over ``conversations``: a conversation's first user message is a prompt,
its assistant messages are recorded outputs (wrapped as in ``text``) of two models, or of four
checkpoints, by turn; language by conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import example_report, relative_improvement, run_summary, top_improvements
from ..operators.evaluation import choose_checkpoint, compare_run
from ..session import scratch_path
from ..sources import jsonl as J
from .registry import query, r6
from .scoring import TEACHER_CODE_SQL, h_sql, stand_in_teacher
from .sqlgen import difficulty_sql
from .tables import table
from .text import LANG_SQL, WRAP_SQL, _extract_sql, _lang, _strip_sql, wrapped_messages


def run_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    prompts = (c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
               .select(F.col("conv_id").alias("ord"), "prompt", _lang().alias("language")))
    said = c.where("role = 'assistant'").select("conv_id", "turn")
    out = wrapped_messages(spark, sf_dir).join(said, ["conv_id", "turn"])
    half = F.floor(F.col("turn") / 2) % 2
    outputs = out.select(F.col("conv_id").alias("ord"), F.when(half == 0, "baseline").otherwise("fine_tuned").alias("model"),
                         F.concat(F.lit("checkpoint-e1-gs"), (100 * (1 + F.col("turn") % 4)).cast("string")).alias("checkpoint"),
                         F.col("turn").alias("j"), F.col("t").alias("output"),
                         F.length("t").alias("output_tokens"), ((F.col("turn") % 7) / 4).alias("seconds"))
    return prompts, outputs


_GUARD = f"CASE WHEN e IS NOT NULL AND {_strip_sql('e')} <> '' AND e <> t THEN e ELSE t END"
RUN_SQL = f"""
{WRAP_SQL.strip()},
prompts AS (
  SELECT *, row_number() OVER (PARTITION BY prompt, language ORDER BY ord) AS rn
  FROM (SELECT conv_id AS ord, arg_min(text, turn) AS prompt, any_value({LANG_SQL}) AS language
        FROM conversations WHERE role = 'user' GROUP BY conv_id)),
kept AS (SELECT ord, prompt, language, {h_sql(TEACHER_CODE_SQL)} AS teacher_score FROM prompts WHERE rn = 1),
outs AS (
  SELECT k.ord, k.teacher_score, w.turn AS j, t, {_extract_sql('t', 'w.lang')} AS e,
         CASE WHEN (w.turn // 2) % 2 = 0 THEN 'baseline' ELSE 'fine_tuned' END AS model,
         'checkpoint-e1-gs' || CAST(100 * (1 + w.turn % 4) AS VARCHAR) AS checkpoint,
         length(t) / greatest((w.turn % 7) / 4.0, 1e-9) AS tps
  FROM wrapped w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn AND c.role = 'assistant'
  JOIN kept k ON k.ord = w.conv_id),
coded AS (SELECT *, {_GUARD} AS code FROM outs),
scored AS (SELECT *, {h_sql('code')} AS score FROM coded),
rewarded AS (SELECT *, score / (teacher_score + 1e-6) AS reward FROM scored),
per AS (
  SELECT ord, avg(score) FILTER (WHERE model = 'baseline') AS b, avg(score) FILTER (WHERE model = 'fine_tuned') AS f,
         avg(reward) FILTER (WHERE model = 'baseline') AS br, avg(reward) FILTER (WHERE model = 'fine_tuned') AS fr,
         arg_min(code, j) FILTER (WHERE model = 'baseline') AS bc, arg_min(code, j) FILTER (WHERE model = 'fine_tuned') AS fc,
         arg_min(tps, j) FILTER (WHERE model = 'baseline') AS bt, arg_min(tps, j) FILTER (WHERE model = 'fine_tuned') AS ft,
         list(round(reward, 6) ORDER BY j) FILTER (WHERE model = 'fine_tuned') AS rewards
  FROM rewarded GROUP BY ord),
rows AS (SELECT per.*, prompt, language, {difficulty_sql('prompt', 'language')['index']} AS difficulty FROM per JOIN kept USING (ord))"""


def _run(spark, sf_dir) -> DataFrame:
    prompts, outputs = run_inputs(spark, sf_dir)
    return compare_run(prompts, outputs, stand_in_teacher)


@query("comparison_run", sql=f"""WITH {RUN_SQL}
SELECT ord, language, md5(prompt) AS prompt_md5, round(difficulty, 6) AS difficulty, round(b, 6) AS baseline_score,
       round(f, 6) AS fine_tuned_score, round(f - b, 6) AS improvement, round(fr - br, 6) AS reward_improvement,
       md5(bc) AS baseline_code_md5, md5(fc) AS fine_tuned_code_md5, coalesce(rewards, []) AS fine_tuned_reward_samples
FROM rows""")
def comparison_run(spark, sf_dir):
    """SURVEY 3.1 end to end: W1, difficulty, F22/F27, F16, J1, F17, A1-A4, J4, T5."""
    r = _run(spark, sf_dir)
    return r.select("ord", "language", F.md5("prompt").alias("prompt_md5"), r6(F.col("difficulty.index"), "difficulty"),
                    r6("baseline_score"), r6("fine_tuned_score"), r6("improvement"), r6("reward_improvement"),
                    F.md5("baseline_code").alias("baseline_code_md5"), F.md5("fine_tuned_code").alias("fine_tuned_code_md5"),
                    F.transform("fine_tuned_reward_samples", lambda x: F.round(x, 6)).alias("fine_tuned_reward_samples"))


@query("comparison_summary", sql=f"""WITH {RUN_SQL}
SELECT count(*) AS num_test_cases, round(avg(b), 6) AS avg_baseline_score, round(avg(f), 6) AS avg_fine_tuned_score,
       round(avg(f - b), 6) AS avg_improvement, count(*) FILTER (WHERE f > b) AS num_improved,
       count(*) FILTER (WHERE f < b) AS num_degraded, count(*) FILTER (WHERE f = b) AS num_equal,
       round(avg(fr), 6) AS avg_fine_tuned_reward_normalized, round(avg(fr - br), 6) AS avg_reward_improvement,
       round(CASE WHEN avg(b) = 0 THEN NULL ELSE avg(f - b) / avg(b) * 100 END, 6) AS relative_improvement_pct
FROM rows""")
def comparison_summary(spark, sf_dir):
    """A5 + A6 + F30 + S10: the run's summary and examples written, the summary read back."""
    r = _run(spark, sf_dir)
    s = relative_improvement(run_summary(r))
    summary = s.select(F.struct("*").alias("stats"), F.struct(F.lit("mean").alias("aggregate")).alias("metadata"))
    root = scratch_path(spark, "comparison")
    J.write_results(summary, r, root)
    back = spark.read.schema(summary.schema).json(root + "/summary").select("stats.*")
    return back.select("num_test_cases", r6("avg_baseline_score"), r6("avg_fine_tuned_score"), r6("avg_improvement"),
                       "num_improved", "num_degraded", "num_equal", r6("avg_fine_tuned_reward_normalized"),
                       r6("avg_reward_improvement"), r6("relative_improvement_pct"))


@query("comparison_examples", sql=f"""WITH {RUN_SQL},
best AS (SELECT * FROM rows WHERE f - b IS NOT NULL ORDER BY f - b DESC, ord LIMIT 3)
SELECT ord, language, CASE WHEN length(prompt) <= 60 THEN prompt ELSE substr(prompt, 1, 60) || '...' END AS prompt_preview,
       round(f - b, 6) AS improvement, round(bt, 3) AS baseline_tok_s, round(ft, 3) AS fine_tuned_tok_s,
       CASE WHEN length(bc) <= 40 THEN bc ELSE substr(bc, 1, 40) || '...' END AS baseline_code_preview,
       CASE WHEN length(fc) <= 40 THEN fc ELSE substr(fc, 1, 40) || '...' END AS fine_tuned_code_preview
FROM best""")
def comparison_examples(spark, sf_dir):
    """O1 + O5: the three best prompts with preview, language, speeds and codes."""
    r = _run(spark, sf_dir).where(F.col("improvement").isNotNull())
    top = example_report(top_improvements(r), 40)
    return top.select("ord", "language", "prompt_preview", r6("improvement"),
                      F.round("baseline_tokens_per_sec", 3).alias("baseline_tok_s"),
                      F.round("fine_tuned_tokens_per_sec", 3).alias("fine_tuned_tok_s"),
                      "baseline_code_preview", "fine_tuned_code_preview")


@query("checkpoint_choice", sql=f"""WITH {RUN_SQL},
stats AS (SELECT checkpoint, avg(reward) AS m FROM rewarded GROUP BY checkpoint)
SELECT arg_min(checkpoint, {{'a': -m, 'b': checkpoint}}) AS best_checkpoint, round(max(m), 6) AS best_metric_value,
       count(*) AS num_checkpoints, 'avg_fine_tuned_reward_normalized' AS selection_metric
FROM stats""")
def checkpoint_choice(spark, sf_dir):
    """SURVEY 3.2: each checkpoint's outputs evaluated, the best one chosen from that (O2)."""
    prompts, outputs = run_inputs(spark, sf_dir)
    _, best = choose_checkpoint(prompts, outputs, stand_in_teacher)
    return best.select("best_checkpoint", r6("best_metric_value"), "num_checkpoints", "selection_metric")
