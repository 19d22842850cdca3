"""The evaluation run as one plan: prompts and recorded outputs in, paired comparison out.

Prompts are checked for repeats (W1) and cut to the first n (P4), rated for
difficulty (F5-F14); code is pulled out of each output (F22, F27) and scored
(F16), the teacher is asked once per prompt and language (U2, J1) and rewards are
normalised (F17); both models of a prompt meet in one aggregate (A1-A4, J4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import extract_code_from_reasoning, extraction_guard
from ..functions.rubric import difficulty_columns
from ..functions.scoring import heuristic_score, normalized_reward, throughput_floored
from . import teacher as T
from .checkpoints import best_checkpoint
from .compare import compare_prompts
from .corpus import dedupe_first, head

Teacher = Callable[[Column, Column], tuple[Column, Column]]


def score_outputs(prompts: DataFrame, outputs: DataFrame, teacher: Teacher, keep: tuple[str, ...] = ("model", "j"),
                  max_prompts: int = 0) -> DataFrame:
    """prompts (ord, prompt, language), outputs (ord, ..., output, output_tokens, seconds): one row an output
    of the prompts that stay, with code, score, teacher_score, reward and tokens_per_sec."""
    kept = head(dedupe_first(prompts), max_prompts)
    refs = T.teacher_references(T.distinct_keys(kept), teacher)
    known = T.score_with_teacher(kept.withColumn("student_score", F.lit(0.0)), refs).select(
        "ord", "language", "teacher_score")
    code = extraction_guard(F.col("output"), extract_code_from_reasoning(F.col("output"), F.col("language")))
    rows = outputs.join(known, "ord").select(
        "ord", *keep, "language", "teacher_score", code.alias("code"), "output_tokens", "seconds")
    return (rows.withColumn("score", heuristic_score(F.col("code")))
            .withColumn("reward", normalized_reward(F.col("score"), F.col("teacher_score")))
            .withColumn("tokens_per_sec", throughput_floored(F.col("output_tokens"), F.col("seconds"))))


def compare_run(prompts: DataFrame, outputs: DataFrame, teacher: Teacher, aggregate: str = "mean",
                max_prompts: int = 0) -> DataFrame:
    """One row per prompt: T5 with prompt, language, difficulty and the sample arrays."""
    scored = score_outputs(prompts, outputs, teacher, max_prompts=max_prompts)
    per = compare_prompts(scored, keys=["ord"], aggregate=aggregate, reward_col="reward", code_col="code",
                          gen_cols=("tokens_per_sec",), with_samples=True)
    rated = head(dedupe_first(prompts), max_prompts).select(
        "ord", "prompt", "language", F.struct(*difficulty_columns(F.col("prompt"), F.col("language"))).alias("difficulty"))
    return rated.join(per, "ord")


def choose_checkpoint(prompts: DataFrame, outputs: DataFrame, teacher: Teacher) -> tuple[DataFrame, DataFrame]:
    """outputs carry a ``checkpoint``: (statistics of each checkpoint, the best one's row) from the same scoring."""
    scored = score_outputs(prompts, outputs, teacher, keep=("checkpoint", "j"))
    stats = scored.groupBy("checkpoint").agg(
        F.count(F.lit(1)).alias("num_test_cases"), F.avg("score").alias("avg_fine_tuned_score"),
        F.avg("reward").alias("avg_fine_tuned_reward_normalized"))
    return stats, best_checkpoint(stats)
