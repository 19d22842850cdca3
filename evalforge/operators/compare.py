"""Paired model comparison: samples -> per-prompt aggregates -> run summary.

Input is the *long* generation frame, one row per (prompt key, model, sample
j).  Both models of a prompt are combined by ONE ``groupBy`` with conditional
aggregates (a pivot), not by a self-join: one shuffle on the prompt key with
map-side partial aggregation, so a prompt with many samples never
materialises as a whole group before the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import truncate_text

MODELS = ("baseline", "fine_tuned")
AGGREGATES = ("mean", "max")
PREVIEW_CHARS = 60              # prompt preview of the example report (fixed value)


def expand_samples(prompts: DataFrame, n: int, j_col: str = "j") -> DataFrame:
    """Each prompt row repeated for samples 0..n-1 (n at least 1)."""
    n = max(1, int(n))
    return prompts.withColumn(j_col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sample_seed(base: Column | int | None, i: Column, j: Column) -> Column:
    """``base + i*1000 + j``; a NULL base gives NULL (seeding disabled)."""
    b = base if isinstance(base, Column) else F.lit(base).cast("bigint")
    return b + i.cast("bigint") * F.lit(1000) + j.cast("bigint")


def _check_agg(aggregate: str) -> str:
    agg = str(aggregate or "mean").strip().lower()
    if agg not in AGGREGATES:
        raise ValueError(f"Unsupported aggregate={aggregate!r}. Use 'mean' or 'max'.")
    return agg


def compare_prompts(gens: DataFrame, keys: Sequence[str] = ("ord",), aggregate: str = "mean",
                    model_col: str = "model", j_col: str = "j", score_col: str = "score",
                    reward_col: str | None = None, code_col: str | None = None,
                    gen_cols: Sequence[str] = (), with_samples: bool = False,
                    tie_cols: Sequence[str] = ()) -> DataFrame:
    """A1-A4 + J4: one row per prompt with both models side by side.

    * ``aggregate='mean'``: average of sample scores; representative sample
      is j's smallest index.  ``'max'``: maximum; representative is the first
      j reaching it (``max_by`` on ``(score, -j)``).
    * rewards (normalised scores) get the same aggregate when ``reward_col``
      is given, else the reward columns are NULL (absolute mode).
    * ``with_samples`` adds the per-model score arrays, and reward arrays, in j order (A4).
    * ``tie_cols`` (numeric) order samples that share a j, so "first" stays
      deterministic when j is not unique within a prompt.
    """
    agg = _check_agg(aggregate)
    keys = list(keys)
    picks = j_col in gens.columns        # a lean (key, model, score) frame has no sample index
    exprs: list[Column] = []
    for m in MODELS:
        is_m = F.col(model_col) == F.lit(m)
        sc = F.when(is_m, F.col(score_col))
        exprs.append((F.avg(sc) if agg == "mean" else F.max(sc)).alias(f"{m}_score"))
        if reward_col:
            rw = F.when(is_m, F.col(reward_col))
            exprs.append((F.avg(rw) if agg == "mean" else F.max(rw)).alias(f"{m}_reward_normalized"))
        if not picks:
            continue
        # representative sample: the struct ordering picks the first j at the max
        pick_payload = [F.col(j_col).alias("j")]
        if code_col:
            pick_payload.append(F.col(code_col).alias("code"))
        for c in gen_cols:
            pick_payload.append(F.col(c).alias(c))
        payload = F.when(is_m, F.struct(*pick_payload))
        if agg == "max":
            order = F.when(is_m, F.struct(F.col(score_col).alias("s"), (-F.col(j_col)).alias("nj"),
                                          *[(-F.col(t)).alias(f"t{i}") for i, t in enumerate(tie_cols)]))
            exprs.append(F.max_by(payload, order).alias(f"_{m}_pick"))
        else:
            order = F.when(is_m, F.struct(F.col(j_col).alias("j"),
                                          *[F.col(t).alias(f"t{i}") for i, t in enumerate(tie_cols)]))
            exprs.append(F.min_by(payload, order).alias(f"_{m}_pick"))
        if with_samples:
            # bounded by the number of samples per prompt (a parameter, not the data size)
            exprs.append(F.collect_list(F.when(is_m, F.struct(
                F.col(j_col).alias("j"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tie_cols)],
                F.col(score_col).alias("s"), *([F.col(reward_col).alias("r")] if reward_col else [])))
            ).alias(f"_{m}_samples"))
    out = gens.groupBy(*keys).agg(*exprs)
    cols = [F.col(k) for k in keys] + [
        F.col("baseline_score"), F.col("fine_tuned_score"),
        (F.col("fine_tuned_score") - F.col("baseline_score")).alias("improvement"),
    ]
    if reward_col:
        cols += [F.col("baseline_reward_normalized"), F.col("fine_tuned_reward_normalized"),
                 (F.col("fine_tuned_reward_normalized") - F.col("baseline_reward_normalized"))
                 .alias("reward_improvement")]
    else:
        cols += [F.lit(None).cast("double").alias(c) for c in
                 ("baseline_reward_normalized", "fine_tuned_reward_normalized", "reward_improvement")]
    for m in MODELS if picks else ():
        cols.append(F.col(f"_{m}_pick.j").alias(f"{m}_pick"))
        if code_col:
            cols.append(F.col(f"_{m}_pick.code").alias(f"{m}_code"))
        for c in gen_cols:
            cols.append(F.col(f"_{m}_pick.{c}").alias(f"{m}_{c}"))
        if with_samples:
            cols.append(F.transform(F.array_sort(F.col(f"_{m}_samples")), lambda x: x["s"])
                        .alias(f"{m}_score_samples"))
            if reward_col:
                cols.append(F.transform(F.array_sort(F.col(f"_{m}_samples")), lambda x: x["r"])
                            .alias(f"{m}_reward_samples"))
    return out.select(*cols)


def run_summary(per_prompt: DataFrame) -> DataFrame:
    """A5 + A6: one-row statistics over all prompts (NULL averages on no input)."""
    imp = F.col("improvement")
    return per_prompt.agg(
        F.count(F.lit(1)).alias("num_test_cases"),
        F.avg("baseline_score").alias("avg_baseline_score"),
        F.avg("fine_tuned_score").alias("avg_fine_tuned_score"),
        F.avg(imp).alias("avg_improvement"),
        F.count_if(imp > 0).alias("num_improved"),
        F.count_if(imp < 0).alias("num_degraded"),
        F.count_if(imp == 0).alias("num_equal"),
        F.avg("baseline_reward_normalized").alias("avg_baseline_reward_normalized"),
        F.avg("fine_tuned_reward_normalized").alias("avg_fine_tuned_reward_normalized"),
        F.avg("reward_improvement").alias("avg_reward_improvement"),
    )


def relative_improvement(summary: DataFrame) -> DataFrame:
    """avg_improvement / avg_baseline * 100; NULL instead of an error on 0."""
    return summary.withColumn(
        "relative_improvement_pct",
        F.try_divide(F.col("avg_improvement"), F.col("avg_baseline_score")) * F.lit(100.0))


def top_improvements(per_prompt: DataFrame, k: int = 3, order_col: str = "ord") -> DataFrame:
    """O1: the k best prompts by improvement, ties in original order.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps
    its own top k, only k rows per partition reach the final merge.
    """
    return per_prompt.orderBy(F.col("improvement").desc(), F.col(order_col).asc()).limit(int(k))


def example_report(top: DataFrame, print_chars: int = 200, prompt_chars: int = PREVIEW_CHARS) -> DataFrame:
    """Report rows for the top examples with truncated codes and a prompt preview."""
    cols = [c for c in top.columns]
    out = top
    for m in MODELS:
        if f"{m}_code" in cols:
            out = out.withColumn(f"{m}_code_preview", truncate_text(F.col(f"{m}_code"), print_chars))
    if "prompt" in cols:
        out = out.withColumn("prompt_preview", truncate_text(F.col("prompt"), prompt_chars))
    return out
