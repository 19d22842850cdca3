"""Scalar scoring, reward and formatting expressions (all JVM-side Columns).

Every function takes and returns ``Column`` so the whole chain stays inside
whole-stage codegen; none of them needs Python at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (stated once, in order).
HEURISTIC_BASE = 0.5            # F16 start score
HEURISTIC_LONG_BONUS = 0.1      # length > 50
HEURISTIC_LONG_CHARS = 50
HEURISTIC_DEF_BONUS = 0.2       # "def " / "class " / "fn " present
HEURISTIC_DEF_MARKERS = ("def ", "class ", "fn ")
HEURISTIC_NEWLINE_BONUS = 0.1   # a newline present
REWARD_EPS = 1e-6               # F17: student / (teacher + eps)
THROUGHPUT_MIN_SECONDS = 1e-9   # F18 floor
REWARD_FLOOR = 0.02             # P11 (config reward_threshold)
TARGET_REWARD = 0.7             # P12 (evaluation reward_threshold)
TIER_THRESHOLD = 0.3            # P13 heuristic gate
PROMPT_CONTEXT_CHARS = 200      # P6
REWARD_WEIGHT = 1.2             # F33
KL_PENALTY = 0.10               # F32
BONUS = 0.1                     # P15
# ---------------------------------------------------------------------------


def truncate_text(s: Column, n) -> Column:
    """P5: n<=0 or non-numeric -> unchanged; len<=n unchanged; else n chars + '...'."""
    try:
        n = int(n)
    except (TypeError, ValueError):
        n = 0
    if n <= 0:
        return s
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n), F.lit("...")))


def scoring_context(prompt: Column, chars: int = PROMPT_CONTEXT_CHARS) -> Column:
    """Prompt cut to ``chars`` characters before scoring (no ellipsis)."""
    return F.substring(prompt, 1, int(chars))


def heuristic_score(code: Column) -> Column:
    """F16: fallback score in the reference's add order, capped at 1.0; no code has no score."""
    s = F.lit(HEURISTIC_BASE)
    s = s + F.when(F.length(code) > HEURISTIC_LONG_CHARS, F.lit(HEURISTIC_LONG_BONUS)).otherwise(F.lit(0.0))
    has_def = F.lit(False)
    for m in HEURISTIC_DEF_MARKERS:
        has_def = has_def | code.contains(m)
    s = s + F.when(has_def, F.lit(HEURISTIC_DEF_BONUS)).otherwise(F.lit(0.0))
    s = s + F.when(code.contains("\n"), F.lit(HEURISTIC_NEWLINE_BONUS)).otherwise(F.lit(0.0))
    return F.when(code.isNotNull(), F.least(F.lit(1.0), s))


def normalized_reward(student: Column, teacher: Column, eps: float = REWARD_EPS) -> Column:
    """student / (teacher + eps), unclamped."""
    return student.cast("double") / (teacher.cast("double") + F.lit(float(eps)))


def throughput_floored(tokens: Column, seconds: Column) -> Column:
    """tokens / max(1e-9, seconds); unknown seconds (a request that timed out) give NULL."""
    return F.when(seconds.isNotNull(),
                  tokens.cast("double") / F.greatest(seconds.cast("double"), F.lit(THROUGHPUT_MIN_SECONDS)))


def throughput_guarded(tokens: Column, seconds: Column) -> Column:
    """tokens / seconds if seconds > 0 else 0."""
    return F.when(seconds > 0, tokens.cast("double") / seconds.cast("double")).otherwise(F.lit(0.0))


def speed_comparison(baseline_seconds: Column, candidate_seconds: Column) -> Column:
    """F20 rendered: 'Speedup r' / 'Slowdown 1/r' / 'Same' (two decimals); NULL
    unless both > 0.  Java formats a decimal tie (e.g. 4.725) half-up where
    Python rounds the exact binary value; ``speed_kind``/``speed_factor``
    carry the same result as data."""
    r = F.try_divide(baseline_seconds.cast("double"), candidate_seconds.cast("double"))
    both = (baseline_seconds > 0) & (candidate_seconds > 0)
    # values are rounded half-up to 2 places before formatting (Java and C
    # format decimal ties differently; the rounded value prints the same)
    return (F.when(~both, F.lit(None).cast("string"))
            .when(r > 1, F.format_string("Speedup %.2fx", F.round(r, 2)))
            .when(r < 1, F.format_string("Slowdown %.2fx", F.round(F.try_divide(F.lit(1.0), r), 2)))
            .otherwise(F.lit("Same")))


def speed_kind(baseline_seconds: Column, candidate_seconds: Column) -> Column:
    """F20 as data: 'Speedup' / 'Slowdown' / 'Same', NULL unless both > 0."""
    r = F.try_divide(baseline_seconds.cast("double"), candidate_seconds.cast("double"))
    both = (baseline_seconds > 0) & (candidate_seconds > 0)
    return (F.when(~both, F.lit(None).cast("string")).when(r > 1, F.lit("Speedup"))
            .when(r < 1, F.lit("Slowdown")).otherwise(F.lit("Same")))


def speed_factor(baseline_seconds: Column, candidate_seconds: Column) -> Column:
    """F20 factor: r for a speed-up, 1/r for a slow-down, 1 when equal."""
    r = F.try_divide(baseline_seconds.cast("double"), candidate_seconds.cast("double"))
    both = (baseline_seconds > 0) & (candidate_seconds > 0)
    return F.when(both, F.when(r < 1, F.try_divide(F.lit(1.0), r)).otherwise(r))


def throughput_class(tok_s: Column, gen_seconds: Column | None = None, mlx: bool = True) -> Column:
    """MLX backend: >1 excellent, >0.5 good, else slow.
    Other backend: > 10 s 'slow', < 1 tok/s 'very_slow', else 'ok'."""
    if mlx:
        return (F.when(tok_s > 1.0, F.lit("excellent")).when(tok_s > 0.5, F.lit("good"))
                .otherwise(F.lit("slow")))
    return (F.when(gen_seconds > 10, F.lit("slow")).when(tok_s < 1.0, F.lit("very_slow"))
            .otherwise(F.lit("ok")))


def duration_text(seconds: Column) -> Column:
    """'2h 15m 30s (8130.5 seconds)'."""
    s = seconds.cast("double")
    h = F.floor(s / 3600)
    m = F.floor((s - h * 3600) / 60)
    sec = F.floor(s - h * 3600 - m * 60)
    return F.format_string("%dh %dm %ds (%.1f seconds)", h, m, sec, F.round(s, 1))


def weighted_loss(log_prob: Column, reward: Column, kl: Column, kl_penalty: float = KL_PENALTY) -> Column:
    """F32: -log_prob * reward + kl_penalty * kl over logged values."""
    return -log_prob * reward + F.lit(float(kl_penalty)) * kl


def weighted_reward(reward: Column, weight: float = REWARD_WEIGHT) -> Column:
    """reward * weight (decision: plain product, before clamping)."""
    return reward * F.lit(float(weight))


def sanitize_reward(reward: Column, safe_value: float = 0.0) -> Column:
    """NaN / +-Inf -> safe value, then clamp to [0, 1]; an unscored sample (NULL) stays unscored."""
    bad = F.isnan(reward) | (F.abs(reward) == F.lit(float("inf")))
    x = F.when(bad, F.lit(float(safe_value))).otherwise(reward)
    return F.when(reward.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def reward_floor_ok(reward: Column, floor: float = REWARD_FLOOR) -> Column:
    """P11 predicate (decision: inclusive)."""
    return reward >= F.lit(float(floor))


def target_reached(avg_reward: Column, target: float = TARGET_REWARD) -> Column:
    """P12."""
    return avg_reward >= F.lit(float(target))


def tiered_score(heuristic: Column, teacher: Column, threshold: float = TIER_THRESHOLD) -> Column:
    """The teacher score only where the heuristic passes the gate."""
    return F.when(heuristic >= F.lit(float(threshold)), teacher).otherwise(heuristic)


def reward_bonus(reward: Column, demand_met: Column, enabled: bool = False, bonus: float = BONUS) -> Column:
    """Optional additive bonus (off by default)."""
    if not enabled:
        return reward
    return reward + F.when(demand_met, F.lit(float(bonus))).otherwise(F.lit(0.0))


def render_number(x: Column, precision: int = 4) -> Column:
    """P10: Python ``'%.4g' % x`` as a Column (JVM only).

    The exponent is read back from Java's ``%e`` after rounding, then the
    fixed or scientific form is chosen as C does, trailing zeros stripped.
    Java rounds decimal ties half-up, so a value exactly on a tie may differ
    from C in the last digit.
    """
    p = int(precision)
    d = x.cast("double")
    sci = F.format_string(f"%.{p - 1}e", d)
    exp = F.regexp_extract(sci, r"e([-+][0-9]+)$", 1).cast("int")
    mant = F.regexp_extract(sci, r"^(-?[0-9.]+)e", 1)
    mant_s = F.regexp_replace(F.regexp_replace(mant, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    sci_s = F.concat(mant_s, F.lit("e"), F.regexp_extract(sci, r"e([-+])", 1),
                     F.lpad(F.abs(exp).cast("string"), 2, "0"))
    return _render_with(d, exp, sci_s, p)


def _render_with(d: Column, exp: Column, sci_s: Column, p: int) -> Column:
    prec = F.greatest(F.lit(0), F.lit(p - 1) - exp)
    fmt = F.concat(F.lit("%."), prec.cast("string"), F.lit("f"))
    fixed = F.call_function("format_string", fmt, d)
    fixed_s = F.when(fixed.contains("."),
                     F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")).otherwise(fixed)
    return (F.when(d.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(d), F.lit("nan"))
            .when(d == F.lit(float("inf")), F.lit("inf"))
            .when(d == F.lit(float("-inf")), F.lit("-inf"))
            .when(d == 0, F.when(d.cast("string").startswith("-"), F.lit("-0")).otherwise(F.lit("0")))
            .when((exp >= -4) & (exp < p), fixed_s)
            .otherwise(sci_s))
