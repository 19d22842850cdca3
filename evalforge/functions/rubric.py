"""Prompt rendering (F1-F4) and the keyword-rubric difficulty index.

The rubric is a small data object (Y4: words, patterns, divisors and
weights can be overridden; Y5: languages and their weights).  It compiles
to plain Column expressions: ``lower(text)`` is projected once, then each
keyword is a ``contains`` (substring, as the reference tests ``w in t``) and
each pattern an ``rlike``; everything stays in one codegen stage.

Python's ``\\b``/``\\d`` are Unicode-aware; the patterns below spell the
word boundary as an explicit class (letters, digits, underscore) so Java
and RE2 agree with each other and with Python on accented text.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import SPACE

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (lists in their order).
CORRECTNESS_WORDS = (
    "edge case", "corner case", "validate", "invalid", "error handling", "robust", "safely",
    "thread-safe", "thread safe", "lock-free", "deadlock", "race", "atomic", "parse", "parser",
    "serialize", "deserialize", "json", "unicode", "overflow", "underflow", "null", "nullptr",
)
CORRECTNESS_PATTERN = r"\bconstraints?\b|\bguarantee\b|\bmust\b|\bshould\b"
QUALITY_WORDS = (
    "clean", "readable", "well-structured", "well structured", "maintainable", "refactor",
    "design pattern", "singleton", "raii", "interface", "abstraction", "encapsulation", "modular",
    "unit test", "tests",
)
QUALITY_ANY = ("class ", "api", "library", "module")
EFFICIENCY_WORDS = (
    "efficient", "optimize", "performance", "fast", "low latency", "high throughput", "big-o", "o(",
    "time complexity", "space complexity", "memory", "constant time", "log n", "n log n", "linear time",
)
EFFICIENCY_PATTERNS = (
    r"\b\d+\s*(ms|seconds|s)\b",
    r"\b\d+\s*(items|elements|rows|cols|nodes)\b|\bup to\b",
)
DOCUMENTATION_WORDS = (
    "document", "documentation", "docstring", "comments", "commented", "well-documented",
    "well documented", "explain", "explanation", "examples",
)
DIVISORS = (6.0, 6.0, 6.0, 4.0)                 # correctness, quality, efficiency, documentation
WEIGHTS = (0.3, 0.3, 0.2, 0.2)                  # same order
LANGUAGE_WEIGHTS = {"cpp": 1.10, "c++": 1.10, "rust": 1.15}   # others 1.00
INDEX_DEMAND_FACTOR = 0.75                      # index = len * weight * (1 + 0.75 * demand)
TIER_HIGH = 0.7                                 # F15: > 0.7 high, 0.4..0.7 medium, < 0.4 low
TIER_LOW = 0.4
# ---------------------------------------------------------------------------

_WORD = r"[\p{L}\p{N}_]"
_NONWORD = r"[^\p{L}\p{N}_]"


def portable_regex(py_pattern: str) -> str:
    """Rewrite Python's ``\\b``, ``\\d`` and ``\\s`` into explicit Unicode classes
    understood identically by Java (Spark) and RE2 (DuckDB).  A ``\\b``
    before a word character becomes ``(^|nonword)``, after one ``($|nonword)``;
    the patterns here only use ``\\b`` at word edges, which makes this exact
    for an existence test."""
    out = []
    i = 0
    s = py_pattern
    while i < len(s):
        if s.startswith(r"\b", i):
            prev = s[i - 1] if i > 0 else ""
            # boundary closes a word if the previous token is a word char, ')' or '?'
            closing = prev not in ("", "|", "(")
            out.append(f"($|{_NONWORD})" if closing else f"(^|{_NONWORD})")
            i += 2
        elif s.startswith(r"\d", i):
            out.append(r"\p{Nd}")
            i += 2
        elif s.startswith(r"\s", i):
            out.append(SPACE)
            i += 2
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rubric:
    correctness_words: tuple = CORRECTNESS_WORDS
    correctness_patterns: tuple = (CORRECTNESS_PATTERN,)
    quality_words: tuple = QUALITY_WORDS
    quality_any: tuple = QUALITY_ANY
    efficiency_words: tuple = EFFICIENCY_WORDS
    efficiency_patterns: tuple = EFFICIENCY_PATTERNS
    documentation_words: tuple = DOCUMENTATION_WORDS
    divisors: tuple = DIVISORS
    weights: tuple = WEIGHTS
    language_weights: dict = field(default_factory=lambda: dict(LANGUAGE_WEIGHTS))
    default_language: str = "python"

    def with_overrides(self, **kw) -> "Rubric":
        return replace(self, **kw)


DEFAULT_RUBRIC = Rubric()


def _count_words(t: Column, words) -> Column:
    acc = F.lit(0)
    for w in dict.fromkeys(words):          # distinct words, each counted once
        acc = acc + t.contains(w).cast("int")
    return acc


# Cheap necessary conditions for the fixed patterns: the regex only runs on
# texts that contain one of these substrings (or a digit), so the common
# case costs a few substring scans instead of a backtracking regex pass.
_GUARDS = {
    CORRECTNESS_PATTERN: ("constraint", "guarantee", "must", "should"),
    EFFICIENCY_PATTERNS[0]: None,          # needs a digit
    EFFICIENCY_PATTERNS[1]: ("items", "elements", "rows", "cols", "nodes", "up to"),
}


def _guard(t: Column, pattern: str) -> Column | None:
    if pattern not in _GUARDS:
        return None
    words = _GUARDS[pattern]
    if words is None:
        return t.rlike(r"\p{Nd}")
    g = F.lit(False)
    for w in words:
        g = g | t.contains(w)
    return g


def _count_patterns(t: Column, patterns) -> Column:
    acc = F.lit(0)
    for p in patterns:
        hit = t.rlike(portable_regex(p))
        g = _guard(t, p)
        if g is not None:
            hit = F.when(g, hit).otherwise(F.lit(False))
        acc = acc + hit.cast("int")
    return acc


def rubric_components(lowered: Column, rubric: Rubric = DEFAULT_RUBRIC) -> dict[str, Column]:
    """F8-F12 on an already lower-cased text column."""
    t = lowered
    corr = _count_words(t, rubric.correctness_words) + _count_patterns(t, rubric.correctness_patterns)
    any_q = F.lit(False)
    for w in rubric.quality_any:
        any_q = any_q | t.contains(w)
    qual = _count_words(t, rubric.quality_words) + any_q.cast("int")
    eff = _count_words(t, rubric.efficiency_words) + _count_patterns(t, rubric.efficiency_patterns)
    doc = _count_words(t, rubric.documentation_words)
    d = rubric.divisors
    comps = {
        "demand_correctness": F.least(F.lit(1.0), corr / F.lit(d[0])),
        "demand_code_quality": F.least(F.lit(1.0), qual / F.lit(d[1])),
        "demand_efficiency": F.least(F.lit(1.0), eff / F.lit(d[2])),
        "demand_documentation": F.least(F.lit(1.0), doc / F.lit(d[3])),
    }
    return comps


def language_weight(lang_lower: Column, rubric: Rubric = DEFAULT_RUBRIC) -> Column:
    """F13 (Y5: the weight map is a parameter)."""
    out = None
    for lg, wt in rubric.language_weights.items():
        out = (F.when(lang_lower == lg, F.lit(float(wt))) if out is None
               else out.when(lang_lower == lg, F.lit(float(wt))))
    return F.lit(1.0) if out is None else out.otherwise(F.lit(1.0))


def difficulty_columns(prompt: Column, language: Column, token_len: Column | None = None,
                       rubric: Rubric = DEFAULT_RUBRIC) -> list[Column]:
    """F5-F14 as nine named columns (T4).  ``token_len`` comes from a
    tokenizer plug-in (F6); without one it is 0 and the length proxy is the
    character count."""
    p = F.coalesce(prompt, F.lit(""))
    lg = F.lower(F.coalesce(F.nullif(language, F.lit("")), F.lit(rubric.default_language)))
    comps = rubric_components(F.lower(p), rubric)
    w = rubric.weights
    demand_raw = ((F.lit(w[0]) * comps["demand_correctness"]) + (F.lit(w[1]) * comps["demand_code_quality"])
                  + (F.lit(w[2]) * comps["demand_efficiency"]) + (F.lit(w[3]) * comps["demand_documentation"]))
    demand = F.least(F.lit(1.0), F.greatest(F.lit(0.0), demand_raw))
    tok = (token_len if token_len is not None else F.lit(0.0)).cast("double")
    chars = F.length(p).cast("double")
    proxy = F.when(tok > 0, tok).otherwise(chars)
    lw = language_weight(lg, rubric)
    index = proxy * lw * (F.lit(1.0) + F.lit(INDEX_DEMAND_FACTOR) * demand)
    return [tok.alias("token_len"), chars.alias("char_len"), lw.alias("lang_weight"),
            demand.alias("rubric_demand"),
            comps["demand_correctness"].alias("demand_correctness"),
            comps["demand_code_quality"].alias("demand_code_quality"),
            comps["demand_efficiency"].alias("demand_efficiency"),
            comps["demand_documentation"].alias("demand_documentation"),
            index.alias("index")]


def difficulty_struct(prompt: Column, language: Column, token_len: Column | None = None,
                      rubric: Rubric = DEFAULT_RUBRIC) -> Column:
    """T4 as one STRUCT column."""
    return F.struct(*difficulty_columns(prompt, language, token_len, rubric))


def tier(x: Column) -> Column:
    """high > 0.7, medium 0.4..0.7 (both ends inclusive), low < 0.4; NULL has no tier."""
    return (F.when(x > F.lit(TIER_HIGH), F.lit("high")).when(x >= F.lit(TIER_LOW), F.lit("medium"))
            .when(x.isNotNull(), F.lit("low")))


# --------------------------- prompt rendering -------------------------------

def eval_prompt(prompt: Column, language: Column) -> Column:
    """evaluation form."""
    return F.concat(F.lit("Write high-quality "), language, F.lit(" code:\n\n"), prompt, F.lit("\n\nCode:"))


_REASONING_HEAD = " code. Think through the problem step by step before writing the code.\n\nProblem: "
_REASONING_STEPS = ("\n\nLet's think through this step by step:\n1. What are the requirements?\n"
                    "2. What edge cases should we consider?\n3. What's the best approach?\n"
                    "4. How can we implement it efficiently?\n\nNow write the code:")


def eval_reasoning_prompt(prompt: Column, language: Column) -> Column:
    """reasoning preamble ending in an open fence for the language."""
    return F.concat(F.lit("Write high-quality "), language, F.lit(_REASONING_HEAD), prompt,
                    F.lit(_REASONING_STEPS), F.lit("\n\n```"), language, F.lit("\n"))


def inference_prompt(prompt: Column, language: Column) -> Column:
    """system line + prompt + instruction."""
    return F.concat(F.lit("You are an expert "), language,
                    F.lit(" programmer. Generate clean, efficient, and well-documented code.\n\n"),
                    prompt, F.lit("\n\nGenerate high-quality "), language, F.lit(" code:"))


def inference_reasoning_prompt(prompt: Column, language: Column) -> Column:
    """as F2 without the open fence."""
    return F.concat(F.lit("Write high-quality "), language, F.lit(_REASONING_HEAD), prompt,
                    F.lit(_REASONING_STEPS))
