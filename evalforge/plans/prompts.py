"""Prompt rendering, rubric difficulty and heuristic scores over driver tables.

Difficulty prompts are built from ``documents``: the catalog prompt chosen by
``doc_id`` position (15 prompts) followed by the whole document text, so the
rubric sees real keywords and the full text is processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import SAMPLE_PROMPTS
from ..functions.rubric import (DEFAULT_RUBRIC, difficulty_columns, eval_prompt, eval_reasoning_prompt,
                                inference_prompt, inference_reasoning_prompt, tier)
from ..functions.scoring import heuristic_score
from ..operators.ordering import global_position, stage_of
from .registry import query, r6
from .sqlgen import difficulty_sql, lit
from .tables import table

_LANGS = [lg for lg in SAMPLE_PROMPTS for _ in SAMPLE_PROMPTS[lg]]
_PROMPTS = [p for lg in SAMPLE_PROMPTS for p in SAMPLE_PROMPTS[lg]]
_SQL_LANGS = "[" + ", ".join(lit(x) for x in _LANGS) + "]"
_SQL_PROMPTS = "[" + ", ".join(lit(x) for x in _PROMPTS) + "]"

DOC_PROMPTS_SQL = f"""
doc_prompts AS (
  SELECT doc_id, lang,
         {_SQL_PROMPTS}[CAST(doc_id % 15 + 1 AS BIGINT)] || '. ' || text AS prompt,
         {_SQL_LANGS}[CAST(doc_id % 15 + 1 AS BIGINT)] AS language
  FROM documents
)"""

D_COLS = ["token_len", "char_len", "lang_weight", "rubric_demand", "demand_correctness",
          "demand_code_quality", "demand_efficiency", "demand_documentation", "index"]


def doc_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    i = (F.col("doc_id") % 15 + 1).cast("int")
    return d.select("doc_id", "lang",
                    F.concat(F.element_at(F.array(*[F.lit(x) for x in _PROMPTS]), i), F.lit(". "),
                             F.col("text")).alias("prompt"),
                    F.element_at(F.array(*[F.lit(x) for x in _LANGS]), i).alias("language"))


def _difficulty_sql_select(rubric=DEFAULT_RUBRIC, prompt="prompt", language="language"):
    exprs = difficulty_sql(prompt, language, rubric)
    return ", ".join(f"round({exprs[c]}, 6) AS {c}" for c in D_COLS)


@query("prompt_forms", sql="""
SELECT p_partkey,
       'Write high-quality ' || lg || ' code:' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || 'Code:' AS eval_form,
       'Write high-quality ' || lg || ' code. Think through the problem step by step before writing the code.'
         || chr(10) || chr(10) || 'Problem: ' || p_name || chr(10) || chr(10)
         || 'Let''s think through this step by step:' || chr(10) || '1. What are the requirements?' || chr(10)
         || '2. What edge cases should we consider?' || chr(10) || '3. What''s the best approach?' || chr(10)
         || '4. How can we implement it efficiently?' || chr(10) || chr(10) || 'Now write the code:'
         || chr(10) || chr(10) || '```' || lg || chr(10) AS eval_reasoning_form,
       'You are an expert ' || lg || ' programmer. Generate clean, efficient, and well-documented code.'
         || chr(10) || chr(10) || p_name || chr(10) || chr(10) || 'Generate high-quality ' || lg || ' code:' AS inference_form,
       'Write high-quality ' || lg || ' code. Think through the problem step by step before writing the code.'
         || chr(10) || chr(10) || 'Problem: ' || p_name || chr(10) || chr(10)
         || 'Let''s think through this step by step:' || chr(10) || '1. What are the requirements?' || chr(10)
         || '2. What edge cases should we consider?' || chr(10) || '3. What''s the best approach?' || chr(10)
         || '4. How can we implement it efficiently?' || chr(10) || chr(10) || 'Now write the code:' AS inference_reasoning_form
FROM (SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' ELSE 'rust' END AS lg FROM part)""")
def prompt_forms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    lg = F.when(F.col("p_size") % 3 == 0, "python").when(F.col("p_size") % 3 == 1, "cpp").otherwise("rust")
    pr = F.col("p_name")
    return p.select("p_partkey", eval_prompt(pr, lg).alias("eval_form"),
                    eval_reasoning_prompt(pr, lg).alias("eval_reasoning_form"),
                    inference_prompt(pr, lg).alias("inference_form"),
                    inference_reasoning_prompt(pr, lg).alias("inference_reasoning_form"))


def _difficulty(spark, sf_dir, rubric=DEFAULT_RUBRIC, lang_col="language"):
    d = doc_prompts(spark, sf_dir)
    return d.select("doc_id", "lang", "language", *difficulty_columns(F.col("prompt"), F.col(lang_col),
                                                                      rubric=rubric))


@query("prompt_difficulty", sql=f"WITH {DOC_PROMPTS_SQL} SELECT doc_id, {_difficulty_sql_select()} FROM doc_prompts")
def prompt_difficulty(spark, sf_dir):
    return _difficulty(spark, sf_dir).select("doc_id", *[r6(c) for c in D_COLS])


_AVG_COLS = ["char_len", "rubric_demand", "demand_correctness", "demand_code_quality", "demand_efficiency",
             "demand_documentation", "index"]


@query("difficulty_by_language", sql=f"""
WITH {DOC_PROMPTS_SQL}, d AS (SELECT language, {_difficulty_sql_select()} FROM doc_prompts)
SELECT language, count(*) AS num_prompts, {", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in _AVG_COLS)}
FROM d GROUP BY language""")
def difficulty_by_language(spark, sf_dir):
    d = _difficulty(spark, sf_dir)
    return d.groupBy("language").agg(F.count(F.lit(1)).alias("num_prompts"),
                                     *[r6(F.avg(c), f"avg_{c}") for c in _AVG_COLS])


_TIER_COLS = ["demand_correctness", "demand_code_quality", "demand_efficiency", "demand_documentation",
              "rubric_demand"]


def _tier_sql(c):
    return f"CASE WHEN {c} > 0.7 THEN 'high' WHEN {c} >= 0.4 THEN 'medium' ELSE 'low' END AS {c}_tier"


@query("difficulty_tier", sql=f"""
WITH {DOC_PROMPTS_SQL}, d AS (SELECT doc_id, {_difficulty_sql_select()} FROM doc_prompts)
SELECT doc_id, {", ".join(_tier_sql(c) for c in _TIER_COLS)} FROM d""")
def difficulty_tier(spark, sf_dir):
    d = _difficulty(spark, sf_dir)
    return d.select("doc_id", *[tier(F.col(c)).alias(f"{c}_tier") for c in _TIER_COLS])


# A rubric whose words occur in the driver's prose (four languages).
CUSTOM_RUBRIC = DEFAULT_RUBRIC.with_overrides(
    correctness_words=("the", "and", "that"), correctness_patterns=(r"\bis\b",),
    quality_words=("der", "und", "ein"), quality_any=("sch",),
    efficiency_words=("le", "la", "des"), efficiency_patterns=(r"\b\d+\s*(ms|seconds|s)\b",),
    documentation_words=("el", "de", "que"), divisors=(3.0, 3.0, 3.0, 2.0), weights=(0.4, 0.2, 0.2, 0.2))


@query("custom_rubric", sql=f"""
SELECT doc_id, {_difficulty_sql_select(CUSTOM_RUBRIC, 'text', 'lang')} FROM documents""")
def custom_rubric(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cols = difficulty_columns(F.col("text"), F.col("lang"), rubric=CUSTOM_RUBRIC)
    return d.select("doc_id", *cols).select("doc_id", *[r6(c) for c in D_COLS])


# More languages with their own weights.
EXTRA_LANG_RUBRIC = DEFAULT_RUBRIC.with_overrides(
    language_weights={"cpp": 1.10, "c++": 1.10, "rust": 1.15, "javascript": 1.05, "java": 1.08})
_EXTRA_LANG_SQL = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'cpp' WHEN 'de' THEN 'rust' ELSE 'javascript' END"


@query("extra_language", sql=f"""
WITH {DOC_PROMPTS_SQL}, x AS (SELECT doc_id, prompt, {_EXTRA_LANG_SQL} AS xl FROM doc_prompts)
SELECT doc_id, xl AS language, {_difficulty_sql_select(EXTRA_LANG_RUBRIC, 'prompt', 'xl')} FROM x""")
def extra_language(spark, sf_dir):
    d = doc_prompts(spark, sf_dir)
    lg = (F.when(F.col("lang") == "en", "python").when(F.col("lang") == "fr", "cpp")
          .when(F.col("lang") == "de", "rust").otherwise("javascript"))
    d = d.withColumn("xl", lg)
    return d.select("doc_id", F.col("xl").alias("language"),
                    *difficulty_columns(F.col("prompt"), F.col("xl"), rubric=EXTRA_LANG_RUBRIC)) \
        .select("doc_id", "language", *[r6(c) for c in D_COLS])


@query("curriculum_order", sql=f"""
WITH {DOC_PROMPTS_SQL}, d AS (SELECT doc_id, {difficulty_sql('prompt', 'language')['index']} AS idx FROM doc_prompts)
SELECT doc_id, round(idx, 6) AS index, CAST(row_number() OVER (ORDER BY idx, doc_id) - 1 AS BIGINT) AS position,
       CAST(floor((row_number() OVER (ORDER BY idx, doc_id) - 1) * 4 / count(*) OVER ()) AS INTEGER) AS stage
FROM d""")
def curriculum_order(spark, sf_dir):
    """Easy prompts first by difficulty index (ties by ord), in 4 stages."""
    from ..session import cut_lineage
    # the rubric runs once: the (doc_id, index) pairs are checkpointed before
    # the count and the range sampling, which would otherwise recompute it
    d = cut_lineage(_difficulty(spark, sf_dir).select("doc_id", "index"))
    total = d.count()
    pos = global_position(d, [F.col("index").asc(), F.col("doc_id").asc()])
    return pos.select("doc_id", r6("index"), "position",
                      stage_of(F.col("position"), total, 4).alias("stage"))


@query("heuristic_score", sql="""
SELECT doc_id, CAST(round(s1, 6) AS DOUBLE) AS raw_score, CAST(round(s2, 6) AS DOUBLE) AS wrapped_score FROM (
  SELECT doc_id,
    least(1.0, 0.5 + CASE WHEN length(text) > 50 THEN 0.1 ELSE 0.0 END
      + CASE WHEN contains(text, 'def ') OR contains(text, 'class ') OR contains(text, 'fn ') THEN 0.2 ELSE 0.0 END
      + CASE WHEN contains(text, chr(10)) THEN 0.1 ELSE 0.0 END) AS s1,
    least(1.0, 0.5 + CASE WHEN length(w) > 50 THEN 0.1 ELSE 0.0 END
      + CASE WHEN contains(w, 'def ') OR contains(w, 'class ') OR contains(w, 'fn ') THEN 0.2 ELSE 0.0 END
      + CASE WHEN contains(w, chr(10)) THEN 0.1 ELSE 0.0 END) AS s2
  FROM (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'def f(): ' || text WHEN 'de' THEN 'fn main ' || text
                                    ELSE text END AS w FROM documents))""")
def heuristic_score_q(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    w = (F.when(F.col("lang") == "en", F.concat(F.lit("def f(): "), "text"))
         .when(F.col("lang") == "de", F.concat(F.lit("fn main "), "text")).otherwise(F.col("text")))
    return d.select("doc_id", r6(heuristic_score(F.col("text")), "raw_score"),
                    r6(heuristic_score(w), "wrapped_score"))
