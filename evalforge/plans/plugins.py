"""Plug-in queries: batch generation with a stub model, pluggable scorer,
custom reward, tokenizer-based difficulty, repetition cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.extract import extract_code_from_reasoning
from ..functions.rubric import difficulty_columns, eval_prompt
from ..functions.repetition import first_code_block, repetition_cut
from ..functions.scoring import heuristic_score
from ..functions.unicode import SPACE
from ..operators.scorecache import new_cache, refresh
from ..operators.plugins import StubGenerator, apply_reward, generate_batch, python_scorer, score_column, token_length
from .corpus import LANG_MAP_SQL, prompt_language
from .registry import query, r6
from .scoring import h_sql
from .sqlgen import difficulty_sql
from .tables import table
from .text import first_block_sql

GEN_TEXT_SQL = ("'```' || language || chr(10) || 'def solve():' || chr(10) || '    return ' || CAST(length(text) AS VARCHAR)"
                " || chr(10) || '```' || chr(10) || replace(text, 'a', '4')")
WORDS_SQL = "len(string_split_regex(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '))"


def _prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return d.select("doc_id", F.col("text").alias("prompt"), prompt_language(F.col("lang")).alias("language"))


@query("batch_generate", sql=f"""
SELECT doc_id, 'def solve():' || chr(10) || '    return ' || CAST(length(text) AS VARCHAR) AS code,
       CAST({WORDS_SQL.format(x=GEN_TEXT_SQL)} AS BIGINT) AS output_tokens,
       round(length(text) / 1000.0, 6) AS seconds, true AS ok
FROM (SELECT doc_id, text, {LANG_MAP_SQL} AS language FROM documents)""")
def batch_generate(spark, sf_dir):
    """Y1 + F22: generate per prompt (model built once per partition), then
    pull the code out of the generated text."""
    g = generate_batch(_prompts(spark, sf_dir), StubGenerator, ["doc_id", "language"], checkpoint=True)
    return g.select("doc_id", extract_code_from_reasoning(F.col("code"), F.col("language")).alias("code"),
                    "output_tokens", r6("seconds"), "ok")


@query("batch_score", sql=f"""
SELECT doc_id, round({h_sql('text')}, 6) AS plugin_score, round({h_sql('text')}, 6) AS fallback_score FROM documents""")
def batch_score(spark, sf_dir):
    """Y2: a Python scorer plug-in and the built-in fallback agree."""
    d = _prompts(spark, sf_dir)
    return d.select("doc_id",
                    r6(score_column(F.col("prompt"), F.col("prompt"), F.col("language"), python_scorer()),
                       "plugin_score"),
                    r6(score_column(F.col("prompt"), F.col("prompt"), F.col("language")), "fallback_score"))


@query("custom_reward", sql=f"SELECT doc_id, round(sqrt({h_sql('text')}) * 0.9, 6) AS reward FROM documents")
def custom_reward(spark, sf_dir):
    """A caller-supplied reward expression."""
    d = _prompts(spark, sf_dir).withColumn("score", score_column(F.col("prompt"), F.col("prompt"), F.col("language")))
    return apply_reward(d, lambda s: F.sqrt(s) * F.lit(0.9)).select("doc_id", r6("reward"))


_FORMATTED_SQL = "'Write high-quality ' || lower(coalesce(nullif(language, ''), 'python')) || ' code:' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Code:'"


def _token_sql():
    d = difficulty_sql("text", "language")
    tok = f"CAST({WORDS_SQL.format(x=_FORMATTED_SQL)} AS DOUBLE)"
    chars = d["char_len"]
    proxy = f"(CASE WHEN {tok} > 0 THEN {tok} ELSE {chars} END)"
    index = f"{proxy} * ({d['lang_weight']}) * (1.0 + 0.75 * {d['rubric_demand']})"
    return tok, index


_TOK, _IDX = _token_sql()


@query("token_length", sql=f"""
SELECT doc_id, round({_TOK}, 6) AS token_len, round({_IDX}, 6) AS index
FROM (SELECT doc_id, text, {LANG_MAP_SQL} AS language FROM documents)""")
def token_length_q(spark, sf_dir):
    """Token length of the *formatted* prompt from a tokenizer
    plug-in; it replaces the character count in the difficulty index."""
    d = _prompts(spark, sf_dir)
    lg = F.lower(F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("python")))
    formatted = eval_prompt(F.coalesce(F.col("prompt"), F.lit("")), lg)
    d = d.withColumn("token_len", token_length(formatted).cast("double"))
    cols = difficulty_columns(F.col("prompt"), F.col("language"), token_len=F.col("token_len"))
    out = d.select("doc_id", *cols)
    return out.select("doc_id", r6("token_len"), r6("index"))


# Conversation messages rendered as unfenced code, one rule of F24 each by turn: a class that
# comes again, a fence followed by a known name, a burst of definitions past line 200.
_CODE_SQL = """
code AS (
  SELECT conv_id, turn, CASE turn % 3
    WHEN 0 THEN 'class Widget {' || nl || body || nl || '};' || nl || 'class Widget {' || nl || '  int again;' || nl || '};'
    WHEN 1 THEN 'struct Gadget {' || nl || body || nl || '```' || nl || 'and' || nl || 'Gadget' || nl || 'again' || nl || 'void f(int a)'
    ELSE 'T first(' || nl || body || nl || body || nl || body || nl || '```x' || nl || 'class A {' || nl || 'struct B {' || nl
         || 'class C {' || nl || '}' || nl || '}' || nl || 'T first(x)' END AS t
  FROM (SELECT conv_id, turn, chr(10) AS nl,
               array_to_string(list_transform(string_split(text, ' '), lambda w: '  int ' || w || ';'), chr(10)) AS body
        FROM conversations))"""


def _code(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    body = F.array_join(F.transform(F.split(F.col("text"), " "), lambda w: F.concat(F.lit("  int "), w, F.lit(";"))), "\n")
    k, line = F.col("turn") % 3, lambda *xs: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in xs])
    t = (F.when(k == 0, line("class Widget {", body, "};", "class Widget {", "  int again;", "};"))
         .when(k == 1, line("struct Gadget {", body, "```", "and", "Gadget", "again", "void f(int a)"))
         .otherwise(line("T first(", body, body, body, "```x", "class A {", "struct B {", "class C {", "}", "}", "T first(x)")))
    return c.select("conv_id", "turn", t.alias("t"))


def _cut_sql(source: str) -> str:
    """F24 by line rows: ``cut`` (conv_id, turn, t, kept) for the rows of ``source``."""
    strip = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    name = f"'(?:class|struct|template){SPACE}+([\\pL\\pN_]+)'"
    return f"""
ls AS (SELECT conv_id, turn, t, string_split(t, chr(10)) AS a FROM {source}),
ln AS (SELECT conv_id, turn, len(a) AS n, a, unnest(range(len(a))) AS i FROM ls),
st AS (SELECT *, {strip('a[i + 1]')} AS s FROM ln),
sg AS (
  SELECT *, CASE WHEN contains(s, 'template') OR contains(s, 'class ') OR contains(s, 'struct ')
                 THEN CASE WHEN regexp_matches(s, {name}) THEN regexp_extract(s, {name}, 1) END
                 WHEN starts_with(s, 'int main') OR starts_with(s, 'void ') OR starts_with(s, 'bool ') OR starts_with(s, 'T ')
                 THEN string_split(s, '(')[1] END AS sig
  FROM st),
names AS (SELECT conv_id, turn, sig, min(i) AS born FROM sg WHERE sig IS NOT NULL GROUP BY ALL),
hits AS (
  SELECT sg.conv_id, sg.turn, i FROM sg JOIN names USING (conv_id, turn, sig) WHERE i > 50 AND i > born
  UNION ALL
  SELECT sg.conv_id, sg.turn, i FROM sg JOIN names USING (conv_id, turn)
  WHERE starts_with(s, '```') AND i > 30 AND i + 3 < n AND born < i
    AND contains(array_to_string(a[i + 2:i + 4], chr(10)), names.sig)
  UNION ALL
  SELECT conv_id, turn, i FROM sg
  WHERE i > 200 AND contains(s, '```') AND i + 5 < n
    AND len(regexp_extract_all(array_to_string(a[i + 1:i + 6], chr(10)), '(?:class|struct|template|int main)')) > 2),
first_hit AS (SELECT conv_id, turn, min(i) AS i FROM hits GROUP BY ALL),
cut AS (SELECT conv_id, turn, t, {strip('array_to_string(a[1:coalesce(i, len(a))], chr(10))')} AS kept
        FROM ls LEFT JOIN first_hit USING (conv_id, turn))"""


@query("repetition_cut", sql=f"""
WITH {_CODE_SQL}, {_cut_sql('code')}
SELECT conv_id, turn, len(string_split(t, chr(10))) AS lines_in, len(string_split(kept, chr(10))) AS lines_out,
       md5(kept) AS cut_md5 FROM cut""")
def repetition_cut_q(spark, sf_dir):
    """F24 over unfenced code."""
    c = _code(spark, sf_dir)
    cut = c.select("conv_id", "turn", "t", repetition_cut(F.col("t")).alias("kept"))
    return cut.select("conv_id", "turn", F.size(F.split("t", "\n")).cast("long").alias("lines_in"),
                      F.size(F.split("kept", "\n")).cast("long").alias("lines_out"), F.md5("kept").alias("cut_md5"))


@query("first_code_block", sql=f"""
WITH {_CODE_SQL},
msgs AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Intro' || chr(10) || '```python' || chr(10) || t || chr(10) || '```' || chr(10)
                || 'tail' ELSE t END AS t FROM code),
{_cut_sql("msgs")}
SELECT conv_id, turn, md5(CASE WHEN t = '' THEN t ELSE coalesce({first_block_sql('t')}, kept) END) AS block_md5 FROM cut""")
def first_code_block_q(spark, sf_dir):
    """F23 complete: the first fenced block, else the cut of F24."""
    c = _code(spark, sf_dir)
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Intro\n```python\n"), "t", F.lit("\n```\ntail"))).otherwise(F.col("t"))
    return c.select("conv_id", "turn", F.md5(first_code_block(t)).alias("block_md5"))


@query("score_cache_runs", sql=f"""
WITH k AS (
  SELECT text, {LANG_MAP_SQL} AS language, bool_or(no % 2 = 0) AS first, bool_or(no % 3 = 0) AS second
  FROM (SELECT *, coalesce(try_cast(substr(source, 4) AS INTEGER), 1) AS no FROM documents)
  WHERE text IS NOT NULL AND {LANG_MAP_SQL} IS NOT NULL GROUP BY ALL),
s AS (SELECT *, {h_sql("text")} AS score FROM k),
r AS (
  SELECT 1 AS run, 'missing' AS state, score FROM s WHERE first
  UNION ALL SELECT 2, CASE WHEN first THEN 'hit' ELSE 'missing' END, score FROM s WHERE second
  UNION ALL SELECT 3, CASE WHEN first THEN 'expired' WHEN second THEN 'hit' ELSE 'missing' END, score FROM s)
SELECT run, state, count(*) AS num_keys, round(avg(score), 6) AS avg_score FROM r GROUP BY run, state""")
def score_cache_runs(spark, sf_dir):
    """J1-J3 + W16 over a stored cache: three runs at 0, 10,000 and 14,400 seconds (even sources, every third source,
    all); each scores the keys that are new or expired and leaves the next version of the cache."""
    d = table(spark, sf_dir, "documents").select(
        F.col("text").alias("prompt"), prompt_language(F.col("lang")).alias("language"),
        F.coalesce(F.substring("source", 4, 9).try_cast("int"), F.lit(1)).alias("no"))
    cache, out = new_cache(spark), None
    for run, (now, which) in enumerate(((0, F.col("no") % 2 == 0), (10_000, F.col("no") % 3 == 0), (14_400, F.lit(True))), 1):
        scores, cache = refresh(d.where(which), cache, lambda prompt, language: heuristic_score(prompt), now)
        one = scores.groupBy("state").agg(F.count(F.lit(1)).alias("num_keys"), r6(F.avg("score"), "avg_score")).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return out.select("run", "state", "num_keys", "avg_score")
