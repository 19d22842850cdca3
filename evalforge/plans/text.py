"""Code extraction, prompt stripping and chat transcripts over ``conversations``.

The driver's texts hold no code fences, so each message is wrapped by a
fixed rule on ``turn`` (closed tagged fence, closed bare fence, open fence,
reasoning marker, plain) with the language fixed per conversation; the whole
message text is always inside the wrapper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import (THINKING_MARKERS, extract_code_from_reasoning, extraction_guard,
                                 first_fenced_block, strip_prompt_contained, strip_prompt_prefix)
from ..functions.unicode import SPACE, spelled
from ..operators.chat import chat_transcripts
from .registry import query
from .sqlgen import lit
from .tables import table

LANG_SQL = "CASE conv_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp' ELSE 'rust' END"
NL = "chr(10)"

WRAP_SQL = f"""
wrapped AS (
  SELECT conv_id, turn, lang, text,
    CASE turn % 5
      WHEN 0 THEN 'Let me think.' || {NL} || '```' || lang || {NL} || text || {NL} || '```' || {NL} || 'Done.'
      WHEN 1 THEN '```' || {NL} || text || {NL} || '```'
      WHEN 2 THEN '```' || lang || {NL} || text
      WHEN 3 THEN 'Plan first.' || {NL} || 'Code:' || {NL} || text
      ELSE text END AS t
  FROM (SELECT conv_id, turn, text, {LANG_SQL} AS lang FROM conversations)
)"""


def _lang():
    c = F.col("conv_id") % 3
    return F.when(c == 0, "python").when(c == 1, "cpp").otherwise("rust")


def wrapped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    lang = _lang()
    k = F.col("turn") % 5
    nl = F.lit("\n")
    t = (F.when(k == 0, F.concat(F.lit("Let me think.\n```"), lang, nl, F.col("text"), F.lit("\n```\nDone.")))
         .when(k == 1, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
         .when(k == 2, F.concat(F.lit("```"), lang, nl, F.col("text")))
         .when(k == 3, F.concat(F.lit("Plan first.\nCode:\n"), F.col("text")))
         .otherwise(F.col("text")))
    return c.select("conv_id", "turn", lang.alias("lang"), "text", t.alias("t"))


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _extract_sql(t: str, lang: str) -> str:
    esc = f"regexp_replace({lang}, '([\\x20-\\x2F\\x3A-\\x40\\x5B-\\x5E\\x60\\x7B-\\x7E])', '\\\\\\1', 'g')"
    pa = f"'(?s)```' || {esc} || '?{SPACE}*\\n(.*?)```'"
    pb = f"'(?s)```{SPACE}*\\n(.*?)```'"
    pc = f"'(?s)```' || {esc} || '?{SPACE}*\\n(.*)'"
    pd = f"'(?s)```{SPACE}*\\n(.*)'"
    tf = f"'(?m)```{SPACE}*$'"
    cc = f"regexp_replace({_strip_sql(f'regexp_extract({t}, {pc}, 1)')}, {tf}, '', 'g')"
    dc = f"regexp_replace({_strip_sql(f'regexp_extract({t}, {pd}, 1)')}, {tf}, '', 'g')"
    parts = [f"WHEN {t} IS NULL OR {t} = '' THEN {t}",
             f"WHEN regexp_matches({t}, {pa}) THEN {_strip_sql(f'regexp_extract({t}, {pa}, 1)')}",
             f"WHEN regexp_matches({t}, {pb}) THEN {_strip_sql(f'regexp_extract({t}, {pb}, 1)')}",
             f"WHEN regexp_matches({t}, {pc}) AND {cc} <> '' THEN {cc}",
             f"WHEN regexp_matches({t}, {pd}) AND {dc} <> '' THEN {dc}"]
    for m in map(spelled, THINKING_MARKERS):
        first = f"regexp_extract({t}, {lit('(?is)' + m + '(.*)')}, 1)"
        rest = f"regexp_replace({first}, {lit('(?i)' + m)}, chr(10), 'g')"
        code = _strip_sql(rest)
        code = f"regexp_replace({code}, '(?m)^```[\\pL\\pN_]*{SPACE}*\\n', '', 'g')"
        code = f"regexp_replace({code}, '(?m)\\n```{SPACE}*$', '', 'g')"
        parts.append(f"WHEN regexp_matches({t}, {lit('(?i)' + m)}) AND {code} <> '' THEN {code}")
    return "CASE " + " ".join(parts) + f" ELSE {_strip_sql(t)} END"


@query("extract_code", sql=f"""
WITH {WRAP_SQL}, e AS (SELECT conv_id, turn, t, {_extract_sql('t', 'lang')} AS code FROM wrapped)
SELECT conv_id, turn, code,
       CASE WHEN code IS NOT NULL AND {_strip_sql('code')} <> '' AND code <> t THEN code ELSE t END AS guarded
FROM e""")
def extract_code(spark, sf_dir):
    w = wrapped_messages(spark, sf_dir)
    code = extract_code_from_reasoning(F.col("t"), F.col("lang"))
    return (w.select("conv_id", "turn", "t", code.alias("code"))
            .select("conv_id", "turn", "code", extraction_guard(F.col("t"), F.col("code")).alias("guarded")))


FB_WRAP_SQL = f"""
fb AS (
  SELECT conv_id, turn,
    CASE turn % 3
      WHEN 0 THEN 'Intro' || {NL} || '```python' || {NL} || text || {NL} || '```' || {NL} || 'tail'
      WHEN 1 THEN '```rust' || {NL} || text || {NL} || '```' || {NL} || '```rust' || {NL} || 'again' || {NL} || '```'
      ELSE text END AS t
  FROM conversations
)"""


def first_block_sql(t: str) -> str:
    p = f"'(?s)^(.*?```{SPACE}*([\\pL\\pN_]+)?{SPACE}*\\n.*?\\n{SPACE}*```)'"
    return f"CASE WHEN regexp_matches({t}, {p}) THEN {_strip_sql(f'regexp_extract({t}, {p}, 1)')} END"


@query("first_block", sql=f"""
WITH {FB_WRAP_SQL}
SELECT conv_id, turn,
  {first_block_sql('t')} AS block
FROM fb""")
def first_block(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    k = F.col("turn") % 3
    t = (F.when(k == 0, F.concat(F.lit("Intro\n```python\n"), "text", F.lit("\n```\ntail")))
         .when(k == 1, F.concat(F.lit("```rust\n"), "text", F.lit("\n```\n```rust\nagain\n```")))
         .otherwise(F.col("text")))
    return c.select("conv_id", "turn", first_fenced_block(t).alias("block"))


PROMPT_SQL = f"""
pr AS (
  SELECT conv_id, turn, text,
         'Write high-quality ' || ({LANG_SQL}) || ' code:' || {NL} || {NL} || 'Task ' || CAST(conv_id AS VARCHAR)
           || {NL} || {NL} || 'Code:' AS prompt
  FROM conversations
)"""


def _prompted(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    prompt = F.concat(F.lit("Write high-quality "), _lang(), F.lit(" code:\n\nTask "),
                      F.col("conv_id").cast("string"), F.lit("\n\nCode:"))
    return c.withColumn("prompt", prompt)


@query("strip_prompt_prefix", sql=f"""
WITH {PROMPT_SQL}, o AS (
  SELECT conv_id, turn, prompt, CASE WHEN turn % 2 = 0 THEN prompt || {NL} || text ELSE text END AS out FROM pr)
SELECT conv_id, turn,
       CASE WHEN starts_with(out, prompt) THEN {_strip_sql('substr(out, length(prompt) + 1)')} ELSE out END AS code
FROM o""")
def strip_prompt_prefix_q(spark, sf_dir):
    p = _prompted(spark, sf_dir)
    out = F.when(F.col("turn") % 2 == 0, F.concat("prompt", F.lit("\n"), "text")).otherwise(F.col("text"))
    return p.select("conv_id", "turn", strip_prompt_prefix(out, F.col("prompt")).alias("code"))


@query("strip_prompt_contains", sql=f"""
WITH {PROMPT_SQL}, o AS (
  SELECT conv_id, turn, prompt,
         CASE turn % 3 WHEN 0 THEN 'echo: ' || prompt || ' ' || text WHEN 1 THEN text ELSE prompt || text END AS out
  FROM pr)
SELECT conv_id, turn,
       CASE WHEN instr(out, prompt) > 0 THEN {_strip_sql('substr(out, instr(out, prompt) + length(prompt))')}
            ELSE {_strip_sql('out')} END AS code,
       CASE WHEN instr(out, prompt) > 0 THEN {_strip_sql('substr(out, instr(out, prompt) + length(prompt))')}
            ELSE out END AS code_unstripped
FROM o""")
def strip_prompt_contains_q(spark, sf_dir):
    p = _prompted(spark, sf_dir)
    k = F.col("turn") % 3
    out = (F.when(k == 0, F.concat(F.lit("echo: "), "prompt", F.lit(" "), "text"))
           .when(k == 1, F.col("text")).otherwise(F.concat("prompt", "text")))
    return p.select("conv_id", "turn", strip_prompt_contained(out, F.col("prompt")).alias("code"),
                    strip_prompt_contained(out, F.col("prompt"), strip_unmatched=False).alias("code_unstripped"))


# Tool turns by rule: turns 3 and 4 of five are tool replies, turn 2 of five an assistant turn with two calls.
CHAT_SQL = f"""
m AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, turn % 5 = 2 AS calls,
         CASE WHEN turn % 5 IN (3, 4) THEN 'tool' WHEN turn % 5 = 2 THEN 'assistant' ELSE role END AS role
  FROM conversations),
w AS (SELECT *, lag(role) OVER c AS before, lead(role) OVER c AS after, first_value(role) OVER c AS head_role,
             first_value(text) OVER c AS head_text, row_number() OVER c AS k FROM m WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
p AS (
  SELECT conv_id, turn, k, head_role, head_text, CASE
    WHEN k = 1 AND role = 'system' THEN ''
    WHEN role = 'tool' THEN CASE WHEN before IS DISTINCT FROM 'tool' THEN '<|im_start|>user' ELSE '' END
         || {NL} || '<tool_response>' || {NL} || text || {NL} || '</tool_response>'
         || CASE WHEN after IS DISTINCT FROM 'tool' THEN '<|im_end|>' || {NL} ELSE '' END
    WHEN calls THEN '<|im_start|>assistant' || CASE WHEN text <> '' THEN {NL} || text ELSE '' END
         || {NL} || '<tool_call>' || {NL} || '{{"name": "look", "arguments": {{"turn": ' || CAST(turn AS VARCHAR) || '}}}}' || {NL} || '</tool_call>'
         || {NL} || '<tool_call>' || {NL} || '{{"name": "note", "arguments": {{}}}}' || {NL} || '</tool_call>' || '<|im_end|>' || {NL}
    WHEN role IN ('user', 'system', 'assistant') THEN '<|im_start|>' || role || {NL} || text || '<|im_end|>' || {NL}
    ELSE '' END AS piece
  FROM w),
t AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS num_messages, string_agg(piece, '' ORDER BY turn) AS body,
         '<|im_start|>system' || {NL} || CASE WHEN any_value(head_role) = 'system' THEN any_value(head_text)
             ELSE 'You are Qwen, created by Alibaba Cloud. You are a helpful assistant.' END AS head
  FROM p GROUP BY conv_id)"""
CHAT_TOOLS = ('{"type": "function", "function": {"name": "look"}}', '{"type": "function", "function": {"name": "note"}}')


@query("chat_transcript", sql=f"""WITH {CHAT_SQL}
SELECT conv_id, num_messages, head || '<|im_end|>' || {NL} || body AS transcript,
  md5(head || {NL} || {NL} || '# Tools' || {NL} || {NL}
    || 'You may call one or more functions to assist with the user query.' || {NL} || {NL}
    || 'You are provided with function signatures within <tools></tools> XML tags:' || {NL} || '<tools>' || {NL}
    || '{CHAT_TOOLS[0]}' || {NL} || '{CHAT_TOOLS[1]}' || {NL} || '</tools>' || {NL} || {NL}
    || 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:'
    || {NL} || '<tool_call>' || {NL} || '{{"name": <function-name>, "arguments": <args-json-object>}}' || {NL} || '</tool_call><|im_end|>'
    || {NL} || body || '<|im_start|>assistant' || {NL}) AS with_tools_md5
FROM t""")
def chat_transcript(spark, sf_dir):
    """Transcripts with tool turns and calls; the form with a tools header and generation prompt as its hash."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    k = F.col("turn") % 5
    call = lambda name, args: F.struct(F.lit(name).alias("name"), args.alias("arguments"))
    calls = F.when(k == 2, F.array(call("look", F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}"))),
                                   call("note", F.lit("{}"))))
    m = c.select("conv_id", "turn", "text", F.when(k.isin(3, 4), "tool").when(k == 2, "assistant").otherwise(F.col("role")).alias("role"),
                 calls.alias("calls"))
    plain = chat_transcripts(m, tool_calls_col="calls")
    tools = chat_transcripts(m, tool_calls_col="calls", add_generation_prompt=True, tools=CHAT_TOOLS)
    return plain.join(tools.select("conv_id", F.md5("transcript").alias("with_tools_md5")), "conv_id")
