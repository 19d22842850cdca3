"""Render each conversation as one ChatML transcript.

No window and no per-conversation sort of raw rows:
* every message renders to its own piece (narrow projection);
* assembly is two-level: pieces are joined per (conversation, chunk of turns),
  then the chunk strings per conversation, so a very long conversation is
  pre-aggregated in parallel before its final row is built;
* a run of tool messages shares one ``user`` block: inside the sorted array of a
  chunk a tool message looks at the role before and after it; at the ends of a
  chunk that is left to the same step over the array of chunks.  Texts are
  never searched for marks, so no text can open or close a turn by its content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values (the chat template's literals).
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOL_OPEN = "\n<tool_response>\n"
TOOL_CLOSE = "\n</tool_response>"

TOOLS_HEAD = ("\n\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with "
              "function signatures within <tools></tools> XML tags:\n<tools>")
TOOLS_TAIL = ("\n</tools>\n\nFor each function call, return a json object with function name and arguments within "
              "<tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": "
              "<args-json-object>}\n</tool_call><|im_end|>\n")

CHUNK_TURNS = 512


def _piece(role, text, tool_calls=None):
    content = F.coalesce(text, F.lit(""))
    out = F.when(role == "tool", F.concat(F.lit(TOOL_OPEN), content, F.lit(TOOL_CLOSE)))
    if tool_calls is not None:
        calls = F.array_join(F.transform(tool_calls, lambda c: F.concat(
            F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"],
            F.lit("}\n</tool_call>"))), "")
        with_calls = F.concat(F.lit(IM_START + "assistant"), F.when(content != "", F.concat(F.lit("\n"), content))
                              .otherwise(F.lit("")), calls, F.lit(IM_END + "\n"))
        out = out.when((role == "assistant") & tool_calls.isNotNull() & (F.size(tool_calls) > 0), with_calls)
    plain = F.concat(F.lit(IM_START), role, F.lit("\n"), content, F.lit(IM_END + "\n"))
    return out.when(role.isin("user", "system", "assistant"), plain).otherwise(F.lit(""))


def _joined(parts, ends: bool):
    """Bodies of sorted parts (first, last: whether they begin and end with a tool message) as one text; tool runs
    are opened and closed between parts, and with ``ends`` also at both ends."""
    open_, close = F.lit(IM_START + "user"), F.lit(IM_END + "\n")

    def one(x, i):
        before, after = F.get(parts, i - 1)["last"], F.get(parts, i + 1)["first"]
        opens = x["first"] & (F.coalesce(~before, F.lit(ends)))
        closes = x["last"] & (F.coalesce(~after, F.lit(ends)))
        return F.concat(F.when(opens, open_).otherwise(F.lit("")), x["body"], F.when(closes, close).otherwise(F.lit("")))
    return F.array_join(F.transform(parts, one), "")


def chat_transcripts(msgs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text", tool_calls_col: str | None = None,
                     add_generation_prompt: bool = False, tools: Sequence[str] = ()) -> DataFrame:
    """One row per conversation: (conv_id, num_messages, transcript).  ``tools``: JSON texts of the
    functions that the header offers."""
    tc = F.col(tool_calls_col) if tool_calls_col else None
    is_tool = F.coalesce(F.col(role_col) == "tool", F.lit(False))
    rows = msgs.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("at"), F.col(role_col).alias("role"),
                       F.col(text_col).alias("text"), is_tool.alias("first"), is_tool.alias("last"),
                       _piece(F.col(role_col), F.col(text_col), tc).alias("body"))
    chunks = (rows.groupBy("conv_id", F.floor(F.col("at") / CHUNK_TURNS).alias("chunk"))
              .agg(F.array_sort(F.collect_list(F.struct("at", "first", "last", "body"))).alias("parts"),
                   F.min_by(F.struct("role", "text", "body"), "at").alias("head"), F.count(F.lit(1)).alias("n"))
              .select("conv_id", F.col("chunk").alias("at"), F.get("parts", 0)["first"].alias("first"),
                      F.element_at("parts", -1)["last"].alias("last"), _joined(F.col("parts"), False).alias("body"),
                      "head", "n"))
    conv = (chunks.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("at", "first", "last", "body"))).alias("parts"),
                 F.min_by("head", "at").alias("head"), F.sum("n").alias("num_messages")))
    system = F.coalesce(F.col("head.role") == "system", F.lit(False))
    said = F.when(system, F.coalesce("head.text", F.lit(""))).otherwise(F.lit(DEFAULT_SYSTEM))
    end = TOOLS_HEAD + "".join("\n" + t for t in tools) + TOOLS_TAIL if tools else IM_END + "\n"
    header = F.concat(F.lit(IM_START + "system\n"), said, F.lit(end))
    body = _joined(F.col("parts"), True)
    rest = F.when(system, F.substring(body, F.length("head.body") + 1, F.length(body))).otherwise(body)
    suffix = F.lit(f"{IM_START}assistant\n" if add_generation_prompt else "")
    return conv.select("conv_id", F.col("num_messages").cast("long").alias("num_messages"),
                       F.concat(header, rest, suffix).alias("transcript"))
