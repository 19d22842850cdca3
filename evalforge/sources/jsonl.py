"""JSON Lines sources (S1-S5, S7) and sinks.

Lines are read as text and parsed by ``from_json`` with an explicit schema,
so a bad line never fails the job (S1) unless asked to (S3).  The line
order the reference relies on is kept as ``ord``, one sortable struct: place of
the split in its list, file path, block start, place of the line in the block.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType
from pyspark.errors import AnalysisException

from ..functions.catalog import DEFAULT_EVAL_PROMPTS
from ..functions.unicode import SPACE
from ..operators.corpus import SPLITS

BLANK = rf"^{SPACE}*$"

PROMPT_SCHEMA = "prompt STRING, language STRING, id STRING"

# Batch summary line; T10: epoch summary line (nested, two levels).
BATCH_LOG_SCHEMA = (
    "run_id BIGINT, ts_iso STRING, epoch INT, batch_idx INT, global_step INT, batch_size BIGINT, "
    "generation_backend STRING, "
    "timing_s STRUCT<generation: DOUBLE, scoring: DOUBLE, training: DOUBLE, total: DOUBLE>, "
    "tokens STRUCT<gen_raw: BIGINT, gen_kept: BIGINT>, "
    "throughput_tok_s STRUCT<gen_raw_overall: DOUBLE, gen_kept_overall: DOUBLE, training: DOUBLE>, "
    "samples STRUCT<dup_filtered: BIGINT, diversity_ratio: DOUBLE>, rewards STRUCT<mean: DOUBLE>, "
    "reward_gain STRUCT<gain_from_baseline: DOUBLE, gain_vs_prev_batch: DOUBLE, ema_reward: DOUBLE, "
    "ema_gain_from_baseline: DOUBLE>, loss STRUCT<loss: DOUBLE>")
EPOCH_LOG_SCHEMA = (
    "ts_iso STRING, epoch INT, generation_backend STRING, epoch_time_s DOUBLE, avg_reward DOUBLE, "
    "avg_loss DOUBLE, reward_trend DOUBLE, loss_trend DOUBLE, api STRUCT<calls: BIGINT, cache_hit_rate: DOUBLE>, "
    "diversity STRUCT<unique_ratio: DOUBLE>, "
    "performance STRUCT<generation: STRUCT<tok_s_raw: DOUBLE, tok_s_kept: DOUBLE>, training: STRUCT<tok_s: DOUBLE>>")


ORD_SCHEMA = (StructType().add("split", IntegerType()).add("file", StringType()).add("start", LongType())
              .add("pos", LongType()))


def _lines(spark: SparkSession, path: str, split: int = 0) -> DataFrame | None:
    """Lines with their order; None if the path does not exist (any other fault is raised)."""
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    # a file's blocks are read by one task each, in order: file, block start, place within the block
    return raw.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.struct(F.lit(split).alias("split"), F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.file_block_start").alias("start"),
                 F.monotonically_increasing_id().alias("pos")).alias("ord"))


def _empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def tag_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, with the ``reason`` why a line is no JSON object (null for those that are)."""
    nonblank = lines.where(~F.col("line").rlike(BLANK))
    keys = F.json_object_keys(F.col("line"))
    is_obj = keys.isNotNull()
    looks_json = F.col("line").rlike("^" + SPACE + r"*(\{|\[|\"|-?[0-9]|true|false|null)")
    parsed_any = F.call_function("try_parse_json", F.col("line")).isNotNull() | is_obj
    reason = (F.when(is_obj, F.lit(None).cast("string"))
              .when(parsed_any & looks_json, F.lit("not_an_object"))
              .otherwise(F.lit("invalid_json")))
    return nonblank.withColumn("reason", reason)


def _fault(line: str) -> str:
    """The JSON parser's message for a line that is no object."""
    try:
        return f"a JSON {type(json.loads(line)).__name__} in place of an object"
    except (ValueError, RecursionError) as e:
        return str(e)


def with_detail(rejects: DataFrame) -> DataFrame:
    """``detail``: message of the parser, with line, column and character.  Python sees the rejected lines only."""
    explain = F.pandas_udf(lambda lines: lines.map(_fault), StringType())
    return rejects.withColumn("detail", explain("line"))


def lenient_jsonl_with_rejects(spark: SparkSession, path: str, schema: str | StructType = PROMPT_SCHEMA,
                               split: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects).  Blank lines are skipped; a line that is not a
    JSON object is a reject with its reason; a duplicated key keeps the last
    value (``from_json``), as Python's ``json.loads`` does.  ``reason`` is the class of the fault,
    ``detail`` the parser's own words."""
    lines = _lines(spark, path, split)
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if lines is None:
        empty_schema = StructType(list(st.fields) + [StructField("ord", ORD_SCHEMA), StructField("file", StringType())])
        return (_empty(spark, empty_schema),
                _empty(spark, StructType([StructField("ord", ORD_SCHEMA), *StructType.fromDDL(
                    "file STRING, line STRING, reason STRING, detail STRING").fields])))
    tagged = tag_lines(lines)
    rows = tagged.where(F.col("reason").isNull()).select(
        F.from_json("line", st).alias("r"), "ord", "file").select("r.*", "ord", "file")
    rejects = with_detail(tagged.where(F.col("reason").isNotNull()).select("ord", "file", "line", "reason"))
    return rows, rejects


def lenient_jsonl(spark: SparkSession, path: str, schema: str | StructType = PROMPT_SCHEMA,
                  split: int = 0) -> DataFrame:
    """S2 (and S1's rows): bad lines silently dropped."""
    return lenient_jsonl_with_rejects(spark, path, schema, split)[0]


def strict_prompts(spark: SparkSession, path: str, schema: str = PROMPT_SCHEMA) -> DataFrame:
    """S3: every non-blank line must parse (FAILFAST raises at run time);
    a missing file yields the five built-in evaluation prompts."""
    lines = _lines(spark, path)
    st = StructType.fromDDL(schema)
    if lines is None:
        rows = [(p["prompt"], p["language"], None, (0, "", 0, i)) for i, p in enumerate(DEFAULT_EVAL_PROMPTS)]
        return spark.createDataFrame(rows, StructType([*st.fields, StructField("ord", ORD_SCHEMA)]))
    nonblank = lines.where(~F.col("line").rlike(BLANK))
    return (nonblank.select(F.from_json("line", st, {"mode": "FAILFAST"}).alias("r"), "ord")
            .select("r.*", "ord"))


def split_files(spark: SparkSession, folder: str, schema: str = PROMPT_SCHEMA,
                layout: str = "named") -> DataFrame:
    """S4 + U1: ``train/validation/evaluation.jsonl`` unioned with a split
    column; an absent split contributes no rows.  ``layout='partitioned'``
    reads the ``split=<name>`` folders a single partitioned write produces."""
    parts = []
    for i, s in enumerate(SPLITS):
        path = f"{folder.rstrip('/')}/{s}.jsonl" if layout == "named" else f"{folder.rstrip('/')}/split={s}"
        rows = lenient_jsonl(spark, path, schema, i).withColumn("split", F.lit(s))
        parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def run_summaries(spark: SparkSession, folder: str, grain: str = "batch") -> DataFrame:
    """``batches.jsonl`` or ``epochs.jsonl`` with the explicit nested
    schema (column pruning reaches the JSON parser); no rows is an error."""
    if grain not in ("batch", "epoch"):
        raise ValueError("grain must be 'batch' or 'epoch'")
    name = "batches.jsonl" if grain == "batch" else "epochs.jsonl"
    schema = BATCH_LOG_SCHEMA if grain == "batch" else EPOCH_LOG_SCHEMA
    df = lenient_jsonl(spark, f"{folder.rstrip('/')}/{name}", schema)
    if df.isEmpty():
        raise ValueError(f"No rows found in {folder}/{name}")
    return df


MAX_KEYS = 1000                  # an object with more keys over all rows is a map whose keys are data: one column


def parse_variant_schema(text: str) -> dict | str:
    """The schema of a variant (``OBJECT<name: TYPE, ...>``) as nested dicts; types that are no object as text."""
    at = 0

    def name() -> str:
        nonlocal at
        if text[at] != "`":
            end = text.index(": ", at)
            out, at = text[at:end], end
            return out
        out = []
        at += 1
        while text[at] != "`" or text[at + 1] == "`":
            out.append(text[at])
            at += 2 if text[at] == "`" else 1
        at += 1
        return "".join(out)

    def kind() -> dict | str:
        nonlocal at
        if not text.startswith("OBJECT<", at):
            start, depth = at, 0
            while at < len(text) and (depth or text[at] not in ",>"):
                if text[at] == "`":
                    name()
                    continue
                depth += (text[at] in "<(") - (text[at] in ">)")
                at += 1
            return text[start:at]
        at += len("OBJECT<")
        out: dict = {}
        while text[at] != ">":
            key = name()
            at += 2
            out[key] = kind()
            if text[at] == ",":
                at += 2
        at += 1
        return out
    return kind()


def _quoted(path: tuple[str, ...]) -> str:
    return "$" + "".join('["' + k.replace("\\", "\\\\").replace('"', '\\"') + '"]' for k in path)


def _leaves(docs: DataFrame, max_keys: int) -> list[tuple[str, ...]]:
    """Paths of all leaves.  One partial aggregate merges the schemas of all rows, of any depth; the driver gets that
    one schema.  Where some rows hold an object and others something else, the objects' schemas are merged
    by a second aggregate, for all such places together."""
    out: list[tuple[str, ...]] = []
    todo: list[tuple[str, ...]] = [()]
    while todo:
        mixed: list[tuple[str, ...]] = []
        at = [F.try_variant_get("v", _quoted(p), "variant") if p else F.col("v") for p in todo]
        objects = [F.schema_of_variant_agg(F.when(F.schema_of_variant(c).startswith("OBJECT"), c)) for c in at]
        merged = docs.agg(*[c.alias(f"s{i}") for i, c in enumerate(objects)]).first()

        def walk(path: tuple[str, ...], kind: dict | str) -> None:
            if isinstance(kind, dict) and len(kind) <= max_keys:
                for k, inner in kind.items():
                    walk((*path, k), inner)
                return
            out.append(path)
            if kind == "VARIANT":
                mixed.append(path)
        for path, text in zip(todo, merged):
            kind = parse_variant_schema(text or "VOID")
            if isinstance(kind, dict):
                if len(kind) <= max_keys:
                    for k, inner in kind.items():
                        walk((*path, k), inner)
                elif not path:
                    raise ValueError(f"more than {max_keys} top-level keys: raise max_keys if they are columns")
        todo = mixed
    return out


def wide_rows(spark: SparkSession, path: str, max_keys: int = MAX_KEYS) -> DataFrame:
    """S5 + P9 without a schema: every JSON object of the file with one text column per dotted key found
    anywhere in it at any depth (the union of all rows, by name), lists as JSON text, plus ``ord``.  Bad lines are
    dropped.  A key that holds an object in some rows only has a column of its own beside those of its inner keys;
    an object with over ``max_keys`` keys in all stays one column of JSON text (a map)."""
    lines = _lines(spark, path)
    if lines is None:
        return _empty(spark, StructType([StructField("ord", ORD_SCHEMA)]))
    docs = (lines.where(F.json_object_keys("line").isNotNull())
            .select("ord", F.try_parse_json("line").alias("v")))
    names: dict[str, list[tuple[str, ...]]] = {}
    every = _leaves(docs.select("v"), max_keys)
    for p in every:
        names.setdefault(".".join(p), []).append(p)
    inner = {p[:k] for p in every for k in range(1, len(p))}

    def value(p: tuple[str, ...]) -> Column:
        held = F.try_variant_get("v", _quoted(p), "variant")
        text = F.try_variant_get("v", _quoted(p), "string")
        return F.when(~F.schema_of_variant(held).startswith("OBJECT"), text) if p in inner else text
    return docs.select("ord", *[F.coalesce(*[value(p) for p in ps]).alias(name) for name, ps in names.items()])


# ------------------------------- sinks ---------------------------------------

def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row, NULL fields kept as ``null``."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_flat_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All rows, flattened to dotted columns, with a header, no index; lists and maps as JSON text."""
    from ..operators.logs import flatten
    flat = flatten(df)
    flat = flat.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (ArrayType, MapType))
                          else F.col(f"`{f.name}`")).alias(f.name) for f in flat.schema.fields])
    flat.write.mode(mode).option("header", "true").csv(path)


def write_split_examples(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """Examples per split, one folder per split value."""
    df.write.mode(mode).partitionBy(split_col).option("ignoreNullFields", "false").json(path)


def write_results(summary: DataFrame, examples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The run summary (one row, nested stats + metadata) and the
    per-prompt examples, written side by side as JSON; examples stay
    distributed (never gathered into one document)."""
    summary.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/summary")
    examples.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/examples")


# ----------------------------- generation log --------------------------------

# Fixed request defaults (must equal the reference's worker).
REQUEST_DEFAULTS = {"max_tokens": 128, "do_sample": False, "temp": 1.0, "top_p": 0.95, "top_k": 50}
REQUEST_SCHEMA = ("id BIGINT, op STRING, prompt STRING, prompt_ids ARRAY<INT>, max_tokens INT, "
                  "do_sample BOOLEAN, temp DOUBLE, top_p DOUBLE, top_k INT")
RESPONSE_SCHEMA = ("id BIGINT, ok BOOLEAN, text STRING, seconds DOUBLE, output_tokens INT, did_sample BOOLEAN, "
                   "pid BIGINT, mlx_active_bytes BIGINT, mlx_cache_bytes BIGINT, mlx_peak_bytes BIGINT, "
                   "error STRING")
KNOWN_OPS = ("generate", "ping", "shutdown")
NO_ID = -1                       # id of a request that gives none, or can't be read


def parse_requests(raw: Column) -> list[Column]:
    """S7 requests: typed fields with the worker's defaults, plus a status:
    ``invalid_json``, ``unknown_op:<op>`` (``None`` when absent) or ``ok``."""
    r = F.from_json(raw, REQUEST_SCHEMA)
    keys = F.json_object_keys(raw)
    is_obj = keys.isNotNull()
    d = REQUEST_DEFAULTS
    status = (F.when(~is_obj, F.lit("invalid_json"))
              .when(F.coalesce(r["op"].isin(*KNOWN_OPS), F.lit(False)), F.lit("ok"))
              .otherwise(F.concat(F.lit("unknown_op:"), F.coalesce(r["op"], F.lit("None")))))
    given = F.coalesce(F.array_contains(keys, F.lit("id")), F.lit(False))
    return [F.when(given, r["id"]).otherwise(F.lit(NO_ID).cast("long")).alias("id"), r["op"].alias("op"),
            r["prompt"].alias("prompt"), r["prompt_ids"].alias("prompt_ids"),
            F.coalesce(r["max_tokens"], F.lit(d["max_tokens"])).alias("max_tokens"),
            F.coalesce(r["do_sample"], F.lit(d["do_sample"])).alias("do_sample"),
            F.coalesce(r["temp"], F.lit(d["temp"])).alias("temp"),
            F.coalesce(r["top_p"], F.lit(d["top_p"])).alias("top_p"),
            F.coalesce(r["top_k"], F.lit(d["top_k"])).alias("top_k"),
            status.alias("request_status")]


def parse_responses(raw: Column) -> list[Column]:
    """S7 responses, nullable by outcome."""
    r = F.from_json(raw, RESPONSE_SCHEMA)
    return [r[f].alias(f) for f in ("id", "ok", "text", "seconds", "output_tokens", "did_sample", "pid",
                                    "mlx_active_bytes", "mlx_cache_bytes", "mlx_peak_bytes", "error")]


def match_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses by id; a request with no response is a ``timeout``.

    ``status`` is the outcome class (an error's text up to the first colon),
    ``detail`` the whole text.  Requests that the worker refused have their
    outcome already, and NO_ID names no request, so neither looks for a response."""
    asks = (F.col("request_status") == "ok") & (F.col("id") != NO_ID)
    j = requests.withColumn("_ask", F.when(asks, F.col("id"))).join(
        responses.withColumnRenamed("id", "_rid"), F.col("_ask") == F.col("_rid"), "left")
    return j.withColumns(outcome_columns()).drop("_rid", "_ask")


def outcome_columns() -> dict[str, Column]:
    """``detail`` and ``status`` of a request joined with its answer (null ``_rid``: none)."""
    detail = (F.when(F.col("request_status") != "ok", F.col("request_status"))
              .when(F.col("_rid").isNull(), F.lit("timeout"))
              .when(F.col("ok"), F.lit("ok"))
              .otherwise(F.coalesce(F.col("error"), F.lit("error"))))
    return {"detail": detail, "status": F.substring_index(detail, ":", 1)}


def outcome_counts(matched: DataFrame) -> DataFrame:
    """Per status: count and mean seconds."""
    return matched.groupBy("status").agg(F.count(F.lit(1)).alias("num_requests"),
                                         F.avg("seconds").alias("avg_seconds"))
