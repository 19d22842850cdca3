"""Source and sink queries: driver tables are written as JSON Lines / CSV to
a fresh folder under the shared checkpoint folder (some lines broken on
purpose by content rule), then read back through the scan operators.

Line rules for the prompt file built from ``documents``: source ``src4`` ->
a blank line; ``src9`` -> a JSON array (not an object); Spanish documents ->
truncated JSON; ``src2`` -> the object carries ``prompt`` twice (last wins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import compare_prompts, run_summary
from ..operators.corpus import assign_split
from ..operators.logs import flatten
from ..session import scratch_path
from ..sources import jsonl as J
from .comparison import GEN_SQL, lineitem_generations
from .corpus import LANG_MAP_SQL, SPLIT_SQL, prompt_language
from .logs import NESTED_SQL, nested_batch_log
from .registry import query, r6
from .tables import table


def _good_json(d: DataFrame):
    return F.to_json(F.struct(F.col("text").alias("prompt"), prompt_language(F.col("lang")).alias("language"),
                              F.col("doc_id").cast("string").alias("id")))


def prompt_lines(spark: SparkSession, sf_dir: str, broken: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    good = _good_json(d)
    if not broken:
        return d.select(good.alias("value"))
    line = (F.when(F.col("source") == "src4", F.lit("   "))
            .when(F.col("source") == "src9", F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]")))
            .when(F.col("lang") == "es", F.regexp_replace(good, r"\}$", ""))
            .when(F.col("source") == "src2", F.concat(F.lit('{"prompt": "dup", '), F.substring(good, 2, 1 << 30)))
            .otherwise(good))
    return d.select(line.alias("value"))


def _write_text(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").text(path)
    return path


@query("jsonl_scan", sql=f"""
SELECT CAST(doc_id AS VARCHAR) AS id, {LANG_MAP_SQL} AS language, md5(text) AS prompt_md5
FROM documents WHERE source NOT IN ('src4', 'src9') AND lang <> 'es'""")
def jsonl_scan(spark, sf_dir):
    """Lenient scan: blank, non-object and broken lines dropped."""
    path = _write_text(prompt_lines(spark, sf_dir), scratch_path(spark, "prompts") + "/train.jsonl")
    rows = J.lenient_jsonl(spark, path)
    return rows.select("id", "language", F.md5("prompt").alias("prompt_md5"))


@query("jsonl_rejects", sql=f"""
SELECT reason, detail, count(*) AS num_lines FROM (
  SELECT CASE WHEN source = 'src9' THEN 'not_an_object' WHEN lang = 'es' THEN 'invalid_json' END AS reason,
         CASE WHEN source = 'src9' THEN 'a JSON list in place of an object'
              ELSE 'Expecting '','' delimiter: line 1 column ' || (1 + size) || ' (char ' || size || ')' END AS detail
  FROM (SELECT source, lang, length('{{"prompt":' || to_json(text) || ',"language":' || to_json({LANG_MAP_SQL}) || ',"id":"' || doc_id || '"') AS size FROM documents)
  WHERE source <> 'src4') WHERE reason IS NOT NULL GROUP BY reason, detail""")
def jsonl_rejects(spark, sf_dir):
    """S1 rejects: every bad line with its reason and the parser's message (here counted by both)."""
    path = _write_text(prompt_lines(spark, sf_dir), scratch_path(spark, "prompts") + "/train.jsonl")
    _, rejects = J.lenient_jsonl_with_rejects(spark, path)
    return rejects.groupBy("reason", "detail").agg(F.count(F.lit(1)).alias("num_lines"))


@query("strict_scan", sql=f"SELECT CAST(doc_id AS VARCHAR) AS id, {LANG_MAP_SQL} AS language FROM documents")
def strict_scan(spark, sf_dir):
    """S3: strict scan of a clean file (a bad line would fail the job)."""
    path = _write_text(prompt_lines(spark, sf_dir, broken=False), scratch_path(spark, "prompts") + "/eval.jsonl")
    return J.strict_prompts(spark, path).select("id", "language")


@query("split_scan", sql=f"SELECT CAST(doc_id AS VARCHAR) AS id, split FROM ({SPLIT_SQL})")
def split_scan(spark, sf_dir):
    """S4 + U1: three split files read and unioned with their split name."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    key = F.concat(F.coalesce("text", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit("python")))
    d = d.withColumn("split", assign_split(key))
    root = scratch_path(spark, "splits")
    # one pass over the corpus writes all three splits (one folder each)
    d.select("split", _good_json(d).alias("value")).write.partitionBy("split").text(root)
    return J.split_files(spark, root, layout="partitioned").select("id", "split")


@query("summary_scan", sql=f"""WITH {NESTED_SQL}
SELECT run_id, "global_step", round("rewards.mean", 6) AS "rewards.mean", round("timing_s.total", 6) AS "timing_s.total",
       "tokens.gen_raw" FROM flat""")
def summary_scan(spark, sf_dir):
    """The batch summary file read with the explicit nested schema."""
    root = scratch_path(spark, "json_summaries")
    J.write_jsonl(nested_batch_log(spark, sf_dir), root + "/batches.jsonl")
    log = J.run_summaries(spark, root, "batch")
    return log.select("run_id", F.col("global_step"), r6(F.col("rewards.mean"), "rewards.mean"),
                      r6(F.col("timing_s.total"), "timing_s.total"), F.col("tokens.gen_raw").alias("tokens.gen_raw"))


@query("jsonl_roundtrip", sql="SELECT doc_id, quality, toxic FROM labels")
def jsonl_roundtrip(spark, sf_dir):
    """Rows written as JSON Lines (nulls kept) and read back."""
    path = scratch_path(spark, "labels") + "/labels.jsonl"
    J.write_jsonl(table(spark, sf_dir, "labels"), path)
    return J.lenient_jsonl(spark, path, "doc_id BIGINT, quality INT, toxic INT").select("doc_id", "quality", "toxic")


@query("csv_roundtrip", sql=f"""WITH {NESTED_SQL}
SELECT run_id, "global_step", round("rewards.mean", 6) AS "rewards.mean", round("reward_gain.ema_reward", 6)
       AS "reward_gain.ema_reward", "tokens.gen_kept" FROM flat""")
def csv_roundtrip(spark, sf_dir):
    """The whole flattened log written as CSV with a header, read back."""
    path = scratch_path(spark, "csv") + "/batches.csv"
    nested = nested_batch_log(spark, sf_dir)
    J.write_flat_csv(nested, path)
    flat_schema = flatten(nested).schema
    back = spark.read.option("header", "true").schema(flat_schema).csv(path)
    return back.select("run_id", "global_step", r6(F.col("`rewards.mean`"), "rewards.mean"),
                       r6(F.col("`reward_gain.ema_reward`"), "reward_gain.ema_reward"),
                       F.col("`tokens.gen_kept`").alias("tokens.gen_kept"))


@query("dynamic_columns", sql="""
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS "user.id", event_type AS "user.type",
       CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) END AS "k.c0", CASE WHEN event_id % 4 = 1 THEN CAST(event_id AS VARCHAR) END AS "k.c1",
       CASE WHEN event_id % 4 = 2 THEN CAST(event_id AS VARCHAR) END AS "k.c2", CASE WHEN event_id % 4 = 3 THEN CAST(event_id AS VARCHAR) END AS "k.c3",
       CASE WHEN event_type = 'view' THEN '[1,' || CAST(event_id AS VARCHAR) || ']' END AS tags,
       CASE WHEN event_type = 'purchase' THEN 'dot' END AS "a.b"
FROM events""")
def dynamic_columns(spark, sf_dir):
    """S5 + P9 + S9: a log whose keys differ from row to row, read without a schema, written as CSV with the
    union of the columns, read back."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    i, t = F.col("event_id").cast("string"), F.col("event_type")
    line = F.concat(F.lit('{"id": '), i, F.lit(', "user": {"id": '), F.col("user_id").cast("string"), F.lit(', "type": "'), t,
                    F.lit('"}, "k": {"c'), (F.col("event_id") % 4).cast("string"), F.lit('": '), i, F.lit("}"),
                    F.when(t == "view", F.concat(F.lit(', "tags": [1, '), i, F.lit("]"))).otherwise(F.lit("")),
                    F.when(t == "purchase", F.lit(', "a.b": "dot"')).otherwise(F.lit("")), F.lit("}"))
    path = _write_text(e.select(line.alias("value")), scratch_path(spark, "wide") + "/batches.jsonl")
    wide = J.wide_rows(spark, path).drop("ord")
    out = scratch_path(spark, "wide-csv")
    J.write_flat_csv(wide, out)
    back = spark.read.option("header", "true").schema(wide.schema).csv(out)
    return back.select(F.col("id").cast("long").alias("id"), *[F.col(f"`{c}`").alias(c) for c in (
        "user.id", "user.type", "k.c0", "k.c1", "k.c2", "k.c3", "tags", "a.b")])


@query("nested_roundtrip", sql=GEN_SQL + """
SELECT ord, round(avg(score) FILTER (WHERE model = 'baseline'), 6) AS baseline_score,
       round(avg(score) FILTER (WHERE model = 'fine_tuned'), 6) AS fine_tuned_score,
       list(CAST(score AS DOUBLE) ORDER BY j, t1, t2, score) FILTER (WHERE model = 'baseline') AS baseline_score_samples
FROM gens GROUP BY ord""")
def nested_roundtrip(spark, sf_dir):
    """Summary + examples (nested, with sample arrays) written as JSON
    and the examples read back with their schema."""
    g = lineitem_generations(spark, sf_dir).withColumn("score", F.col("score").cast("double"))
    per = compare_prompts(g, keys=["ord"], with_samples=True, tie_cols=["t1", "t2"], code_col="code")
    examples = per.select("ord", F.struct("baseline_score", "fine_tuned_score", "improvement").alias("scores"),
                          "baseline_score_samples", "fine_tuned_score_samples", "baseline_code")
    summary = run_summary(per).select(F.struct("*").alias("stats"),
                                      F.struct(F.lit("mean").alias("aggregate")).alias("metadata"))
    root = scratch_path(spark, "validation")
    J.write_results(summary, examples, root)
    back = spark.read.schema(examples.schema).json(root + "/examples")
    return back.select("ord", r6(F.col("scores.baseline_score"), "baseline_score"),
                       r6(F.col("scores.fine_tuned_score"), "fine_tuned_score"), "baseline_score_samples")


@query("split_roundtrip", sql=f"""
SELECT d.doc_id, s.split, md5(text) AS prompt_md5, {LANG_MAP_SQL} AS language, md5(text) AS code_md5,
       round(n_chars / 1000.0, 6) AS score, CAST(n_chars AS BIGINT) AS chars, round(1.0 - 1.0 / (1 + n_chars), 6) AS fill
FROM documents d JOIN ({SPLIT_SQL}) s USING (doc_id)""")
def split_roundtrip(spark, sf_dir):
    """Whole examples (prompt, codes, score, breakdown map) written per split folder, read back
    with the split recovered from the folder name (partition discovery)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    key = F.concat(F.coalesce("text", F.lit("")), F.lit("|"), F.coalesce("lang", F.lit("python")))
    d = d.select("doc_id", F.col("text").alias("prompt"), prompt_language(F.col("lang")).alias("language"),
                 F.col("text").alias("student_code"), (F.col("n_chars") / 1000.0).alias("score"),
                 F.create_map(F.lit("chars"), F.col("n_chars").cast("double"),
                              F.lit("fill"), 1.0 - 1.0 / (1 + F.col("n_chars"))).alias("breakdown"),
                 assign_split(key).alias("split"))
    path = scratch_path(spark, "collected")
    J.write_split_examples(d, path)
    back = spark.read.schema("doc_id BIGINT, prompt STRING, language STRING, student_code STRING, score DOUBLE, "
                             "breakdown MAP<STRING, DOUBLE>, split STRING").json(path)
    return back.select("doc_id", "split", F.md5("prompt").alias("prompt_md5"), "language", F.md5("student_code").alias("code_md5"),
                       r6("score"), F.col("breakdown.chars").cast("long").alias("chars"), r6(F.col("breakdown.fill"), "fill"))


# ----------------------------- generation log --------------------------------

def generation_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and responses as raw JSON text from ``events``, by content rule.

    Requests: error events are truncated JSON; signup events are shutdown, ping,
    no op at all or an unknown op by ``event_id % 4``; the others generate (view
    events carry ``max_tokens``; clicks with ``event_id % 10 = 0`` give no id).
    Responses: refused requests are answered at once (id -1 for bad lines), ping
    and shutdown too; generations only with value >= 5, of which ``event_id % 7
    = 0`` fail."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    t, i = F.col("event_type"), F.col("event_id")
    op = (F.when(t != "signup", "generate").when(i % 4 == 0, "shutdown").when(i % 4 == 1, "ping")
          .when(i % 4 == 3, "train"))
    base = F.struct(F.when(~((t == "click") & (i % 10 == 0)), i).alias("id"), op.alias("op"),
                    F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("prompt"),
                    F.when(t == "view", k).alias("max_tokens"))
    req = F.when(t == "error", F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "op": '))) \
        .otherwise(F.to_json(base))
    requests = e.select(req.alias("raw"))
    refused = (F.when(t == "error", "invalid_json").when((t == "signup") & (i % 4 == 2), "unknown_op:None")
               .when((t == "signup") & (i % 4 == 3), "unknown_op:train"))
    failed = F.when((t != "signup") & (i % 7 == 0), "ValueError: bad prompt: p")
    error = F.coalesce(refused, failed)
    said = F.struct(F.when((t == "error") | (t == "click") & (i % 10 == 0), F.lit(-1).cast("long")).otherwise(i).alias("id"),
                    error.isNull().alias("ok"), error.alias("error"),
                    F.when((t != "signup") & refused.isNull(), F.col("value") / 10).alias("seconds"),
                    F.when((t != "signup") & error.isNull(), k).alias("output_tokens"))
    responses = e.where((F.col("value") >= 5) | refused.isNotNull() | (t == "signup")).select(F.to_json(said).alias("raw"))
    return requests, responses


REQ_SQL = """
rq AS (
  SELECT event_id, value, props,
         CASE WHEN event_type = 'error' OR (event_type = 'click' AND event_id % 10 = 0) THEN -1 ELSE event_id END AS id,
         event_type AS t,
         CASE WHEN event_type <> 'signup' THEN 'generate' WHEN event_id % 4 = 0 THEN 'shutdown'
              WHEN event_id % 4 = 1 THEN 'ping' WHEN event_id % 4 = 3 THEN 'train' END AS op
  FROM events),
req AS (
  SELECT id, CASE WHEN t = 'view' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE 128 END AS max_tokens,
         CASE WHEN t = 'error' THEN 'invalid_json'
              WHEN op IS NULL THEN 'unknown_op:None'
              WHEN op NOT IN ('generate', 'ping', 'shutdown') THEN 'unknown_op:' || op
              WHEN op IN ('ping', 'shutdown') THEN 'ok'
              WHEN id = -1 OR value < 5 THEN 'timeout'
              WHEN event_id % 7 = 0 THEN 'ValueError: bad prompt: p' ELSE 'ok' END AS detail,
         CASE WHEN op = 'generate' AND t <> 'error' AND id <> -1 AND value >= 5 THEN value / 10 END AS seconds
  FROM rq)"""


def _matched(spark, sf_dir):
    requests, responses = generation_log(spark, sf_dir)
    rq = requests.select(*J.parse_requests(F.col("raw")))
    rs = responses.select(*J.parse_responses(F.col("raw")))
    return J.match_requests(rq, rs)


@query("request_match", sql=f"""WITH {REQ_SQL}
SELECT id, string_split(detail, ':')[1] AS status, detail, max_tokens FROM req""")
def request_match(spark, sf_dir):
    """S7 + J8: typed requests with defaults, matched to responses by id."""
    return _matched(spark, sf_dir).select("id", "status", "detail", "max_tokens")


@query("generation_outcomes", sql=f"""WITH {REQ_SQL}
SELECT string_split(detail, ':')[1] AS status, count(*) AS num_requests, round(avg(seconds), 6) AS avg_seconds FROM req GROUP BY 1""")
def generation_outcomes(spark, sf_dir):
    """Outcome classes with counts and mean seconds."""
    o = J.outcome_counts(_matched(spark, sf_dir))
    return o.select("status", "num_requests", r6("avg_seconds"))
