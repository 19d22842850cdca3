"""Streaming queries: driver tables are staged as files in time order (one
folder per chunk, file times set in chunk order so the file source takes
them oldest first), read with ``readStream`` and run to completion with an
``availableNow`` trigger; results are read back as batch frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.jsonl import parse_requests, parse_responses
from ..streaming import live as L
from ..streaming.runner import run_available, run_split
from .registry import ORACLE, query, r6
from .runlog import BATCHES_SQL as _BATCHES_SQL_REF
from .runlog import batches
from .tables import EPOCH_DAY_SQL, epoch_day, table

FILES_PER_CHUNK = 2
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _set_times(spark: SparkSession, folder: str, millis: int) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for st in fs.listStatus(path):
        fs.setTimes(st.getPath(), millis, -1)


def stage_chunks(df: DataFrame, chunk: Column, folder: str, fmt: str = "parquet") -> str:
    """Write ``df`` once, one folder a chunk with files in chunk order (test staging).

    Rows are dealt to ``FILES_PER_CHUNK`` files a chunk by a hash, so a chunk is written by
    as many tasks; folders are listed and given ascending times."""
    spark = df.sparkSession
    cut = df.withColumn("_chunk", chunk.cast("int")).withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.lit(FILES_PER_CHUNK)))
    cols = ["value"] if fmt == "text" else df.columns
    cut.repartition("_chunk", "_file").select("_chunk", "_file", *cols).write.partitionBy("_chunk", "_file").format(fmt).save(folder)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [st.getPath().getName() for st in fs.listStatus(path) if st.isDirectory()]
    for i, name in enumerate(sorted(names, key=lambda n: int(n.split("=")[1]))):
        for k in range(FILES_PER_CHUNK):
            part = f"{folder}/{name}/_file={k}"
            if fs.exists(jvm.org.apache.hadoop.fs.Path(part)):
                _set_times(spark, part, 1_600_000_000_000 + i * 60_000)
    return f"{folder}/_chunk=*/_file=*"


def _period(day: Column) -> Column:
    """Eight-day periods since a fixed day, over any number of months."""
    return F.floor(F.datediff(day, F.lit("2000-01-01").cast("date")) / 8)


def _week(ts: Column) -> Column:
    return _period(ts.cast("date"))


def staged_events(spark: SparkSession, sf_dir: str, fmt: str = "parquet") -> DataFrame:
    e = table(spark, sf_dir, "events")
    folder = scratch_path(spark, "events-stream")
    glob = stage_chunks(e, _week(F.col("ts")), folder, fmt)
    return (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", FILES_PER_CHUNK)
            .format(fmt).load(glob))


def _fmt_ts(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("stream_ingest", sql=f"""
SELECT 'row' AS kind, event_id, user_id AS run_id, {EPOCH_DAY_SQL} AS epoch, CAST(hour(ts) AS INTEGER) AS batch_idx,
       round(value / 100, 6) AS reward, NULL::VARCHAR AS line, NULL::VARCHAR AS reason, NULL::VARCHAR AS detail
FROM events WHERE NOT (event_type = 'error' AND value < 1)
UNION ALL
SELECT 'reject', NULL, NULL, NULL, NULL, NULL, '{{"event_id": ' || event_id || ', "ts": ', 'invalid_json',
       'Expecting value: line 1 column ' || (length(event_id::VARCHAR) + 22) || ' (char ' || (length(event_id::VARCHAR) + 21) || ')'
FROM events WHERE event_type = 'error' AND value < 1""")
def stream_ingest(spark, sf_dir):
    """Live log lines -> parsed rows and rejected lines, two sinks of the same micro-batches."""
    e = table(spark, sf_dir, "events")
    line = (F.when((F.col("event_type") == "error") & (F.col("value") < 1),
                   F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "ts": ')))
            .otherwise(F.to_json(F.struct(*[F.col(c) for c in e.columns]))))
    folder = scratch_path(spark, "log-stream")
    glob = stage_chunks(e.select(line.alias("value"), "ts"), _week(F.col("ts")), folder, "text")
    lines = spark.readStream.option("maxFilesPerTrigger", FILES_PER_CHUNK).text(glob)
    parts = run_split(lines, "log", lambda batch: L.parse_lines(batch, EVENT_SCHEMA))
    rows = parts["rows"].select(F.lit("row").alias("kind"), "event_id", F.col("user_id").alias("run_id"), epoch_day().alias("epoch"),
                                F.hour("ts").alias("batch_idx"), r6(F.col("value") / 100, "reward"))
    return rows.unionByName(parts["rejects"].withColumn("kind", F.lit("reject")), allowMissingColumns=True)


_ANSWER_SQL = """
rq AS (
  SELECT event_id AS id, ts AS asked,
         CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 241 + event_id % 50 ELSE event_id * 7 % 241 END AS took
  FROM events),
lim AS (
  SELECT least(max(asked), max(asked + to_seconds(took))) - INTERVAL '10 minutes' AS mark
  FROM rq)"""


def _timed_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and answers as JSON lines with their times: every tenth request has no answer, every tenth a late one,
    the others take 0 to 240 seconds; error events are broken requests, every seventh generation fails."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    i = F.col("event_id")
    took = F.when(i % 10 == 0, None).when(i % 10 == 1, 241 + i % 50).otherwise(i * 7 % 241)
    asked = F.when(F.col("event_type") == "error", F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "op": '))).otherwise(
        F.to_json(F.struct(i.alias("id"), F.lit("generate").alias("op"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("prompt"))))
    failed = F.when(i % 7 == 0, F.lit("ValueError: bad prompt: p"))
    said = F.to_json(F.struct(i.alias("id"), failed.isNull().alias("ok"), failed.alias("error"), took.cast("double").alias("seconds")))
    return (e.select(asked.alias("raw"), "ts"),
            e.where(took.isNotNull()).select(said.alias("raw"), (F.col("ts") + F.make_dt_interval(secs=took.cast("decimal(18, 6)"))).alias("ts")))


@query("stream_requests", sql=f"""WITH {_ANSWER_SQL}
SELECT CASE WHEN event_type = 'error' THEN -1 ELSE id END AS id, string_split(detail, ':')[1] AS status, detail,
       CASE WHEN detail IN ('ok', 'ValueError: bad prompt: p') THEN took::DOUBLE END AS seconds, count(*) AS n
FROM (SELECT rq.*, event_type,
             CASE WHEN event_type = 'error' THEN 'invalid_json' WHEN took IS NULL OR took > 240 THEN 'timeout'
                  WHEN id % 7 = 0 THEN 'ValueError: bad prompt: p' ELSE 'ok' END AS detail
      FROM rq JOIN events ON event_id = id), lim
WHERE asked + INTERVAL '241 seconds' <= mark GROUP BY ALL""")
def stream_requests(spark, sf_dir):
    """S7 + J8 live: requests with their answers on time; without one a timeout, given out once (requests whose time is
    over by the last watermark)."""
    requests, responses = _timed_log(spark, sf_dir)
    root = scratch_path(spark, "request-stream")
    marks = [df.agg(F.max("ts")).first()[0] for df in (requests, responses)]

    def source(df: DataFrame, name: str) -> DataFrame:
        glob = stage_chunks(df, _week(F.col("ts")), f"{root}/{name}")
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES_PER_CHUNK).parquet(glob)
    rq = source(requests, "asked").select(*parse_requests(F.col("raw")), F.col("ts").alias("asked_at"))
    rs = source(responses, "said").select(*parse_responses(F.col("raw")), F.col("ts").alias("answered_at"))
    out = run_available(L.answered_in_time(rq, rs, "asked_at", "answered_at").select("id", "status", "detail", "seconds", "asked_at"),
                        "requests", "append")
    over = F.lit(min((m for m in marks if m is not None), default=None)).cast("timestamp_ntz") - F.expr("INTERVAL 841 SECONDS")
    return out.where(F.col("asked_at") <= over).groupBy("id", "status", "detail", "seconds").agg(F.count(F.lit(1)).alias("n"))


@query("stream_epochs", sql="""
SELECT strftime(day, '%Y-%m-%d') AS epoch, run_id, count(DISTINCT hour) AS num_batches, count(*) AS num_samples,
       round(sum(r)::double / count(*), 6) AS avg_reward, round(sum(l)::double / count(*), 6) AS avg_loss,
       round(sum(r * r)::double / count(*) - (sum(r)::double / count(*)) * (sum(r)::double / count(*)), 6) AS reward_variance, min(reward) AS reward_min, max(reward) AS reward_max, CAST(sum(tokens) AS BIGINT) AS api_tokens
FROM (SELECT user_id AS run_id, round(value / 100, 6)::decimal(18, 6) AS r, round(1 - value / 100, 6)::decimal(18, 6) AS l,
             time_bucket(INTERVAL '1 day', ts) AS day, time_bucket(INTERVAL '1 hour', ts) AS hour,
             round(value / 100, 6) AS reward, round(1 - value / 100, 6) AS loss, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens
      FROM events)
WHERE day + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '2 hours'
GROUP BY day, run_id""")
def stream_epochs(spark, sf_dir):
    """Live epoch rollup: batch statistics by hour, epoch summaries by day over them, closed epochs only, by date."""
    s = staged_events(spark, sf_dir).select(
        "ts", F.col("user_id").alias("run_id"), F.round(F.col("value") / 100, 6).alias("reward"),
        F.round(1 - F.col("value") / 100, 6).alias("loss"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    out = run_available(L.epoch_rollup(s, "ts", "run_id", "reward", "loss", "tokens"), "epochs", "append")
    return out.select(F.date_format("epoch_start", "yyyy-MM-dd").alias("epoch"), "run_id", "num_batches", "num_samples", r6("avg_reward"),
                      r6("avg_loss"), r6("reward_variance"), "reward_min", "reward_max", "api_tokens")


@query("stream_windows", sql="""
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, count(*) AS n, round(avg(value), 6) AS avg_value, max(value) AS max_value
FROM events
WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '2 hours'
GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Tumbling hourly windows per event type, each given out once when the watermark has
    passed it, and then forgotten (append mode)."""
    w = L.tumbling_stats(staged_events(spark, sf_dir), "ts", ["event_type"], "value", "1 hour", "2 hours")
    out = run_available(w, "windows", "append")
    return out.select(_fmt_ts(F.col("window_start")).alias("window_start"),
                      _fmt_ts(F.col("window_end")).alias("window_end"), "event_type", "n", r6("avg_value"),
                      "max_value")


@query("stream_sliding", sql="""
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, max(value) AS max_value
FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS ws, event_type, value FROM events
      UNION ALL
      SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour', event_type, value FROM events)
WHERE ws + INTERVAL '2 hours' <= (SELECT max(ts) FROM events) - INTERVAL '3 hours'
GROUP BY ALL""")
def stream_sliding(spark, sf_dir):
    """Two-hour windows sliding by one hour, closed ones only (append mode)."""
    w = L.sliding_stats(staged_events(spark, sf_dir), "ts", ["event_type"], "value", "2 hours", "1 hour", "3 hours")
    out = run_available(w, "sliding", "append")
    return out.select(_fmt_ts(F.col("window_start")).alias("window_start"), "event_type", "n", "max_value")


@query("stream_sessions", sql="""
WITH g AS (
  SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                            OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes'
                           THEN 1 ELSE 0 END AS brk
  FROM events
), s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS n
FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL '30 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def stream_sessions(spark, sf_dir):
    """Activity sessions per run (30 minutes of silence closes one), closed ones only (append mode)."""
    s = L.activity_sessions(staged_events(spark, sf_dir), "ts", ["user_id"], "30 minutes", "1 hour")
    out = run_available(s, "sessions", "append")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.select("user_id", F.date_format("session_start", fmt).alias("session_start"),
                      F.date_format("session_end", fmt).alias("session_end"), "n")


LATE_SQL = """
late AS (
  SELECT ts, value, event_id % 20 = 0 AS delayed,
         CAST(floor(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) / 8) AS INTEGER)
           + CASE event_id % 40 WHEN 0 THEN 1 WHEN 20 THEN 3 ELSE 0 END AS arrival
  FROM events),
marks AS (SELECT arrival, max(ts) - INTERVAL '2 hours' AS top, row_number() OVER (ORDER BY arrival) AS k FROM late GROUP BY arrival),
before AS (SELECT a.arrival, max(b.top) AS mark FROM marks a LEFT JOIN marks b ON b.k < a.k - 1 GROUP BY a.arrival),
seen AS (SELECT l.*, time_bucket(INTERVAL '1 hour', ts) AS ws FROM late l JOIN before USING (arrival)
         WHERE mark IS NULL OR time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' > mark)"""


@query("stream_late_rows", sql=f"""WITH {LATE_SQL}
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(*) FILTER (WHERE delayed) AS delayed,
       max(value) AS max_value
FROM seen WHERE ws + INTERVAL '1 hour' <= (SELECT max(top) FROM marks) GROUP BY ws""")
def stream_late_rows(spark, sf_dir):
    """Some events arrive one period late, some three.  A late row counts while its window is open and is
    dropped once the watermark that the batch before ran with has passed the window's end."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    folder = scratch_path(spark, "late-stream")
    k = F.col("event_id") % 40
    arrival = _week(F.col("ts")) + F.when(k == 0, 1).when(k == 20, 3).otherwise(0)
    cut = e.withColumn("_chunk", arrival.cast("int"))
    cut.repartition("_chunk").write.partitionBy("_chunk").parquet(folder)   # a batch is a period: one file each
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((st.getPath().getName() for st in fs.listStatus(path) if st.isDirectory()), key=lambda n: int(n.split("=")[1]))
    for i, name in enumerate(names):
        _set_times(spark, f"{folder}/{name}", 1_600_000_000_000 + i * 60_000)
    s = (spark.readStream.schema("event_id BIGINT, ts TIMESTAMP_NTZ, value DOUBLE").option("maxFilesPerTrigger", 1)
         .parquet(f"{folder}/_chunk=*")
         .withColumn("delayed", F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)))
    s = s.withColumn("_et", L.event_time(F.col("ts"))).withWatermark("_et", "2 hours")
    w = s.groupBy(F.window("_et", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("delayed").alias("delayed"), F.max("value").alias("max_value"))
    out = run_available(w.select(F.col("w.start").alias("window_start"), "n", "delayed", "max_value"), "late", "append")
    return out.select(_fmt_ts(F.col("window_start")).alias("window_start"), "n", "delayed", "max_value")


@query("stream_dedupe", sql="SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    """First arrival per (run, event type) inside a 60-day watermark."""
    d = L.live_dedupe(staged_events(spark, sf_dir), "ts", ["user_id", "event_type"], "60 days")
    return run_available(d.select("user_id", "event_type"), "dedupe", "append")


@query("stream_cache_ttl", sql=None)
def stream_cache_ttl(spark, sf_dir):
    """The score cache with expiry as a stateful stream (same answer as
    ``score_cache_ttl``; SQL registered below)."""
    c = L.cache_ttl_stream(staged_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id")
    return run_available(c, "cache-ttl", "append").select("user_id", "event_type", "event_id", "cache_hit")


@query("stream_gc_cooldown", sql=None)
def stream_gc_cooldown(spark, sf_dir):
    """The clean-up cooldown over a live batch-metrics log."""
    b = batches(spark, sf_dir).select("run_id", "step", "fragmentation_gb", "epoch", "ts0")
    folder = scratch_path(spark, "batch-stream")
    glob = stage_chunks(b, F.floor((F.col("epoch") - 1) / 8), folder, "json")
    s = (spark.readStream.schema("run_id BIGINT, step INT, fragmentation_gb DOUBLE, epoch INT, ts0 TIMESTAMP_NTZ")
         .option("maxFilesPerTrigger", FILES_PER_CHUNK).json(glob))
    g = L.gc_cooldown_stream(s, "run_id", "step", "fragmentation_gb", "ts0")
    return run_available(g, "gc-cooldown", "append").select("run_id", "step", "wants_gc", "triggered")


def _register_shared_oracles():
    # the stateful streams must give exactly the batch answers
    from . import runlog  # noqa: F401  (ensures the batch queries are registered)
    ORACLE["stream_cache_ttl"] = ORACLE["score_cache_ttl"]
    ORACLE["stream_gc_cooldown"] = ORACLE["gc_cooldown"]


_register_shared_oracles()


@query("stream_health", sql="""WITH RECURSIVE """ + _BATCHES_SQL_REF[1:] + """,
g AS (
  SELECT run_id, step, fragmentation_gb > 10.0 AS fires, CASE WHEN fragmentation_gb > 10.0 THEN step END AS last FROM batches WHERE step = 1
  UNION ALL
  SELECT b.run_id, b.step, b.fragmentation_gb > 10.0 AND (g.last IS NULL OR b.step - g.last >= 10),
         CASE WHEN b.fragmentation_gb > 10.0 AND (g.last IS NULL OR b.step - g.last >= 10) THEN b.step ELSE g.last END
  FROM g JOIN batches b ON b.run_id = g.run_id AND b.step = g.step + 1
),
h AS (
  SELECT run_id, step, gen_share_pct, gen_tps, fragmentation_gb, cache_gb, reward_mean,
         fragmentation_gb - lag(fragmentation_gb) OVER (PARTITION BY run_id ORDER BY step) AS growth,
         reward_mean - avg(CASE WHEN step <= 15 THEN reward_mean END)
             OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gain
  FROM batches
)
SELECT run_id, step, CASE WHEN len(iss) = 0 THEN 'OK' ELSE 'WARN' END AS status, array_to_string(iss, ',') AS issues, fires AS gc_triggered
FROM (
  SELECT h.run_id, h.step, fires, list_filter([
      CASE WHEN gen_share_pct > 85.0 THEN 'gen_bottleneck' END,
      CASE WHEN gen_tps < 6.0 THEN 'low_gen_tps' END,
      CASE WHEN fragmentation_gb > 10.0 THEN 'fragmentation' END,
      CASE WHEN cache_gb > 3.0 THEN 'cache_size' END,
      CASE WHEN growth > 0.75 THEN 'fragmentation_growth' END,
      CASE WHEN gain <= 0 THEN 'no_gain_vs_baseline' END], lambda x: x IS NOT NULL) AS iss
  FROM h JOIN g ON g.run_id = h.run_id AND g.step = h.step WHERE h.step > 3 AND h.step % 5 = 0)""")
def stream_health(spark, sf_dir):
    """Live health check over a batch-metrics log (running baseline)."""
    b = batches(spark, sf_dir).select("run_id", "step", "epoch", "reward_mean", "gen_share_pct", "gen_tps",
                                      "fragmentation_gb", "cache_gb", "ts0")
    folder = scratch_path(spark, "health-stream")
    glob = stage_chunks(b, F.floor((F.col("epoch") - 1) / 8), folder, "json")
    s = (spark.readStream.schema("run_id BIGINT, step INT, epoch INT, reward_mean DOUBLE, gen_share_pct DOUBLE, "
                                 "gen_tps DOUBLE, fragmentation_gb DOUBLE, cache_gb DOUBLE, ts0 TIMESTAMP_NTZ")
         .option("maxFilesPerTrigger", FILES_PER_CHUNK).json(glob))
    h = L.health_stream(s, "run_id", "step", "reward_mean", "gen_share_pct", "gen_tps", "fragmentation_gb",
                        "cache_gb", "ts0")
    return run_available(h, "health", "append").select("run_id", "step", "status", "issues", "gc_triggered")
