"""Live operators: two sinks a micro-batch, answers in time, managed state, epochs of windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evalforge.operators import sequence as SQ
from evalforge.session import scratch_path
from evalforge.sources import jsonl as J
from evalforge.streaming import live as L
from evalforge.streaming.runner import keyed_state, run_available, run_split, split_sink

BASE = dt.datetime(2024, 1, 1)


def at(hours):
    return BASE + dt.timedelta(hours=hours)


def source(spark, batches, schema):
    """A stream that gets one list of rows a micro-batch."""
    folder, jvm = scratch_path(spark, "live"), spark.sparkContext._jvm
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/b{i}")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for st in fs.listStatus(p):
            fs.setTimes(st.getPath(), 1_600_000_000_000 + i * 60_000, -1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")


def rows_held(stream):
    """Rows in the state store once all that is available has been read."""
    with keyed_state(stream.sparkSession):
        q = (stream.writeStream.foreachBatch(lambda df, i: df.write.format("noop").mode("overwrite").save())
             .option("checkpointLocation", scratch_path(stream.sparkSession, "held")).trigger(availableNow=True).start())
        q.awaitTermination()
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_rows_and_rejects_of_one_batch(spark):
    lines = [[('{"a": 1}',), ("bad{",), ("  ",)], [("[1]",), ('{"a": 2}',), ('{"a": 3',)]]
    parts = run_split(source(spark, lines, "value string"), "split", lambda df: L.parse_lines(df, "a int"))
    assert sorted(r["a"] for r in parts["rows"].collect()) == [1, 2]
    assert {(r["line"], r["reason"], r["detail"]) for r in parts["rejects"].collect()} == {
        ("bad{", "invalid_json", "Expecting value: line 1 column 1 (char 0)"), ("[1]", "not_an_object", "a JSON list in place of an object"),
        ('{"a": 3', "invalid_json", "Expecting ',' delimiter: line 1 column 8 (char 7)")}


def test_replayed_batch_changes_neither_sink(spark):
    out = scratch_path(spark, "replay")
    sink = split_sink(lambda df: L.parse_lines(df, "a int"), out)
    batches = [spark.createDataFrame([('{"a": 1}',), ("x",)], "value string"), spark.createDataFrame([('{"a": 2}',), ("y",)], "value string")]
    for i in (0, 1, 1, 0):
        sink(batches[i], i)
        if i:
            got = (sorted(r["a"] for r in spark.read.parquet(f"{out}/rows").collect()), sorted(r["line"] for r in spark.read.parquet(f"{out}/rejects").collect()))
            assert got == ([1, 2], ["x", "y"])


def test_answers_in_time(spark):
    """On time (both ends included), late, absent, failed, refused, and an answer before its request."""
    ask = lambda i, op="generate": f'{{"id": {i}, "op": "{op}"}}'
    requests = [[(ask(1), at(0)), (ask(2), at(0)), (ask(3), at(0)), (ask(4), at(0)), (ask(5), at(0)), (ask(6, "odd"), at(0)), ("bad{", at(0)), (ask(8), at(1))],
                [(ask(9), at(9))], [(ask(10), at(30))]]
    say = lambda i, ok="true", more="": f'{{"id": {i}, "ok": {ok}{more}}}'
    sec = 1 / 3600
    answers = [[(say(1), at(0)), (say(2), at(240 * sec)), (say(3), at(241 * sec)), (say(4, "false", ', "error": "E: x"'), at(10 * sec)), (say(8), at(0.9)), (say(6), at(0))],
               [(say(9), at(9 + 100 * sec))], [(say(99), at(30))]]
    rq = source(spark, requests, "raw string, ts timestamp").select(*J.parse_requests(F.col("raw")), F.col("ts").alias("asked_at"))
    rs = source(spark, answers, "raw string, ts timestamp").select(*J.parse_responses(F.col("raw")), F.col("ts").alias("answered_at"))
    out = run_available(L.answered_in_time(rq, rs, "asked_at", "answered_at").select("id", "detail", "answered_at"), "answers").collect()
    got = sorted((r["id"], r["detail"], r["answered_at"] is not None) for r in out)
    assert got == [(-1, "invalid_json", False), (1, "ok", True), (2, "ok", True), (3, "timeout", False), (4, "E: x", True), (5, "timeout", False),
                   (6, "unknown_op:odd", False), (8, "timeout", False), (9, "ok", True)]


CACHE = "id long, key string, ts timestamp"


def test_cache_state_goes_after_expiry(spark):
    batches = [[(i, f"k{i}", at(i / 100)) for i in range(40)], [(100, "late", at(50))], [(101, "late", at(51))]]
    held = [rows_held(L.cache_ttl_stream(source(spark, batches[:n], CACHE), ["key"], "ts", "id")) for n in (1, 3)]
    assert held[0] >= 40 > 4 >= held[1]


def test_cache_starts_from_the_batch_operator(spark):
    events = [(i, "abc"[i % 3] if i % 7 else None, at(i * 1.3)) for i in range(60)]
    df = spark.createDataFrame(events, CACHE)
    whole = {r["id"]: r["cache_hit"] for r in SQ.cache_ttl(df, ["key"], "ts", "id").collect()}
    before = df.where("id < 30")
    stamps = SQ.cache_stamps(before, ["key"], "ts", "id")
    live = run_available(L.cache_ttl_stream(source(spark, [events[30:45], events[45:]], CACHE), ["key"], "ts", "id", initial=stamps), "initial")
    assert {r["id"]: r["cache_hit"] for r in live.collect()} == {i: h for i, h in whole.items() if i >= 30}
    assert any(h for i, h in whole.items() if 30 <= i < 34)


def test_event_without_a_time_is_a_miss(spark):
    out = run_available(L.cache_ttl_stream(source(spark, [[(1, "a", at(0)), (2, "a", None), (3, "a", at(1))]], CACHE), ["key"], "ts", "id"), "timeless")
    assert {r["id"]: r["cache_hit"] for r in out.collect()} == {1: False, 2: False, 3: True}


RUNS = "run string, step int, frag double, ts timestamp"


def test_cooldown_across_batches_and_idle_runs(spark):
    rows = [("r", i, 20.0 if i != 13 else None, at(i)) for i in range(25)]
    out = run_available(L.gc_cooldown_stream(source(spark, [rows[:7][::-1], rows[7:18], rows[18:]], RUNS), "run", "step", "frag", "ts"), "cooldown")
    assert sorted(r["step"] for r in out.where("triggered").collect()) == [0, 10, 20]
    idle = [[("r", 1, 20.0, at(0))], [("other", 1, 0.0, at(10))], [("other", 2, 0.0, at(11))], [("r", 2, 20.0, at(12))]]
    out = run_available(L.gc_cooldown_stream(source(spark, idle, RUNS), "run", "step", "frag", "ts", idle_seconds=3600), "idle")
    assert {(r["run"], r["step"]): r["triggered"] for r in out.collect()}[("r", 2)] is True  # forgotten, so it may fire again


def test_health_says_what_it_triggered(spark):
    cols = "run long, step int, reward double, share double, tps double, frag double, cache double, ts timestamp"
    rows = [(1, i, 0.5, 10.0, 9.0, 20.0 if i >= 5 else 1.0, 1.0, at(i)) for i in range(1, 21)]
    out = run_available(L.health_stream(source(spark, [rows[:9], rows[9:]], cols), "run", "step", "reward", "share", "tps", "frag", "cache", "ts"), "health")
    got = {r["step"]: (r["status"], r["issues"], r["gc_triggered"]) for r in out.collect()}
    assert got == {5: ("WARN", "fragmentation,fragmentation_growth,no_gain_vs_baseline", True), 10: ("WARN", "fragmentation,no_gain_vs_baseline", False),
                   15: ("WARN", "fragmentation,no_gain_vs_baseline", True), 20: ("WARN", "fragmentation,no_gain_vs_baseline", False)}


def test_epochs_over_windows(spark):
    cols = "ts timestamp, run long, reward double, loss double, tokens long"
    day = [(at(h), 1, 0.1 * h, None if h == 3 else 1.0, 2) for h in (1, 1.5, 3, 20)] + [(at(2), None, 0.5, 0.5, None)]
    out = run_available(L.epoch_rollup(source(spark, [day, [(at(30), 1, 1.0, 1.0, 1)], [(at(60), 1, 1.0, 1.0, 1)], [(at(61), 1, 1.0, 1.0, 1)]], cols),
                                       "ts", "run", "reward", "loss", "tokens"), "epochs").collect()
    got = {(r["epoch_start"], r["run"]): (r["num_batches"], r["num_samples"], r["api_tokens"]) for r in out}
    assert got == {(at(0), 1): (3, 4, 8), (at(0), None): (1, 1, None), (at(24), 1): (1, 1, 1)}
    first = next(r for r in out if r["epoch_start"] == at(0) and r["run"] == 1)
    vals = [0.1, 0.15, 0.3, 2.0]
    assert first["avg_reward"] == pytest.approx(sum(vals) / 4) and first["avg_loss"] == 1.0
    assert first["reward_variance"] == pytest.approx(sum(v * v for v in vals) / 4 - (sum(vals) / 4) ** 2)


def test_cache_of_keys_that_share_a_bucket(spark):
    """One state value and one timer serve all keys of a bucket; the answers are those of the batch operator and expired keys go."""
    events = [(i, [None, "a", "b", "c", "d"][i * i % 5], at(i * 0.9 + (5 if i % 11 == 3 else 0))) for i in range(90)]
    df = spark.createDataFrame(events, CACHE)
    want = {r["id"]: r["cache_hit"] for r in SQ.cache_ttl(df, ["key"], "ts", "id").collect()}
    events.sort(key=lambda e: e[2])
    batches = [events[i:i + 15] for i in range(0, 90, 15)]
    got = run_available(L.cache_ttl_stream(source(spark, batches, CACHE), ["key"], "ts", "id", buckets=1), "bucket")
    assert {r["id"]: r["cache_hit"] for r in got.collect()} == want
    many = [[(i, f"k{i}", at(i / 100)) for i in range(40)], [(100, "late", at(50))], [(101, "late", at(51))]]
    assert rows_held(L.cache_ttl_stream(source(spark, many[:1], CACHE), ["key"], "ts", "id", buckets=4)) <= 8
