"""Structured Streaming forms of the run-log operators.

* X1 live batch log: text lines parsed with the lenient JSON rule; rows and
  rejects leave the same micro-batch (``runner.run_split``).
* J8 requests and answers as two streams: a left outer join on the id within the
  timeout; a request without an answer on time comes out once, as ``timeout``.
* X2/X3 event-time windows (tumbling, sliding) with a watermark, and the epoch
  rollup as a second aggregate over the windows of the first.
* X4 activity sessions with ``session_window``.
* X5 live de-duplication with ``dropDuplicatesWithinWatermark``.
* X6 score-cache expiry, X7 clean-up cooldown and health check as stateful
  processors (``transformWithState``): a few numbers a key in the state store,
  timers by event time that clear the state of a key nobody can hit any more, and
  an initial state taken from the batch operators.  Rows of a micro-batch are
  sorted by event order before the scan, as arrival order is arbitrary.
* X8 late rows: a row whose window the watermark has passed is dropped; a
  query and a test hold rows on both sides of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runlog import (GC_COOLDOWN_BATCHES, HEALTH_CACHE_GB, HEALTH_FRAGMENTATION_GB, HEALTH_GEN_BOTTLENECK_PCT,
                                HEALTH_GEN_TARGET_TPS, HEALTH_GRACE_BATCHES, HEALTH_GROWTH_GB, HEALTH_INTERVAL_BATCHES)
from ..operators.sequence import CACHE_TTL_SECONDS
from ..sources.jsonl import outcome_columns, tag_lines, with_detail

REQUEST_TIMEOUT_SECONDS = 240  # the generation worker's timeout (fixed value)
IDLE_RUN_SECONDS = 30 * 86400  # a run without batches for so long is over
CACHE_BUCKETS = 4096  # of the score cache's keys


def event_time(ts: Column) -> Column:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast in a UTC session."""
    return ts.cast("timestamp")


def parse_lines(lines: DataFrame, schema: str) -> dict[str, DataFrame]:
    """``rows`` and ``rejects`` (line, reason, detail) of text lines; blank lines dropped."""
    tagged = tag_lines(lines.select(F.col("value").alias("line")))
    return {"rows": tagged.where("reason IS NULL").select(F.from_json("line", schema).alias("r")).select("r.*"),
            "rejects": with_detail(tagged.where("reason IS NOT NULL"))}


def tumbling_stats(stream: DataFrame, ts: str, keys: Sequence[str], value: str, size: str,
                   watermark: str) -> DataFrame:
    """Count, mean and max of ``value`` per tumbling window and key."""
    s = stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", watermark)
    g = s.groupBy(F.window("_et", size).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                    "n", "avg_value", "max_value")


def sliding_stats(stream: DataFrame, ts: str, keys: Sequence[str], value: str, size: str, slide: str,
                  watermark: str) -> DataFrame:
    """Sliding windows (each row lands in size/slide windows)."""
    s = stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", watermark)
    g = s.groupBy(F.window("_et", size, slide).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "max_value")


def activity_sessions(stream: DataFrame, ts: str, keys: Sequence[str], gap: str, watermark: str) -> DataFrame:
    """Sessions of activity per key, closed after ``gap`` of silence."""
    s = stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", watermark)
    g = s.groupBy(F.session_window("_et", gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def live_dedupe(stream: DataFrame, ts: str, keys: Sequence[str], watermark: str) -> DataFrame:
    """First arrival per key wins while the key is inside the watermark."""
    s = stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", watermark)
    return s.dropDuplicatesWithinWatermark(list(keys))


def epoch_rollup(stream: DataFrame, ts: str, run: str, reward: str, loss: str, tokens: str, batch: str = "1 hour",
                 epoch: str = "1 day", watermark: str = "2 hours") -> DataFrame:
    """A9 per batch window, then A10 per epoch window over the batch windows; an epoch comes out once, when the
    watermark has passed its end.  ``reward`` and ``loss`` are summed as DECIMAL(18, 6), so the order of rows does not matter.
    Null values count as rows but not in the means."""
    dec = lambda c: F.col(c).cast("decimal(18, 6)")
    s = stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", watermark)
    batches = s.groupBy(F.window("_et", batch).alias("w"), run).agg(
        F.count(F.lit(1)).alias("n"), F.count(reward).alias("nr"), F.sum(dec(reward)).alias("r"), F.sum(dec(reward) * dec(reward)).alias("rr"),
        F.count(loss).alias("nl"), F.sum(dec(loss)).alias("l"), F.sum(tokens).alias("tok"),
        F.min(reward).alias("low"), F.max(reward).alias("high"))
    e = batches.groupBy(F.window(F.window_time("w"), epoch).alias("e"), run).agg(
        F.sum("n").alias("num_samples"), F.count(F.lit(1)).alias("num_batches"), F.sum("nr").alias("nr"), F.sum("r").alias("r"),
        F.sum("rr").alias("rr"), F.sum("nl").alias("nl"), F.sum("l").alias("l"), F.sum("tok").alias("api_tokens"),
        F.min("low").alias("reward_min"), F.max("high").alias("reward_max"))
    mean = F.try_divide(F.col("r").cast("double"), F.col("nr"))
    return e.select(F.col("e.start").alias("epoch_start"), F.col("e.end").alias("epoch_end"), run, "num_batches", "num_samples",
                    mean.alias("avg_reward"), F.try_divide(F.col("l").cast("double"), F.col("nl")).alias("avg_loss"),
                    (F.try_divide(F.col("rr").cast("double"), F.col("nr")) - mean * mean).alias("reward_variance"),
                    "reward_min", "reward_max", "api_tokens")


def answered_in_time(requests: DataFrame, responses: DataFrame, asked_at: str, answered_at: str,
                     timeout_seconds: int = REQUEST_TIMEOUT_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """S7 + J8 live: requests (``parse_requests`` columns and ``asked_at``) with the answer (``parse_responses`` columns and
    ``answered_at``) to the same id that came within the timeout, both ends included.

    An answered request comes out with its answer.  The others come out once, with nulls, when the watermark of both
    streams has passed ``asked_at`` + timeout: a late answer counts no more than none, and the state of a request
    is gone.  Refused requests and requests without an id meet no answer and keep the outcome they have."""
    asks = (F.col("request_status") == "ok") & (F.col("id") >= 0)
    rq = (requests.withColumn("_asked", event_time(F.col(asked_at))).withWatermark("_asked", watermark)
          .withColumn("_ask", F.when(asks, F.col("id"))))
    rs = (responses.withColumn("_said", event_time(F.col(answered_at))).withWatermark("_said", watermark)
          .withColumnRenamed("id", "_rid"))
    on_time = F.expr(f"_ask = _rid AND _said >= _asked AND _said <= _asked + INTERVAL {int(timeout_seconds)} SECONDS")
    j = rq.join(rs, on_time, "left_outer")
    return j.withColumns(outcome_columns()).drop("_ask", "_rid", "_asked", "_said")


# ------------------------------ stateful --------------------------------------

def _micros(c: Column) -> Column:
    return F.unix_micros(c)


class _Stateful(StatefulProcessor):
    """One value a key, dropped by a timer once it is out of date.

    A key has one timer at a time: if its value has moved on when the timer fires, the timer is set anew."""

    schema = ""
    out: Sequence[str] = ()  # names of the output columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value, self.row = handle, handle.getValueState("value", self.schema), Row(*self.out)

    def expiry_ms(self, value: tuple) -> int:
        raise NotImplementedError

    def keep(self, value: tuple, before: tuple | None, watermark_ms: int) -> None:
        """Store ``value`` unless the watermark has passed its expiry."""
        due = self.expiry_ms(value)
        if due <= watermark_ms:
            if before is not None:
                self.value.clear()
            return
        if before is None or tuple(before) != tuple(value):
            self.value.update(value)
        if before is None:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.value.get()
        if held is not None:
            due = self.expiry_ms(held)
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
            else:
                self.value.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        value = tuple(initialState[f.split()[0]] for f in self.schema.split(", "))
        self.value.update(value)
        self.handle.registerTimer(self.expiry_ms(value))

    def close(self) -> None:
        pass


class ScoreCache(_Stateful):
    """The stamps of the last misses of a bucket's keys; a stamp goes once the watermark has passed it by the TTL.

    A call, a state value and a timer serve all keys of a bucket: their cost is that of the buckets, not of the keys.
    ``timer`` is when the bucket's next stamp goes."""

    def __init__(self, keys: Sequence[str], tie: str, ttl_us: int, schema: str):
        self.keys, self.out, self.tie, self.ttl, self.schema = list(keys), (*keys, tie, "cache_hit"), tie, ttl_us, schema

    def due(self, stamp: int) -> int:
        return (stamp + self.ttl) // 1000 + 1

    def hold(self, stamps: dict[tuple, int], before: int | None, watermark_ms: int) -> None:
        """Store the stamps that the watermark has not passed; ``before``: the timer that is set."""
        live = {k: v for k, v in stamps.items() if self.due(v) > watermark_ms}
        timer = self.due(min(live.values())) if live else None
        if before is not None and before != timer:
            self.handle.deleteTimer(before)
        if timer is None:
            self.value.clear()
            return
        if before != timer:
            self.handle.registerTimer(timer)
        self.value.update((timer, [(*k, v) for k, v in live.items()]))

    def held(self) -> tuple[int | None, dict[tuple, int]]:
        value = self.value.get()
        return (None, {}) if value is None else (value[0], self.stamps(value[1]))

    @staticmethod
    def stamps(held) -> dict[tuple, int]:
        parts = (tuple(x.values() if isinstance(x, dict) else x) for x in held)  # initial rows come as dicts
        return {x[:-1]: x[-1] for x in parts}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        timer, stamps = self.held()
        events = []
        for r in rows:
            k = tuple(r[c] for c in self.keys)
            if r["_t"] is None:  # without a time: a miss that stamps nothing
                yield self.row(*k, r[self.tie], False)
            else:
                events.append((r["_t"], r[self.tie], k))
        for t, tie, k in sorted(events, key=lambda e: (e[0], e[1] is None, e[1] or 0)):
            stamp = stamps.get(k)
            hit = stamp is not None and 0 <= t - stamp < self.ttl
            if stamp is None or t - stamp >= self.ttl:
                stamps[k] = t
            yield self.row(*k, tie, hit)
        if stamps:
            self.hold(stamps, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timer, stamps = self.held()
        if stamps:  # the timer that fires is gone by itself
            fired = expiredTimerInfo.getExpiryTimeInMs()
            self.hold(stamps, None if fired == timer else timer, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.hold(self.stamps(initialState["held"]), None, -1)


def _ddl(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def cache_ttl_stream(stream: DataFrame, keys: Sequence[str], ts: str, tie: str,
                     ttl_seconds: int = CACHE_TTL_SECONDS, watermark: str = "1 hour",
                     initial: DataFrame | None = None, buckets: int = CACHE_BUCKETS) -> DataFrame:
    """Score-cache expiry; output: keys, tie, cache_hit.

    Event time decides, not arrival: a row is a hit only if the stamp is not after it and younger
    than the TTL; a row older than the stamp is a miss that leaves the stamp alone.  ``initial`` (keys,
    stamp in microseconds) starts the stream where a batch run ended (``sequence.cache_stamps``).
    State is kept by ``buckets`` of keys (by hash); more of them for more keys that are live at once."""
    s = (stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", watermark)
         .select(*keys, tie, "_et", _micros(F.col("_et")).alias("_t")))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(int(buckets))).alias("_bucket")
    stamps = None
    if initial is not None:
        own = initial.select(*[F.col(k).cast(s.schema[k].dataType).alias(k) for k in keys], F.col("stamp").cast("long").alias("stamp"))
        stamps = own.groupBy(bucket).agg(F.collect_list(F.struct(*keys, "stamp")).alias("held")).groupBy("_bucket")
    parts = ", ".join(f"{k}: {s.schema[k].dataType.simpleString()}" for k in keys)
    cache = ScoreCache(keys, tie, int(ttl_seconds) * 1_000_000, f"timer LONG, held ARRAY<STRUCT<{parts}, stamp: BIGINT>>")
    return s.select("*", bucket).groupBy("_bucket").transformWithState(
        cache, f"{_ddl(s, [*keys, tie])}, cache_hit BOOLEAN", "append", "eventTime", stamps)


class Cooldown(_Stateful):
    """Step of the last clean-up of a run, and the run's latest event time."""

    schema = "last LONG, seen LONG"

    def __init__(self, run: str, step: str, value: str, threshold: float, cooldown: int, idle_seconds: int):
        self.out = (run, step, "wants_gc", "triggered")
        self.step, self.of, self.threshold, self.cooldown, self.idle = step, value, threshold, cooldown, idle_seconds

    def expiry_ms(self, value: tuple) -> int:
        return value[-1] // 1000 + self.idle * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.value.get()
        last, seen = (None, 0) if held is None else held
        for r in sorted(rows, key=lambda r: r[self.step]):
            seen = max(seen, r["_t"] or 0)
            wants = _number(r[self.of]) is not None and r[self.of] > self.threshold
            fires = wants and (last is None or r[self.step] - last >= self.cooldown)
            last = r[self.step] if fires else last
            yield self.row(*key, r[self.step], wants, fires)
        self.keep((last, seen), held, timerValues.getCurrentWatermarkInMs())


def gc_cooldown_stream(stream: DataFrame, run: str, step_col: str, fragmentation_gb: str, ts: str,
                       threshold: float = HEALTH_FRAGMENTATION_GB, cooldown: int = GC_COOLDOWN_BATCHES,
                       watermark: str = "1 hour", idle_seconds: int = IDLE_RUN_SECONDS) -> DataFrame:
    """Clean-up trigger with cooldown over a live batch log with event time ``ts``; a run without a batch for
    ``idle_seconds`` is forgotten.  Output: run, step, wants_gc, triggered."""
    s = (stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", watermark)
         .select(run, step_col, fragmentation_gb, "_et", _micros(F.col("_et")).alias("_t")))
    return s.groupBy(run).transformWithState(
        Cooldown(run, step_col, fragmentation_gb, float(threshold), int(cooldown), int(idle_seconds)),
        f"{_ddl(s, [run, step_col])}, wants_gc BOOLEAN, triggered BOOLEAN", "append", "eventTime")


def _number(v) -> float | None:
    return None if v is None or math.isnan(v) else float(v)


class Health(_Stateful):
    """Previous fragmentation, last clean-up, sum and count of the baseline, latest event time."""

    schema = "prev DOUBLE, last LONG, bsum DOUBLE, bn LONG, seen LONG"

    def __init__(self, run: str, step: str, reward: str, share: str, tps: str, frag: str, cache: str, baseline_batches: int,
                 idle_seconds: int):
        self.out = (run, step, "status", "issues", "gc_triggered")
        self.names, self.baseline, self.idle = (step, reward, share, tps, frag, cache), baseline_batches, idle_seconds

    expiry_ms = Cooldown.expiry_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.value.get()
        prev, last, bsum, bn, seen = (None, None, 0.0, 0, 0) if held is None else held
        for r in sorted(rows, key=lambda r: r[self.names[0]]):
            step, seen = int(r[self.names[0]]), max(seen, r["_t"] or 0)
            reward, share, tps, frag, cache = (_number(r[c]) for c in self.names[1:])
            growth = None if prev is None or frag is None else frag - prev
            prev = frag
            if step <= self.baseline and reward is not None:
                bsum, bn = bsum + reward, bn + 1
            fires = frag is not None and frag > HEALTH_FRAGMENTATION_GB and (last is None or step - last >= GC_COOLDOWN_BATCHES)
            last = step if fires else last
            if step > HEALTH_GRACE_BATCHES and step % HEALTH_INTERVAL_BATCHES == 0:
                gain = None if bn == 0 or reward is None else reward - bsum / bn
                issues = [name for name, bad in (
                    ("gen_bottleneck", share is not None and share > HEALTH_GEN_BOTTLENECK_PCT),
                    ("low_gen_tps", tps is not None and tps < HEALTH_GEN_TARGET_TPS),
                    ("fragmentation", frag is not None and frag > HEALTH_FRAGMENTATION_GB),
                    ("cache_size", cache is not None and cache > HEALTH_CACHE_GB),
                    ("fragmentation_growth", growth is not None and growth > HEALTH_GROWTH_GB),
                    ("no_gain_vs_baseline", gain is not None and gain <= 0)) if bad]
                yield self.row(*key, step, "OK" if not issues else "WARN", ",".join(issues), fires)
        self.keep((prev, last, bsum, bn, seen), held, timerValues.getCurrentWatermarkInMs())


def health_stream(stream: DataFrame, run: str, step_col: str, reward: str, gen_share_pct: str, gen_tps: str,
                  fragmentation_gb: str, cache_gb: str, ts: str, baseline_batches: int = 15, watermark: str = "1 hour",
                  idle_seconds: int = IDLE_RUN_SECONDS) -> DataFrame:
    """X7 live health check (W13 + W9 + W14 on a live batch-metrics log with event time ``ts``).

    State per run: previous fragmentation (growth), last clean-up trigger
    (cooldown) and the running baseline over the first ``baseline_batches``
    batches, so a check due before the baseline is complete uses the
    batches seen so far.  Emits one row per due batch (after the grace
    period, every interval) with OK/WARN, the issues, and whether this batch triggered a clean-up."""
    cols = [step_col, reward, gen_share_pct, gen_tps, fragmentation_gb, cache_gb]
    s = (stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", watermark)
         .select(run, *cols, "_et", _micros(F.col("_et")).alias("_t")))
    return s.groupBy(run).transformWithState(
        Health(run, *cols, int(baseline_batches), int(idle_seconds)),
        f"{_ddl(s, [run])}, {step_col} INT, status STRING, issues STRING, gc_triggered BOOLEAN", "append", "eventTime")
