"""Scan of composed maps against the sequential loop."""

import random

import pytest

from evalforge.operators import recurrence
from evalforge.operators import sequence as SQ


def _loop(xs, alpha):
    e, out = None, []
    for x in xs:
        if x is None:
            out.append(None)
            continue
        e = x if e is None else alpha * e + round(1 - alpha, 12) * x
        out.append(e)
    return out


@pytest.mark.parametrize("alpha", [0.8, 0.99, 0.9999, 0.0])
def test_scan_matches_loop(spark, monkeypatch, alpha):
    monkeypatch.setattr(recurrence, "CHUNK", 7)          # several levels on few rows
    rnd = random.Random(9)
    runs = {"r1": [1000.0] + [rnd.random() for _ in range(1500)], "r2": [rnd.random() for _ in range(39)], "r3": [5.0],
            None: [rnd.random() for _ in range(50)], "gaps": [None, 3.0, None, 4.0, None, 1.0], "void": [None, None]}
    rows = [(r, i, x) for r, xs in runs.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "run string, step int, x double")
    got = {(r["run"], r["step"]): r["ema"] for r in SQ.ema(df, "run", "step", "x", alpha).collect()}
    assert len(got) == len(rows)
    for run, xs in runs.items():
        for i, want in enumerate(_loop(xs, alpha)):
            assert got[(run, i)] is None if want is None else got[(run, i)] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_one_long_run(spark):
    """One run of 300,000 rows: every value, at an alpha that remembers thousands of rows."""
    n = 300_000
    df = spark.range(n).selectExpr("'only' AS run", "id AS step", "cast((id * 7919) % 1009 AS double) AS x")
    got = [r["ema"] for r in SQ.ema(df, "run", "step", "x", 0.999).orderBy("step").select("ema").collect()]
    assert got == pytest.approx(_loop([float((i * 7919) % 1009) for i in range(n)], 0.999), rel=1e-9)


def test_null_keys_are_keys(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    ev = [(k, i, t0 + dt.timedelta(hours=h)) for i, (k, h) in enumerate([(None, 0), ("a", 0), (None, 1), ("a", 5), (None, 4), (None, 5)])]
    ev.append((None, 99, None))
    df = spark.createDataFrame(ev, "key string, id long, ts timestamp")
    got = {r["id"]: r["cache_hit"] for r in SQ.cache_ttl(df, ["key"], "ts", "id").collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False, 5: True, 99: False}
    b = spark.createDataFrame([(None, i, f) for i, f in enumerate([11.0, 12.0, None, 13.0] + [20.0] * 9)],
                              "run string, step int, frag double")
    fired = [r["step"] for r in SQ.gc_cooldown(b, "run", "step", "frag").where("triggered").orderBy("step").collect()]
    assert fired == [0, 10]


def test_along_spans(spark):
    """Running sums and lags over span borders, gaps, NULL values, NULL and hot groups."""
    from pyspark.sql import functions as F
    from evalforge.operators.ordering import along
    rnd = random.Random(3)
    rows = [(g, s, None if rnd.random() < .1 else float(rnd.randint(0, 9))) for g, top in (("hot", 900), (None, 60), ("x", 3))
            for s in sorted(rnd.sample(range(2 * top), top))]
    df = spark.createDataFrame(rows, "g string, s int, v double").repartition(5)
    got = {(r["g"], r["s"]): (r["total"], r["was"]) for r in
           along(df, ["g"], "s", {"total": F.col("v")}, {"was": F.col("v")}, size=16).collect()}
    state = {}
    for g, s, v in rows:
        total, last = state.get(g, (None, None))
        total = total if v is None else (total or 0.0) + v
        assert got[(g, s)] == (total, last)
        state[g] = (total, v)
    assert len(got) == len(rows)
