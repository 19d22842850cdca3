"""Percentiles by selection, schemas of any depth, stored sketches, the cache table, number rendering."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalforge.functions.format import render_number_exact, render_numbers_exact
from evalforge.operators import runlog as R
from evalforge.operators import scorecache as SC
from evalforge.operators import sequence as SQ
from evalforge.operators.checkpoints import expand_checkpoints
from evalforge.operators.ordering import exact_percentile
from evalforge.session import staged
from evalforge.sources import jsonl as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("p", [0.0, 0.5, 0.99, 1.0])
def test_percentile_by_selection(spark, p):
    """Hot, small, constant, single and NULL groups; ties at the position; a bracket much smaller than the group."""
    rng = random.Random(8)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(20_000)], "ties": [float(rng.randint(0, 3)) for _ in range(3_000)],
              "one": [4.0], "same": [7.0] * 500, None: [rng.random() for _ in range(37)], "two": [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("void", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = exact_percentile(df, ["g"], "v", p, "q", accuracy=200)
    assert {r["g"]: r["q"] for r in got.collect()} == {g: pytest.approx(float(np.percentile(vs, 100 * p)), rel=1e-12) for g, vs in groups.items()}
    assert "rangepartitioning" not in plan(got)


def test_schema_of_any_depth(spark, tmp_path):
    deep = "x"
    for k in range(12, 0, -1):
        deep = {f"d{k}": deep}
    wide = {"m": {f"key {i}": i for i in range(30)}}
    rows = [deep, {"a": 1, "odd": {"in`ner: <x, y>": {"z": None}}}, {"a": {"b": "obj", "c": {"d": 1}}}, wide, {"a": {"c": "text"}}, {"l": [{"n": 1}]}]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    w = J.wide_rows(spark, str(tmp_path / "log.jsonl"), max_keys=20)
    path = ".".join(f"d{k}" for k in range(1, 13))
    assert set(w.columns) == {"ord", path, "a", "a.b", "a.c", "a.c.d", "odd.in`ner: <x, y>.z", "m", "l"}
    got = [{c: v for c, v in zip(w.columns, r) if c != "ord" and v is not None} for r in w.orderBy("ord").collect()]
    assert json.loads(got[3].pop("m")) == wide["m"]
    assert got == [{path: "x"}, {"a": "1"}, {"a.b": "obj", "a.c.d": "1"}, {}, {"a.c": "text"}, {"l": '[{"n":1}]'}]


def test_variant_schema_parser():
    text = "OBJECT<a: BIGINT, `b ``x`: OBJECT<c: ARRAY<OBJECT<q: STRING>>, d: DECIMAL(3,1)>, e: OBJECT<>>"
    assert J.parse_variant_schema(text) == {"a": "BIGINT", "b `x": {"c": "ARRAY<OBJECT<q: STRING>>", "d": "DECIMAL(3,1)"}, "e": {}}
    assert J.parse_variant_schema("VOID") == "VOID"


def test_sketches_unite_over_epochs(spark):
    """Two runs, ten epochs that share values; the estimate is within its bounds, NULLs are no value."""
    df = spark.range(60_000).selectExpr("id % 2 AS run", "id % 10 AS epoch", "CASE WHEN id % 97 = 0 THEN NULL ELSE cast(id * 7919 % 23000 AS string) END AS out")
    stored = staged(R.diversity_sketches(df, ["run", "epoch"], "out"), "sketches")
    exact = {r["run"]: r["u"] for r in df.groupBy("run").agg(F.count_distinct("out").alias("u")).collect()}
    got = {r["run"]: r for r in R.diversity_over(stored, ["run"]).collect()}
    for run, u in exact.items():
        assert got[run]["outputs"] == 30_000 and got[run]["unique_low"] <= u <= got[run]["unique_high"]
        assert abs(got[run]["unique_estimate"] / u - 1) < 0.05
    some = {r["run"]: r["outputs"] for r in R.diversity_over(stored.where("epoch < 3"), ["run"]).collect()}
    assert some == {0: 12_000, 1: 6_000}


def test_cache_table_scores_misses_and_expired_only(spark):
    docs = lambda *names: spark.createDataFrame([(n, "py") for n in names] + [(None, "py")], "prompt string, language string")
    teacher = lambda version: lambda prompt, language: F.length(prompt) + F.lit(float(version))
    cache = SC.new_cache(spark, buckets=8)
    states = lambda df: {r["prompt"]: (r["state"], r["score"]) for r in df.collect()}
    out, cache = SC.refresh(docs("a", "bb", "a"), cache, teacher(0), now=0)
    assert states(out) == {"a": ("missing", 1.0), "bb": ("missing", 2.0)}
    out, cache = SC.refresh(docs("bb", "ccc"), cache, teacher(10), now=100)
    assert states(out) == {"bb": ("hit", 2.0), "ccc": ("missing", 13.0)}
    out, cache = SC.refresh(docs("a", "ccc", "d"), cache, teacher(20), now=14400)
    assert states(out) == {"a": ("expired", 21.0), "ccc": ("hit", 13.0), "d": ("missing", 21.0)}
    assert cache.version == 3 and cache.read(spark).count() == 4
    assert {r["scored_at"] for r in cache.read(spark).collect()} == {0, 100, 14400}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = SC.look_up(docs("a", "d"), cache, 14500)
        fresh = spark.createDataFrame([("k", 1.0, 5)], SC.SCHEMA)
        for df in (found, SC.merged(cache.read(spark), fresh)):
            text = plan(df)
            join = text[text.index("SortMergeJoin"):]
            scan = [block for block in join.split("+- ") if "score_cache" in block]
            assert text.count("Exchange hashpartitioning(key") == 1 and scan, text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_like_c(spark):
    rng = random.Random(1)
    vals = [0.0, -0.0, 0.00012345, 12345.0, 12355.0, 9.9995, 9.99949999, 99995.0, 1e22, 1e23, 1e-200, 1.7e308, float("inf"), float("-inf"), float("nan"), None,
            1234.5, 1235.5, -1234.5, 0.12345, 1e-6, 0.1, 0.001]
    for _ in range(3000):
        vals += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0], rng.randint(-99999, 99999) / rng.choice([2, 4, 8, 32, 1024]),
                 (rng.randint(1000, 9999) + 0.5) * 10.0 ** rng.randint(-30, 30)]
    vals = [v for v in vals if v is None or v != v or v == 0 or abs(v) > 1e-280]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(4)
    for digits in (4, 1, 12):
        for r in df.select("v", render_number_exact(F.col("v"), digits).alias("s")).collect():
            assert r["s"] == (None if r["v"] is None or r["v"] != r["v"] else f"%.{digits}g" % r["v"])
    assert "Python" not in plan(df.select(render_number_exact(F.col("v"))))


def test_ema_keeps_the_columns(spark):
    rows = [("r", i, float(i % 5), f"note {i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "run string, step int, x double, note string")
    for alpha in (0.3, 1.0):
        out = SQ.ema(df, "run", "step", "x", alpha).orderBy("step").collect()
        e = None
        for r, (_, i, x, note) in zip(out, rows):
            e = x if e is None else alpha * e + round(1 - alpha, 12) * x
            assert r["note"] == note and r["ema"] == pytest.approx(e, rel=1e-9, abs=1e-12)


def test_checkpoints_beside_scores(spark):
    scored = spark.createDataFrame([(0.5,), (0.7,)], "score double")
    listing = spark.createDataFrame([("a", 1), ("b", 2)], "checkpoint string, step int")
    got = sorted((r["score"], r["ckpt"]["checkpoint"]) for r in expand_checkpoints(scored, listing).collect())
    assert got == [(0.5, "a"), (0.5, "b"), (0.7, "a"), (0.7, "b")]
    assert expand_checkpoints(scored, listing.limit(0)).count() == 0


def test_cells_rendered_together(spark):
    """Several cells in one expression read as each alone, missing and odd values included; none is rendered in Python."""
    rows = [(0.00012345, 2.5, None), (float("nan"), -0.0, 1e-9), (float("inf"), 12345.0, 12355.0), (None, None, 99995.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    together = df.select(*cols, render_numbers_exact(cols).alias("t"), *[render_number_exact(c).alias(f"s{i}") for i, c in enumerate(cols)])
    got = together.collect()
    assert [r["t"] for r in got] == [[r["s0"], r["s1"], r["s2"]] for r in got]
    assert [r["t"] for r in got] == [[None if v is None or v != v else "%.4g" % v for v in row] for row in rows]
    assert "Python" not in plan(df.select(render_numbers_exact(cols)))


def test_percentile_moves_no_row_to_its_group(spark):
    """Brackets of large groups are broadcast, whatever the threshold; small groups need none."""
    rows = [(g, float(i * 7919 % n)) for g, n in (("a", 3000), (None, 2500), ("b", 7), ("c", 1)) for i in range(n)] + [("d", None)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = exact_percentile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 0.99, "q", accuracy=100)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {r["g"]: r["q"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    want = {g: np.quantile([v for h, v in rows if h == g], 0.99) for g in ("a", None, "b", "c")}
    assert found.keys() == want.keys() and all(abs(found[g] - want[g]) < 1e-9 for g in want)
