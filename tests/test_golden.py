"""Golden values (FIXTURES.md section 3) for single operators."""

import math

import pytest
from pyspark.sql import functions as F

from evalforge.functions import extract as X
from evalforge.functions import rubric as R
from evalforge.functions import scoring as S
from evalforge.functions.catalog import SAMPLE_PROMPTS
from evalforge.functions.format import render_number_exact
from evalforge.operators import checkpoints as C
from evalforge.operators import corpus as K


def one(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


DIFFICULTY = [
    ("Implement a thread-safe queue with error handling and edge case validation", "cpp", 3 / 6, 0, 0, 0, 0.15, 74, 90.5575),
    ("Write a function to parse a JSON string safely", "rust", 3 / 6, 0, 0, 0, 0.15, 46, 58.85125),
    ("Implement a thread-safe singleton pattern in C++", "cpp", 1 / 6, 1 / 6, 0, 0, 0.10, 48, 56.76),
    ("Trace the capital breakfast", "python", 1 / 6, 1 / 6, 1 / 6, 0, 0.133333, 27, 29.7),
    ("deserialize nullptr", "python", 4 / 6, 0, 0, 0, 0.20, 19, 21.85),
    ("Write a function to merge two sorted linked lists", "python", 0, 0, 0, 0, 0, 49, 49.0),
]


def test_difficulty_golden(spark):
    rows = one(spark, [(p, lg) for p, lg, *_ in DIFFICULTY], "prompt string, language string",
               *R.difficulty_columns(F.col("prompt"), F.col("language")))
    for r, (p, lg, c, q, e, d, dem, chars, idx) in zip(rows, DIFFICULTY):
        assert r["demand_correctness"] == pytest.approx(c)
        assert r["demand_code_quality"] == pytest.approx(q)
        assert r["demand_efficiency"] == pytest.approx(e)
        assert r["demand_documentation"] == pytest.approx(d)
        assert r["rubric_demand"] == pytest.approx(dem, abs=1e-6)
        assert r["char_len"] == chars
        assert r["index"] == pytest.approx(idx, abs=1e-6)
        assert r["token_len"] == 0.0


def test_rubric_regex_boundaries(spark):
    texts = ["it must run", "mustard", "éconstraint", "10 ms budget", "10ms", "a10 ms", "up to 5 rows",
             "should", "guarantees"]
    rows = one(spark, [(t,) for t in texts], "t string",
               F.col("t").rlike(R.portable_regex(R.CORRECTNESS_PATTERN)).alias("c"),
               F.col("t").rlike(R.portable_regex(R.EFFICIENCY_PATTERNS[0])).alias("e0"),
               F.col("t").rlike(R.portable_regex(R.EFFICIENCY_PATTERNS[1])).alias("e1"))
    got = [(r["c"], r["e0"], r["e1"]) for r in rows]
    assert got == [(True, False, False), (False, False, False), (False, False, False), (False, True, False),
                   (False, True, False), (False, False, False), (False, False, True), (True, False, False),
                   (False, False, False)]


def test_heuristic_golden(spark):
    codes = ["", "a" * 51, "def f", "a\nb", "def f():\n" + "a" * 60]
    rows = one(spark, [(c,) for c in codes], "c string", S.heuristic_score(F.col("c")).alias("s"))
    assert [round(r["s"], 10) for r in rows] == [0.5, 0.6, 0.7, 0.6, 0.9]


def test_reward_golden(spark):
    r = one(spark, [(0.85, 0.92)], "s double, t double", S.normalized_reward(F.col("s"), F.col("t")).alias("r"))
    assert r[0]["r"] == pytest.approx(0.923912, abs=1e-6)


EXTRACT = [
    ("plan\n```python\nx=1\n```\nend", "python", "x=1"),
    ("```js\nx\n```", "python", "```js\nx\n```"),
    ("```\n\n```", "rust", ""),
    ("```python\nx=1\ny=2", "python", "x=1\ny=2"),
    ("```cp\nint a;\n```", "cpp", "int a;"),
    ("think\nCode:\nfoo()\nSolution:\nbar()", "python", "foo()\nSolution:\nbar()"),
    ("```js\na\n```\nmid\n```\nb\n```", "python", "mid"),
    ("  just text \n", "rust", "just text"),
    ("", "python", ""),
]


def test_extract_golden(spark):
    rows = one(spark, [(t, lg) for t, lg, _ in EXTRACT], "t string, lg string",
               X.extract_code_from_reasoning(F.col("t"), F.col("lg")).alias("code"))
    assert [r["code"] for r in rows] == [e for _, _, e in EXTRACT]


def test_first_block_golden(spark):
    texts = ["Intro\n```python\nx=1\n```\ntail", "```py\na\n```\n```py\nb\n```", "```c++\nx\n```", "no fence"]
    rows = one(spark, [(t,) for t in texts], "t string", X.first_fenced_block(F.col("t")).alias("b"))
    assert rows[0]["b"] == "Intro\n```python\nx=1\n```"
    assert rows[1]["b"] == "```py\na\n```"
    assert rows[3]["b"] is None


def test_strip_prompt(spark):
    rows = one(spark, [("P\n  code ", "P"), ("xP code", "P"), ("code ", "Z")], "o string, p string",
               X.strip_prompt_prefix(F.col("o"), F.col("p")).alias("a"),
               X.strip_prompt_contained(F.col("o"), F.col("p")).alias("b"),
               X.extraction_guard(F.col("o"), F.lit("  ")).alias("g"))
    assert [r["a"] for r in rows] == ["code", "xP code", "code "]
    assert [r["b"] for r in rows] == ["code", "code", "code"]
    assert [r["g"] for r in rows] == ["P\n  code ", "xP code", "code "]


def test_seed_and_names(spark):
    from evalforge.operators.compare import sample_seed
    r = one(spark, [(3, 2)], "i int, j int", sample_seed(0, F.col("i"), F.col("j")).alias("s"),
            sample_seed(None, F.col("i"), F.col("j")).alias("n"))
    assert r[0]["s"] == 3002 and r[0]["n"] is None
    names = ["checkpoint-e2-end-gs1", "checkpoint-e2-b10-gs1", "checkpoint-gs500-e3-b12", "checkpoint-final-gs7",
             "checkpoint-500", "checkpoint-1000", "other"]
    rows = one(spark, [(n,) for n in names], "n string", F.col("n"), *C.parse_checkpoint_name(F.col("n")),
               C.is_checkpoint(F.col("n")).alias("ok"))
    got = {r["n"]: (r["epoch"], r["batch"], r["step"], r["is_end"], r["is_final"], r["ok"]) for r in rows}
    assert got["checkpoint-e2-end-gs1"] == (2, None, 1, True, False, True)
    assert got["checkpoint-e2-b10-gs1"] == (2, 10, 1, False, False, True)
    assert got["checkpoint-gs500-e3-b12"] == (3, 12, 500, False, False, True)
    assert got["checkpoint-final-gs7"] == (None, None, 7, False, True, True)
    assert got["checkpoint-500"][2] == 500 and got["other"][5] is False


def test_render_golden(spark):
    vals = [0.5, 12345.678, 0.00001234, 1.0, 123.45678]
    want = ["0.5", "1.235e+04", "1.234e-05", "1", "123.5"]
    rows = one(spark, [(v,) for v in vals], "v double", S.render_number(F.col("v")).alias("jvm"),
               render_number_exact(F.col("v")).alias("c"))
    assert [r["jvm"] for r in rows] == want
    assert [r["c"] for r in rows] == want


def test_relative_and_duration(spark):
    from evalforge.operators.compare import relative_improvement
    df = spark.createDataFrame([(0.6234, 0.1657)], "avg_baseline_score double, avg_improvement double")
    r = relative_improvement(df).first()["relative_improvement_pct"]
    assert round(r, 2) == 26.58
    zero = spark.createDataFrame([(0.0, 0.1)], "avg_baseline_score double, avg_improvement double")
    assert relative_improvement(zero).first()["relative_improvement_pct"] is None
    d = one(spark, [(8130.5,)], "s double", S.duration_text(F.col("s")).alias("d"))[0]["d"]
    assert d == "2h 15m 30s (8130.5 seconds)"


def test_best_checkpoint_golden(spark):
    df = spark.createDataFrame([("checkpoint-1000", 0.5), ("checkpoint-500", 0.7), ("checkpoint-600", 0.7),
                                ("checkpoint-700", None)], "checkpoint string, avg_fine_tuned_reward_normalized double")
    r = C.best_checkpoint(df).first()
    assert (r["best_checkpoint"], r["best_metric_value"], r["num_checkpoints"]) == ("checkpoint-500", 0.7, 4)
    nulls = spark.createDataFrame([("checkpoint-1", None)], "checkpoint string, avg_fine_tuned_reward_normalized double")
    r = C.best_checkpoint(nulls).collect()
    assert len(r) == 1 and r[0]["best_checkpoint"] is None


def test_dedupe_golden(spark):
    rows = [("a", "python", 1), ("a", "", 2), ("a", None, 3), ("a", "cpp", 4), (None, "cpp", 5), ("", "cpp", 6)]
    df = spark.createDataFrame(rows, "prompt string, language string, ord long")
    kept = sorted(r["ord"] for r in K.dedupe_first(df).collect())
    assert kept == [1, 4, 5]


def test_quarter_buckets(spark):
    from evalforge.operators.sequence import load_phases
    df = spark.createDataFrame([("r", float(i), float(i), float(i), i) for i in range(10)],
                               "run string, elapsed double, p double, s double, t int")
    ph = load_phases(df, "run", ["t"], "elapsed", "p", "s").orderBy("phase").collect()
    assert [r["num_samples"] for r in ph] == [2, 2, 2, 4]
    small = spark.createDataFrame([("r", 1.0, 1.0, 1.0, i) for i in range(4)],
                                  "run string, elapsed double, p double, s double, t int")
    assert load_phases(small, "run", ["t"], "elapsed", "p", "s").count() == 0


def test_sample_corpus_golden(spark):
    for n, want in ((100, {"python": 35, "cpp": 35, "rust": 30}), (20, {"python": 10, "cpp": 10})):
        df = K.sample_corpus(spark, n, SAMPLE_PROMPTS)
        got = {r["language"]: r["c"] for r in df.groupBy("language").agg(F.count("*").alias("c")).collect()}
        assert got == want
        assert df.count() == n
    ids = [r["id"] for r in K.sample_corpus(spark, 20, SAMPLE_PROMPTS).orderBy("ord").collect()]
    assert ids[:3] == ["python_0_0", "python_0_1", "python_1_0"]


def test_truncate(spark):
    rows = one(spark, [("abcdef",)], "s string", S.truncate_text(F.col("s"), 3).alias("a"),
               S.truncate_text(F.col("s"), 0).alias("b"), S.truncate_text(F.col("s"), "x").alias("c"),
               S.truncate_text(F.col("s"), 6).alias("d"))
    assert (rows[0]["a"], rows[0]["b"], rows[0]["c"], rows[0]["d"]) == ("abc...", "abcdef", "abcdef", "abcdef")


def test_sanitize(spark):
    rows = one(spark, [(float("nan"),), (float("inf"),), (1.7,), (-0.2,), (0.4,)], "x double",
               S.sanitize_reward(F.col("x")).alias("y"))
    assert [r["y"] for r in rows] == [0.0, 0.0, 1.0, 0.0, 0.4]
    assert not math.isnan(rows[0]["y"])


def test_split_counts_absent_split(spark):
    df = spark.createDataFrame([("train",), ("train",), ("evaluation",)], "split string")
    got = {r["split"]: r["count"] for r in K.split_counts(df).collect()}
    assert got == {"train": 2, "validation": 0, "evaluation": 1}
    card = K.dataset_card(K.split_counts(df)).first()
    assert (card["train_count"], card["val_count"], card["eval_count"]) == (2, 0, 1)
    assert "- **Validation Set**: 0 examples" in card["card"]


def test_hash_split_keeps_duplicates_together(spark):
    df = spark.createDataFrame([("same prompt|python",)] * 5 + [(f"p{i}|rust",) for i in range(200)], "k string")
    rows = df.select("k", K.assign_split(F.col("k")).alias("s")).collect()
    assert len({r["s"] for r in rows if r["k"] == "same prompt|python"}) == 1
    assert {r["s"] for r in rows} <= {"train", "validation", "evaluation"}
