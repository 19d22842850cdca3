"""Hot keys: one key holds a third of all rows.  Results must equal a
brute-force computation and must not depend on the partition count."""

import random

import pytest
from pyspark.sql import functions as F

from evalforge.operators import compare as CMP
from evalforge.operators import corpus as K
from evalforge.operators.chat import chat_transcripts
from evalforge.operators.ordering import group_rank
from evalforge.operators.sequence import cache_ttl


def _skewed_rows(n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        key = "HOT" if hot else f"k{rnd.randint(0, 200)}"
        rows.append((i, key, rnd.choice(["python", "cpp", "", None]), rnd.random()))
    return rows


def test_dedupe_hot_key(spark):
    rows = _skewed_rows()
    df = spark.createDataFrame(rows, "ord long, prompt string, language string, v double")
    want, seen = [], set()
    for o, p, lg, _ in rows:
        k = (p or "", lg or "python")
        if k not in seen:
            seen.add(k)
            want.append(o)
    for parts in (1, 7, 29):
        got = sorted(r["ord"] for r in K.dedupe_first(df.repartition(parts)).select("ord").collect())
        assert got == sorted(want)


def test_group_rank_hot_group(spark):
    rows = _skewed_rows()
    df = spark.createDataFrame(rows, "ord long, prompt string, language string, v double")
    ranked = group_rank(df, ["prompt"], [F.col("v").asc(), F.col("ord").asc()], num_partitions=11)
    got = {r["ord"]: (r["rank"], r["rank_count"]) for r in ranked.collect()}
    by_key = {}
    for o, p, _, v in rows:
        by_key.setdefault(p, []).append((v, o))
    for p, items in by_key.items():
        for rank, (_, o) in enumerate(sorted(items), start=1):
            assert got[o] == (rank, len(items))


def test_compare_hot_prompt(spark):
    rnd = random.Random(3)
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 50), i, m, float(rnd.randint(0, 10)) / 10)
            for i in range(1500) for m in ("baseline", "fine_tuned")]
    df = spark.createDataFrame(rows, "ord long, j long, model string, score double")
    per = {r["ord"]: r for r in CMP.compare_prompts(df, aggregate="max").repartition(5).collect()}
    for o in {r[0] for r in rows}:
        b = max(s for k, _, m, s in rows if k == o and m == "baseline")
        f = max(s for k, _, m, s in rows if k == o and m == "fine_tuned")
        assert per[o]["baseline_score"] == b and per[o]["fine_tuned_score"] == f
        first_j = min(j for k, j, m, s in rows if k == o and m == "baseline" and s == b)
        assert per[o]["baseline_pick"] == first_j


def test_chat_long_conversation(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(1300)]
    turns += [(2, 0, "system", "sys"), (2, 1, "tool", "a"), (2, 2, "tool", "b"), (2, 3, "user", "u")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat_transcripts(df.repartition(9)).collect()}
    head = "<|im_start|>system\nYou are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>\n"
    body = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, _, r, x in turns[:1300])
    assert out[1]["transcript"] == head + body and out[1]["num_messages"] == 1300
    assert out[2]["transcript"] == ("<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\n<tool_response>\na\n"
                                    "</tool_response>\n<tool_response>\nb\n</tool_response><|im_end|>\n"
                                    "<|im_start|>user\nu<|im_end|>\n")


@pytest.mark.parametrize("parts", [1, 13])
def test_cache_ttl_hot_key(spark, parts):
    import datetime as dt
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "HOT" if i % 3 == 0 else f"k{i % 17}", base + dt.timedelta(seconds=rnd.randint(0, 10 * 86400)))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(parts)
    got = {r["id"]: r["cache_hit"] for r in cache_ttl(df, ["key"], "ts", "id").collect()}
    by_key = {}
    for i, k, t in rows:
        by_key.setdefault(k, []).append((t, i))
    for k, items in by_key.items():
        stamp = None
        for t, i in sorted(items):
            hit = stamp is not None and (t - stamp).total_seconds() < 14400
            if not hit:
                stamp = t
            assert got[i] == hit


def test_chat_runs_over_chunks_and_marks_in_texts(spark):
    """Tool runs across chunk borders stay one block; private-use characters in a text are text."""
    rows = [(1, t, "tool" if 505 <= t <= 520 or t >= 1020 else "user", f"m{t}") for t in range(1030)]
    rows += [(2, 0, "user", "\ue000 x \ue001\ue000"), (2, 1, None, "no role"), (2, 2, "tool", None), (2, 3, "odd", "x"), (2, 4, "tool", "b")]
    out = {r["conv_id"]: r["transcript"] for r in chat_transcripts(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()}
    head = "<|im_start|>system\nYou are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>\n"
    want = head
    for t in range(1030):
        if rows[t][2] == "tool":
            want += "<|im_start|>user" if t in (505, 1020) else ""
            want += f"\n<tool_response>\nm{t}\n</tool_response>"
            want += "<|im_end|>\n" if t in (520, 1029) else ""
        else:
            want += f"<|im_start|>user\nm{t}<|im_end|>\n"
    assert out[1] == want
    reply = "<|im_start|>user\n<tool_response>\n{}\n</tool_response><|im_end|>\n"
    assert out[2] == head + "<|im_start|>user\n\ue000 x \ue001\ue000<|im_end|>\n" + reply.format("") + reply.format("b")


def test_chat_tool_calls(spark):
    rows = [(7, 0, "user", "hi", None),
            (7, 1, "assistant", "", [("lookup", '{"q": 1}')]),
            (7, 2, "tool", "r1", None),
            (7, 3, "assistant", "done", [])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, "
                                     "calls array<struct<name: string, arguments: string>>")
    t = chat_transcripts(df, tool_calls_col="calls", add_generation_prompt=True).first()["transcript"]
    assert t == ("<|im_start|>system\nYou are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>\n"
                 "<|im_start|>user\nhi<|im_end|>\n"
                 "<|im_start|>assistant\n<tool_call>\n{\"name\": \"lookup\", \"arguments\": {\"q\": 1}}\n</tool_call>"
                 "<|im_end|>\n"
                 "<|im_start|>user\n<tool_response>\nr1\n</tool_response><|im_end|>\n"
                 "<|im_start|>assistant\ndone<|im_end|>\n"
                 "<|im_start|>assistant\n")


def test_exact_percentile_hot_group(spark):
    import numpy as np
    from evalforge.operators.ordering import exact_percentile
    rows = [(r[1], r[3] * 100) for r in _skewed_rows(4000, seed=11)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["p"] for r in exact_percentile(df, ["k"], "v", 0.99, name="p", accuracy=40).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    for k, vs in by.items():
        assert got[k] == pytest.approx(float(np.percentile(vs, 99)), rel=1e-12)
