import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import xxhash

from evalforge.llm import exactdup, neardup
from evalforge.llm.components import components
from evalforge.llm.registry import ORACLE

from .conftest import SCHEMA, nasty_rows

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def lower(t):
    return (t or "").translate(LOWER)


def test_perfect_hash_is_minimal_and_checked():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2 ** 63, (5000, 4)).astype(np.uint64)
    mph = exactdup.PerfectHash.build(words)
    assert sorted(mph.slots(words)) == list(range(5000))
    other = rng.integers(0, 2 ** 63, (2000, 4)).astype(np.uint64)
    slots = mph.slots(other)
    held = np.empty_like(words)
    held[mph.slots(words)] = words
    hit = slots >= 0
    assert hit.any() and not (held[slots[hit]] == other[hit]).all(axis=1).any()
    assert len(exactdup.PerfectHash.build(words[:0]).slots(other)) == 2000


def test_exact_nasty(spark, nasty):
    got = exactdup.exact_duplicates(nasty).toPandas()
    rows = nasty_rows()
    assert len(got) == len(rows)
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(hashlib.sha256(lower(t).encode()).digest(), []).append(d)
    for r in got.itertuples():
        ids = groups[bytes(r.digest)]
        best = max((i for i in ids if i is not None), default=None)
        assert r.group_size == len(ids) and (pd.isna(r.keep_id) if best is None else r.keep_id == best)
    assert (got[got.kept].groupby(got.digest.map(bytes)).size() == 1).all() and got.kept.sum() == len(groups)


def test_exact_any_history_and_sql(spark, prose):
    rng = random.Random(2)
    rows = prose + [(1000 + i, rng.choice(prose)[1].upper(), "xa", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    documents = docs.toPandas()  # noqa: F841  read by name
    want = duckdb.sql(ORACLE["op4_exact_dedup"]).df().sort_values("doc_id")
    split = [exactdup.exact_duplicates(docs, h).select("doc_id", "keep_id", "group_size", "kept").orderBy("doc_id").collect()
             for h in (None, docs["doc_id"] < 700, docs["doc_id"] < 0, docs["doc_id"] >= 0)]
    assert all(s == split[0] for s in split)
    keep = {}
    for d, t, *_ in rows:
        keep[lower(t)] = max(d, keep.get(lower(t), -1))
    text = {d: lower(t) for d, t, *_ in rows}
    assert [tuple(r) for r in split[0]] == list(want[["doc_id", "keep_id", "group_size", "kept"]].itertuples(index=False, name=None))
    assert all(r.keep_id == keep[text[r.doc_id]] and r.kept == (r.doc_id == r.keep_id) for r in split[0])


def test_drop_exact_keeps_columns(nasty, empty):
    out = exactdup.drop_exact(nasty)
    assert out.columns == nasty.columns
    rows = out.collect()
    assert len({lower(r["text"]) for r in rows}) == len(rows) == len({lower(t) for _, t, *_ in nasty_rows()})
    assert all(r["fp"] == "own fp" for r in rows)
    assert exactdup.drop_exact(empty).count() == 0 and exactdup.exact_duplicates(empty).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, bits=3):
    u = np.array(sorted(set(fps)), np.uint64)
    own = list(range(len(u)))

    def find(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= bits) + i + 1:
            own[find(int(j))] = find(i)
    return {int(x): find(i) for i, x in enumerate(u)}


def check_near(docs, rows):
    got = neardup.near_duplicates(docs).toPandas()
    assert len(got) == len(rows)
    want = sorted((-1 if d is None else d, fingerprint(t)) for d, t, *_ in rows)
    assert sorted((-1 if pd.isna(r.doc_id) else r.doc_id, r.fp % 2 ** 64) for r in got.itertuples()) == want
    cls, low = classes([f for _, f in want]), {}
    for d, t, *_ in rows:
        c = cls[fingerprint(t)]
        if d is not None:
            low[c] = min(d, low.get(c, d))
    for r in got.itertuples():
        best = low.get(cls[r.fp % 2 ** 64])
        assert pd.isna(r.component_id) if best is None else r.component_id == best


def test_near_nasty(spark, nasty, empty):
    check_near(nasty, nasty_rows())
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near(empty).count() == 0
    out = neardup.drop_near(nasty)
    cls = classes([fingerprint(t) for _, t, *_ in nasty_rows()])
    assert out.columns == nasty.columns and out.count() == len(set(cls.values()))


def test_near_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(6):
        base = [word() for _ in range(400)]
        for _ in range(15):
            own = list(base)
            own[rng.randrange(400)] = word()
            rows.append((len(rows), " ".join(own), "x", "s", 0))
    rows += [(1000 + i, " ".join(word() for _ in range(60)), "x", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check_near(docs, rows)
    assert len(set(classes([fingerprint(r[1]) for r in rows]).values())) < 120  # copies do link


def test_links_beyond_one_group(spark):
    """More fingerprints than GROUP share signatures: split by further variants, components as by brute force."""
    rng = np.random.default_rng(4)
    dense = (0xABCD << 44) + rng.choice(1 << 20, 2500, replace=False)
    tight = (0x1234 << 44) + rng.choice(1 << 12, 1500, replace=False)
    fps = [int(x) for x in np.concatenate([dense, tight])]
    df = spark.createDataFrame([(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps], "fp long")
    got = {r.node: r.label for r in components(neardup.links(df)).collect()}
    want = classes(fps)
    parts = {}
    for f in fps:
        parts.setdefault(want[f], set()).add(got.get(f, f))
    assert all(len(p) == 1 for p in parts.values()) and len({next(iter(p)) for p in parts.values()}) == len(parts)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)] + [(5, 5), (7, 6)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_equal_rows(spark):
    """A third of the rows equal in every column, with and without an id."""
    text = "one text of a few words that comes again"
    docs = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id",
                                        f"CASE WHEN id % 3 = 2 THEN concat('other ', id) ELSE '{text}' END AS text")
    got = exactdup.exact_duplicates(docs)
    assert got.count() == 9000
    same = got.where("group_size = 6000").groupBy("kept").count().collect()
    assert sorted((r["kept"], r["count"]) for r in same) == [(False, 5999), (True, 1)]
    near = neardup.near_duplicates(docs).where("doc_id = 7 OR doc_id IS NULL").toPandas()
    assert len(near) == 6000 and (near.component_id == 7).all() and sorted(near[near.doc_id == 7]["copy"]) == list(range(1, 3001))
