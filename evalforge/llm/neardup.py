"""Operator 2: SimHash near-duplicates by deletion-variant signatures.

Fingerprint: A-Z lower-cased, words between white space, 3-word shingles with
repeats, XXH64 (seed 42) of each; a bit is 1 if set in over half the hashes.
Counting is an explode and 32 sums, each sum holding two 32-bit counters (a
text has fewer than 2^31 shingles, so no counter can overflow).

Linking (at most 3 differing bits): cut the 64 bits into two halves; then one
half differs by at most one bit.  Each half is indexed 32 times with one bit
deleted, so fingerprints with such a half share a signature.  Index rows are
partitioned and sorted by signature; equal signatures are verified on all 64
bits and leave a spanning forest of their links, never all pairs.  A signature
with more than ``GROUP`` members is not gathered: its members are indexed again
by deletion variants of the bits the signature leaves open (33, then 18, then
10, which at most 1024 distinct fingerprints can share), so the search stays
exact with bounded memory.  Components of the links give the classes.

Defined cases: null or wordless text has fingerprint 0, linked as any other;
fewer than three words make one shingle; repeated rows come back as often as
they came; null doc_ids share a class but never name it unless alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, keep_by_key, repeated, row_key, written
from .components import components
from .registry import documents, query

GROUP = 1024
LANE = 0x0000000100000001


def _hashes(words: str, size: int) -> Column:
    w = F.col(words)
    parts = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)])
    n = F.size(w)
    return (F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(parts(i))))
            .when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, row_key, copies, fp): one row per distinct (doc_id, text)."""
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x20\x09-\x0D]+"),
                     lambda w: w != "")
    hashed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                          words.alias("w"))
              .select("doc_id", "row_key", _hashes("w", size).alias("hs"))
              .select("doc_id", "row_key", F.greatest(F.size("hs"), F.lit(1)).alias("m"),
                      F.explode_outer("hs").alias("h")))
    sums = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(LANE))).alias(f"s{k}") for k in range(32)]
    # equal rows only multiply all counts, which leaves every majority as it is
    got = hashed.groupBy("doc_id", "row_key", "m").agg(F.count(F.lit(1)).alias("n"), *sums)
    fp = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"s{k}"), 32)
        for bit, c in ((k, low), (k + 32, high)):
            one = (1 << bit) - (1 << 64 if bit == 63 else 0)
            fp = fp.bitwiseOR(F.when(2 * c > F.col("n"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return got.select("doc_id", "row_key", (F.col("n") / F.col("m")).cast("long").alias("copies"),
                      F.coalesce(fp, F.lit(0).cast("long")).alias("fp"))


def _variants(free: list[int]) -> list[tuple[int, list[int]]]:
    """Cut the free bits in two; each half less one bit is a signature: (mask of the bits it fixes, bits it leaves open)."""
    cut = len(free) // 2
    out = []
    for own, other in ((free[:cut], free[cut:]), (free[cut:], free[:cut])):
        for p in own:
            fixed = [b for b in own if b != p]
            out.append((sum(1 << b for b in fixed), sorted([p, *other])))
    return out


def _expand(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, fp): every signature of the next level, as (mask of fixed bits, fixed bits, fp)."""
    for batch in batches:
        masks = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for mask in np.unique(masks):
            mine = fps[masks == mask]
            free = [b for b in range(64) if not int(mask) >> b & 1]
            for more, _ in _variants(free):
                fixed = np.uint64(int(mask) | more)
                for at in range(0, len(mine), cap):
                    part = mine[at:at + cap]
                    yield pa.record_batch([pa.array(np.full(len(part), fixed).view(np.int64)),
                                           pa.array((part & fixed).view(np.int64)), pa.array(part.view(np.int64))],
                                          names=["mask", "sig", "fp"])


def _forest(fps: np.ndarray, bits: int) -> np.ndarray:
    """Edges of a spanning forest of the links among distinct fingerprints (at most GROUP of them)."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    todo, out = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not todo[root]:
            continue
        todo[root], edge = False, [root]
        while edge:
            at = edge.pop()
            new = np.flatnonzero(near[at] & todo)
            todo[new] = False
            edge.extend(new)
            out.extend((at, x) for x in new)
    return np.array(out, np.int64).reshape(-1, 2)


def _verify(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, sig, fp).  Groups up to GROUP give forest edges; the members
    of larger ones pass through with their mask, for the next level."""
    def out(kind, a, b):
        return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.ascontiguousarray(a).view(np.int64)),
                                pa.array(np.ascontiguousarray(b).view(np.int64))], names=["kind", "a", "b"])

    def groups(mask, sig, fp, ends):
        a, b = ends[:-1], ends[1:]
        two = a[b - a == 2]
        if len(two):
            x, y = fp[two], fp[two + 1]
            ok = np.bitwise_count(x ^ y) <= bits
            if ok.any():
                yield out(0, x[ok], y[ok])
        for s, e in zip(a[b - a > 2], b[b - a > 2]):
            if e - s > GROUP:
                yield out(1, mask[s:e], fp[s:e])
            else:
                f = fp[s:e]
                edges = _forest(f, bits)
                if len(edges):
                    yield out(0, f[edges[:, 0]], f[edges[:, 1]])

    held, passing = None, None
    for batch in batches:
        mask, sig, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        if passing is not None:  # the rest of a large group that is already passed on
            n = int(np.argmin(np.append((mask == passing[0]) & (sig == passing[1]), False)))
            if n:
                yield out(1, mask[:n], fp[:n])
                mask, sig, fp = mask[n:], sig[n:], fp[n:]
            if not len(fp):
                continue
            passing = None
        if held is not None:
            mask, sig, fp = (np.concatenate(x) for x in zip(held, (mask, sig, fp)))
        if not len(fp):
            continue
        new = np.flatnonzero((sig[1:] != sig[:-1]) | (mask[1:] != mask[:-1])) + 1
        ends = np.concatenate([[0], new])
        yield from groups(mask, sig, fp, ends)
        s = int(ends[-1])
        held = tuple(x[s:].copy() for x in (mask, sig, fp))
        if len(held[2]) > GROUP:
            yield out(1, held[0], held[2])
            passing, held = (held[0][0], held[1][0]), None
    if held is not None and len(held[2]) > 1:
        yield from groups(*held, np.array([0, len(held[2])]))


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at ``bits`` or fewer differing bits:
    a set of edges with the same components as all links.  Two halves need ``bits`` of 3 or fewer."""
    if bits > 3:
        raise ValueError("two segments differ by one bit at most only up to 3 bits")
    todo = fps.select(F.lit(0).cast("long").alias("mask"), F.col("fp").cast("long").alias("fp"))
    edges = None
    while True:
        index = (todo.mapInArrow(lambda it: _expand(it, 20_000), "mask long, sig long, fp long")
                 .repartition("mask", "sig").sortWithinPartitions("mask", "sig", "fp"))
        got = written(index.mapInArrow(lambda it: _verify(it, bits), "kind int, a long, b long"), "links")
        own = got.where("kind = 0").select("a", "b")
        edges = own if edges is None else edges.union(own)
        todo = got.where("kind = 1").select(F.col("a").alias("mask"), F.col("b").alias("fp"))
        if todo.isEmpty():
            return edges
        todo = todo.distinct()


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """One row per document: doc_id, row_key, copy, fp, label (least fingerprint of the class), component_id
    (smallest doc_id reachable)."""
    rows = written(fingerprints(docs, size), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    own = written(own, "distinct-fingerprints")
    label = components(links(own, bits))
    named = own.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = named.join(least, "label").select("fp", "label", "component_id")
    return repeated(rows.join(classes, "fp"), "copies", "copy").select(
        "doc_id", "row_key", "copy", "fp", "label", "component_id")


def drop_near(docs: DataFrame, size: int = 3, bits: int = 3) -> DataFrame:
    """Documents with one of each near-duplicate class: the one with the smallest doc_id
    (of several rows with that doc_id the least row key, which no two different texts share)."""
    found = near_duplicates(docs.select("doc_id", "text"), size, bits)
    kept = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("label").agg(F.min("row_key").alias("row_key")))
    return keep_by_key(docs, kept)


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
