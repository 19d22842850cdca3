"""Greedy expiry anchors without gathering a key's rows in one task.

The score-cache rule (W16): the first event of a key is a miss and stamps
the cache; an event is a hit while ``t - stamp < TTL``; the first event at
or past ``stamp + TTL`` is the next miss.  The misses ("anchors") form the
chain ``a1 -> next(a1) -> ...`` where ``next(e)`` is the first event with
``t >= t_e + TTL``.

Cut time into buckets of width TTL.  Anchors are at least TTL apart, so a
bucket holds at most one, and for an anchor ``e`` in bucket ``b``:

* every other event of bucket ``b`` is a hit (closer than TTL);
* ``next(e)`` is the first event of bucket ``b+1`` at or after
  ``t_e + TTL`` if there is one, else the first event of the first
  non-empty bucket from ``b+2`` on.

So ``next`` is computed with windows over one key's *bucket* (an as-of
lookup inside ``(key, bucket)``) and over one key's list of non-empty
buckets, both bounded by time, not by the key's total rows.  The chain is
then marked by pointer doubling: after round r the marked set holds the
first 2^r anchors of every key, and ``next`` is squared each round; every
round is one equi-join of both, marks and pointers, with the pointers, written
once to keep the plan flat; it ends when a round marks nothing new.  Work is
O(n log A) for A anchors per key, with no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .keys import null_safe_join


def expiry_anchors(events: DataFrame, keys: Sequence[str], t: str, tie: str, ttl: int) -> DataFrame:
    """Return ``(keys..., tie)`` of the anchor (miss) events.

    ``t`` is an integer time column, ``tie`` a per-key unique integer id;
    events are ordered by ``(t, tie)``."""
    keys = list(keys)
    e = events.select(*keys, F.col(tie).alias("_id"), F.col(t).alias("_t")) \
        .withColumn("_b", F.floor(F.col("_t") / F.lit(ttl)))

    # next(e) inside bucket b+1: probes at t+TTL, matched to the first event
    # at or after them (descending running "last event seen").
    probes = e.select(*keys, (F.col("_b") + 1).alias("_b"), (F.col("_t") + F.lit(ttl)).alias("_t"),
                      F.lit(None).cast("long").alias("_id"), F.col("_id").alias("_src"),
                      F.lit(0).alias("_kind"))
    evs = e.select(*keys, "_b", "_t", F.col("_id").cast("long").alias("_id"),
                   F.lit(None).cast("long").alias("_src"), F.lit(1).alias("_kind"))
    w = (Window.partitionBy(*keys, "_b")
         .orderBy(F.col("_t").desc(), F.col("_kind").desc(), F.col("_id").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = (probes.unionByName(evs)
           .withColumn("_next", F.last("_id", ignorenulls=True).over(w))
           .where(F.col("_kind") == 0)
           .select(*keys, F.col("_src").alias("_id"), "_next"))

    # first event of each non-empty bucket, and for each bucket b the first
    # event of the first non-empty bucket >= b + 2 (windows over bucket rows)
    firsts = e.groupBy(*keys, "_b").agg(
        F.min_by("_id", F.struct("_t", "_id")).alias("_first"))
    wb = (Window.partitionBy(*keys).orderBy(F.col("_b").desc(), F.col("_q").desc())
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bucket_rows = firsts.select(*keys, "_b", "_first", F.lit(1).alias("_q"))
    queries = firsts.select(*keys, (F.col("_b") + 2).alias("_b"), F.lit(None).cast("long").alias("_first"),
                            F.lit(0).alias("_q"), F.col("_b").alias("_from"))
    later = (queries.unionByName(bucket_rows, allowMissingColumns=True)
             .withColumn("_later", F.last("_first", ignorenulls=True).over(wb))
             .where(F.col("_q") == 0)
             .select(*keys, F.col("_from").alias("_b"), "_later"))

    # successor function g and the chain starts (first event of each key)
    g = (e.select(*keys, "_id", "_b")
         .transform(lambda d: null_safe_join(d, nxt, [*keys, "_id"], "left"))
         .transform(lambda d: null_safe_join(d, later, [*keys, "_b"], "left"))
         .select(*keys, "_id", F.coalesce("_next", "_later").alias("_nid")))
    starts = e.groupBy(*keys).agg(F.min_by("_id", F.struct("_t", "_id")).alias("_id"))
    # only a chain start or a successor can ever be an anchor: restrict the
    # jump table to those nodes
    nodes = starts.unionByName(g.select(*keys, F.col("_nid").alias("_id")).where(F.col("_id").isNotNull()))
    kinds = {"marks": 0, "jumps": 1}
    jump = staged(null_safe_join(g.where(F.col("_nid").isNotNull()), nodes.distinct(), [*keys, "_id"], "left_semi"), "jumps")
    marked = [staged(starts, "marks")]
    while True:
        # marks one jump further: positions [2^r, 2^(r+1)) of every chain, all new, as times strictly increase along a
        # chain; and jumps twice as far
        marks = reduce(DataFrame.unionByName, marked)
        far = (marks.select(*keys, F.lit(kinds["marks"]).alias("_kind"), F.lit(None).cast("long").alias("_from"), "_id")
               .unionByName(jump.select(*keys, F.lit(kinds["jumps"]).alias("_kind"), F.col("_id").alias("_from"), F.col("_nid").alias("_id"))))
        went = staged(null_safe_join(far, jump, [*keys, "_id"]).select(*keys, "_kind", "_from", "_nid"), "jumped", "_kind")
        new = went.where(F.col("_kind") == kinds["marks"]).select(*keys, F.col("_nid").alias("_id"))
        if new.isEmpty():
            return marks.select(*keys, F.col("_id").alias(tie))
        marked.append(new)
        jump = went.where(F.col("_kind") == kinds["jumps"]).select(*keys, F.col("_from").alias("_id"), "_nid")
