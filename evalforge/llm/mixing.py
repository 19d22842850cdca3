"""Operator 10: mixing sources to target weights by Pfair scheduling.

Each source's documents, in doc_id order, are cut into blocks of ``BLOCK``
documents.  Block j (from 0) of a source of weight w is released at slot
floor(j / w) and due at slot ceil((j + 1) / w); earliest-deadline-first among
released blocks gives every slot one block, and each source stays less than one
block from its share w * t at every slot t.

Weights are the exact rationals of their doubles over their exact sum, so no
rounding adds up, however long the input.  Nothing walks all slots: the blocks
served before a segment follow from its first slot alone (``quota``), by a rule
that leaves every block before and behind the seam room in its window, and Spark
tasks serve the segments side by side, earliest deadline first, each from
the quota of its first slot to that of the next segment's.  When a source runs out,
the others go on with their weights renormalised, in a new phase whose deviation
starts at zero: no document is dropped or repeated.  The driver lists some SEGMENTS
segments, and in each phase walks only from the last slot by which no source can
have run out to the one where the first has, about one block of that source.

Ranks within a source need no window over a source: documents are cut into
ranges of doc_id (about equal rows), ranked inside (source, range), and moved
on by the counts of the ranges before.

Defined cases: a null source is a source of its own; null doc_ids come first;
equal doc_ids are ordered by a hash of the text; without targets the weights are the square roots of
the document counts (a hot source is damped); sources missing from the given
targets share the mean given weight; targets that are not positive are refused;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import range_bucket, range_starts, whole_row
from .registry import documents, query

BLOCK, PERIOD, BUCKETS = 16, 1000, 8
SEGMENTS = 1000  # PERIOD: least slots of a segment


def whole_weights(weights: list[float]) -> list[int]:
    """Integers in exactly the proportion of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


def quota(weights: list[int], at: int) -> list[int]:
    """Blocks of each source served before slot ``at``: its share rounded down or up.

    Blocks whose window lies across ``at`` go before it by their deadline, as long as enough slots are left for all that
    is released so late; as the shares themselves keep to both sides, a choice that does exists, and taking
    the earliest deadline that still fits finds it (the sets that fit form a matroid)."""
    total = sum(weights)
    low = [w * at // total for w in weights]
    wanted = at - sum(low)
    if not wanted:
        return low
    across = [i for i, w in enumerate(weights) if w * at % total]
    release = {i: low[i] * total // weights[i] for i in across}
    starts = sorted(set(release.values()))
    # room[k]: blocks across that may go before ``at`` of those released from starts[k] on; from each slot a back to the
    # start before, the slots left from a on less the whole blocks released there
    room, whole = np.zeros(len(starts), np.int64), 0
    behind = [(-((n - 1) * total // w), n - 1, w) for n, w in zip(low, weights) if n]
    heapq.heapify(behind)

    def release_from(a: int) -> None:
        nonlocal whole
        while behind and -behind[0][0] >= a:
            _, j, w = heapq.heappop(behind)
            whole += 1
            if j:
                heapq.heappush(behind, (-((j - 1) * total // w), j - 1, w))
    for k in reversed(range(len(starts))):
        release_from(starts[k])
        room[k], stop = at - starts[k] - whole, starts[k - 1] if k else starts[k]
        while behind and -behind[0][0] > stop:
            a = -behind[0][0]
            release_from(a)
            room[k] = min(room[k], at - a - whole)
    for i in sorted(across, key=lambda i: (-(-(low[i] + 1) * total // weights[i]), i)):
        late = bisect_right(starts, release[i])
        if (room[:late] > 0).all():
            room[:late] -= 1
            low[i] += 1
            wanted -= 1
            if not wanted:
                return low
    raise AssertionError("no choice of blocks keeps to all windows")


def pfair(weights: list[int], done: list[int], slot: int, end: int | None = None, goal: list[int] | None = None) -> Iterator[int]:
    """Source of each slot from ``slot`` on, ``done`` blocks of each source being served before it: earliest deadline
    first among the released.  A source's blocks come in order, so only its next one is held.  ``end``, ``goal``: the slot
    before which exactly ``goal`` blocks of each source are to be served."""
    total = sum(weights)

    def next_block(i: int, j: int) -> tuple[int, int, int, int]:
        due = -(-(j + 1) * total // weights[i])
        return j * total // weights[i], due if end is None else min(due, end), i, j
    waiting, ready = [next_block(i, j) for i, j in enumerate(done) if goal is None or j < goal[i]], []
    heapq.heapify(waiting)
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        due, i, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        yield i
        if goal is None or j + 1 < goal[i]:
            heapq.heappush(waiting, next_block(i, j + 1))
        slot += 1


def segments(blocks: list[int], weights: list[int], size: int) -> Iterator[tuple]:
    """(first slot, slots, phase's first slot, sources, their blocks before the phase, whether the phase ends here)."""
    left, start = list(blocks), 0
    while any(left):
        act = [i for i, n in enumerate(left) if n]
        before, own = [blocks[i] - left[i] for i in act], [weights[i] for i in act]
        total = sum(own)
        last = left[act[0]] if len(act) == 1 else min((left[i] - 1) * total // weights[i] for i in act)
        for at in range(0, last, size):
            yield start + at, min(size, last - at), start, act, before, False
        done, n = quota(own, last), 0
        if len(act) > 1:
            served = pfair(own, done, last)
            while all(done[k] < left[i] for k, i in enumerate(act)):
                done[next(served)] += 1
                n += 1
            yield start + last, n, start, act, before, True
        for k, i in enumerate(act):
            left[i] -= done[k]
        start += last + n


def serve(weights: list[int], first: int, n: int, ends: bool) -> tuple[list[int], list[int]]:
    """Blocks done before a segment at slot ``first`` of its phase, and the sources of its ``n`` slots."""
    done = quota(weights, first)
    if ends:
        return done, list(islice(pfair(weights, done, first), n))
    return done, list(pfair(weights, done, first, first + n, quota(weights, first + n)))


SEGMENT = "first long, n long, start long, act array<int>, before array<long>, ends boolean"


def block_slots(spark: SparkSession, names: list[str], blocks: list[int], weights: list[float], period: int) -> DataFrame:
    """(name, block, slot) of all blocks, by segments."""
    whole = whole_weights(weights)
    rows = list(segments(blocks, whole, max(period, -(-sum(blocks) // SEGMENTS))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                done, order = serve([whole[i] for i in r.act], r.first - r.start, r.n, r.ends)
                at = [b + d for b, d in zip(r.before.tolist(), done)]
                block = []
                for k in order:
                    block.append(at[k])
                    at[k] += 1
                yield pd.DataFrame({"name": [names[r.act[k]] for k in order], "block": block,
                                    "slot": np.arange(r.first, r.first + r.n)})
    plan = spark.createDataFrame(rows, SEGMENT).repartition(max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return plan.mapInPandas(run, "name string, block long, slot long")


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, block: int = BLOCK,
        period: int = PERIOD) -> DataFrame:
    """(row, block, slot, place, weight): ``row`` holds the columns of ``docs``, ``place`` is the place in the block;
    sort by slot and place for the mixed order."""
    if targets is not None and not all(math.isfinite(w) and w > 0 for w in targets.values()):
        raise ValueError("target weights must be positive")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(docs, "doc_id", BUCKETS * n)
    held = docs.select(whole_row(docs), F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")).alias("name"),
                       F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), F.xxhash64("text", F.lit(1)).alias("tie2"),
                       range_bucket("doc_id", starts).alias("range"))
    counts = held.groupBy("name", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("name", "range", "n", (F.sum("n").over(
        Window.partitionBy("name").orderBy("range")) - F.col("n")).alias("before"))
    sizes = sorted((r["name"], r["n"]) for r in counts.groupBy("name").agg(F.sum("n").alias("n")).collect())
    if targets is None:
        weights = [math.sqrt(n) for _, n in sizes]
    else:
        mean = math.fsum(targets.values()) / max(1, len(targets)) or 1.0
        weights = [targets.get(s[2:], mean) if s != "null" else mean for s, _ in sizes]
    total = math.fsum(weights)
    slots = block_slots(spark, [s for s, _ in sizes], [-(-n // block) for _, n in sizes], weights, period)
    plan = spark.createDataFrame([(s, w / total) for (s, _), w in zip(sizes, weights)], "name string, weight double")
    # each (source, range) with the slots of its blocks: documents stay where the window below has put them
    low, high = (F.floor(x / block).cast("long") for x in (F.col("before"), F.col("before") + F.col("n") - 1))
    held_slots = (before
                  .select("name", "range", "before", F.explode(F.sequence(low, high)).alias("block"))
                  .join(slots, ["name", "block"]).groupBy("name", "range")
                  .agg(F.first("before").alias("before"), F.sort_array(F.collect_list(F.struct("block", "slot")))["slot"].alias("slots"))
                  .join(plan, "name"))
    inside = Window.partitionBy("name", "range").orderBy("id", "tie", "tie2")
    at = (held.withColumn("inside", F.row_number().over(inside) - 1).join(held_slots, ["name", "range"])
          .withColumn("rank", F.col("inside") + F.col("before"))
          .withColumn("block", F.floor(F.col("rank") / block).cast("long")))
    return at.select("row", "block", F.get("slots", (F.col("block") - F.floor(F.col("before") / block)).cast("int")).alias("slot"),
                     (F.col("rank") % block).cast("long").alias("place"), "weight")


def mixed_order(docs: DataFrame, targets: Mapping[str, float] | None = None) -> DataFrame:
    """All documents in mixed order, as a range-partitioned sort: files and rows written from it follow the schedule."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (mix(docs, targets).repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place")
            .select("row.*"))


@query("op10_mix_sources")
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("row.doc_id", "row.source", "weight", "block", "slot", "place")
