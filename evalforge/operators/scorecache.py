"""The teacher's score cache as a table that outlives a run.

A version of the cache is a bucketed table, sorted by the key's digest inside each bucket: (key, score, scored_at).  A
run joins its distinct keys with it; only the run's side is shuffled, into the cache's buckets, while the
cache, which grows with all runs, is read in place.  Keys without a score, or with one that is ``ttl`` old, are scored
once each; the next version is the cache merged with the new scores by a full outer join on the same buckets, so
again the cache is not shuffled.  Versions are never changed: a run that dies leaves the one it read as it was, and
can be run again.

Choose as many buckets as the shuffles of a run have partitions; a bucket should hold what one task can merge.  Rows
whose key has a NULL part are no keys, as in an equi-join; they are neither cached nor answered.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, staged
from .sequence import CACHE_TTL_SECONDS
from .teacher import KEY, key_digest

SCHEMA = "key STRING, score DOUBLE, scored_at BIGINT"


@dataclass(frozen=True)
class ScoreCache:
    name: str
    version: int
    buckets: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(f"{self.name}_v{self.version}")


def _store(rows: DataFrame, cache: ScoreCache) -> ScoreCache:
    (rows.write.bucketBy(cache.buckets, "key").sortBy("key").option("compression", "zstd")
     .option("path", scratch_path(rows.sparkSession, f"{cache.name}-v{cache.version}"))
     .saveAsTable(f"{cache.name}_v{cache.version}"))
    return cache


def new_cache(spark: SparkSession, buckets: int | None = None, name: str = "score_cache") -> ScoreCache:
    """An empty cache; ``buckets``: as many as shuffle partitions unless given."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _store(spark.createDataFrame([], SCHEMA), ScoreCache(f"{name}_{uuid.uuid4().hex[:12]}", 0, buckets))


def look_up(asked: DataFrame, cache: ScoreCache, now: int, ttl: int = CACHE_TTL_SECONDS, keys: Sequence[str] = KEY) -> DataFrame:
    """Distinct keys of ``asked`` with ``key``, ``state`` (hit, expired or missing) and, for hits, ``score``.
    A score is a hit while it is younger than ``ttl``."""
    distinct = asked.select(*keys, key_digest(keys).alias("key")).where(F.col("key").isNotNull()).dropDuplicates(["key"])
    found = distinct.join(cache.read(asked.sparkSession), "key", "left")
    state = (F.when(F.col("scored_at").isNull(), "missing").when(F.lit(int(now)) - F.col("scored_at") < int(ttl), "hit")
             .otherwise("expired"))
    return (found.withColumn("state", state)
            .select("key", *keys, "state", F.when(F.col("state") == "hit", F.col("score")).alias("score")))


def merged(cache: DataFrame, scored: DataFrame) -> DataFrame:
    """The cache with new scores in place of old ones of the same key."""
    new = scored.select("key", F.col("score").alias("_score"), F.col("scored_at").alias("_at"))
    return cache.join(new, "key", "full_outer").select(
        "key", F.when(F.col("_at").isNotNull(), F.col("_score")).otherwise(F.col("score")).alias("score"),
        F.coalesce("_at", "scored_at").alias("scored_at"))


def refresh(asked: DataFrame, cache: ScoreCache, teacher: Callable[[Column, Column], Column], now: int,
            ttl: int = CACHE_TTL_SECONDS, keys: Sequence[str] = KEY) -> tuple[DataFrame, ScoreCache]:
    """Scores of all distinct keys of ``asked`` (key, the key columns, state, score) and the next version of the cache.

    ``teacher`` maps the key columns to a score; it sees the missing and expired keys only."""
    spark = asked.sparkSession
    found = staged(look_up(asked, cache, now, ttl, keys), "cache-lookup")
    due = found.where("state <> 'hit'")
    scored = staged(due.withColumn("score", teacher(*[F.col(k) for k in keys]).cast("double")), "cache-scored")
    fresh = scored.select("key", "score", F.lit(int(now)).cast("bigint").alias("scored_at"))
    after = _store(merged(cache.read(spark), fresh), replace(cache, version=cache.version + 1))
    return found.where("state = 'hit'").unionByName(scored), after
