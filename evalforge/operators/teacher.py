"""Teacher references (J1-J3, U2), normalised rewards and the tiered gate.

The teacher is scored once per distinct (prompt, language) key: ``distinct``
is a partial aggregate (a key repeated a third of the corpus costs one row
per map task), the scorer runs on the distinct keys only, and the result is
joined back on the two-column key.  The join side is the distinct-key table,
which grows with the corpus, so no broadcast is forced; AQE broadcasts it at
run time when it is small and splits a skewed key's partition otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import normalized_reward

KEY = ("prompt", "language")


def distinct_keys(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """U2."""
    return df.select(*keys).distinct()


def teacher_references(keys: DataFrame, teacher: Callable[[Column, Column], tuple[Column, Column]],
                       prompt: str = "prompt", language: str = "language") -> DataFrame:
    """Score each key once: ``teacher(prompt, language) -> (code, score)``
    columns (a built-in expression, or a pandas UDF plug-in)."""
    code, score = teacher(F.col(prompt), F.col(language))
    return keys.select(prompt, language, code.alias("teacher_code"), score.cast("double").alias("teacher_score"))


def attach_teacher(df: DataFrame, refs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Left join of the teacher reference on the key."""
    return df.join(refs, list(keys), "left")


def _membership(df: DataFrame, cache: DataFrame, keys: Sequence[str], how: str, digest: bool) -> DataFrame:
    if not digest:
        return df.join(cache.select(*keys), list(keys), how)
    k = cache.select(key_digest(keys).alias("_k")).where(F.col("_k").isNotNull())
    return df.withColumn("_k", key_digest(keys)).join(k, "_k", how).drop("_k")


def cache_misses(df: DataFrame, cache: DataFrame, keys: Sequence[str] = KEY, digest: bool = True) -> DataFrame:
    """Rows whose key is not in the cache (left anti join; on the key
    digest by default, so texts stay out of the exchange)."""
    return _membership(df, cache, keys, "left_anti", digest)


def cache_hits(df: DataFrame, cache: DataFrame, keys: Sequence[str] = KEY, digest: bool = True) -> DataFrame:
    """Rows whose key is in the cache (left semi join, on the key digest)."""
    return _membership(df, cache, keys, "left_semi", digest)


def key_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of the key columns (NULL if any is NULL, so NULL keys never
    match, as in an equi-join).  Joining on the digest lets Catalyst drop
    long prompt texts before the exchange when nothing downstream uses them."""
    parts = []
    for c in cols:
        parts += [F.col(c).cast("string"), F.lit("\u0000")]
    anynull = F.lit(False)
    for c in cols:
        anynull = anynull | F.col(c).isNull()
    return F.when(~anynull, F.sha2(F.concat(*parts), 256))


def score_with_teacher(df: DataFrame, refs: DataFrame, student_score: str = "student_score",
                       keys: Sequence[str] = KEY, digest: bool = True) -> DataFrame:
    """F17 on top of J1: reward = student / (teacher + eps).

    ``digest=True`` joins on a SHA-256 of the key instead of the key texts:
    the shuffle then carries a 64-character digest per row instead of the
    prompt (collisions are negligible: 2^-128 at 2^64 distinct keys)."""
    if digest:
        r = refs.withColumn("_k", key_digest(keys)).drop(*keys)
        j = df.withColumn("_k", key_digest(keys)).join(r, "_k", "left").drop("_k")
    else:
        j = attach_teacher(df, refs, keys)
    return j.withColumn("reward", normalized_reward(F.col(student_score), F.col("teacher_score")))


def tiered_scores(df: DataFrame, heuristic: str, refs_for: Callable[[DataFrame], DataFrame],
                  keys: Sequence[str] = KEY, threshold: float = 0.3) -> DataFrame:
    """Rows under the gate keep the heuristic, also an unknown one; only
    rows at or above it reach the teacher, once a key.  One pass: the others
    join with a NULL digest, which meets nothing."""
    gate = F.coalesce(F.col(heuristic) >= F.lit(float(threshold)), F.lit(False))
    refs = refs_for(distinct_keys(df.where(gate), keys))
    r = refs.select(key_digest(keys).alias("_k"), F.col("teacher_score").alias("_teacher"))
    j = df.withColumn("_k", F.when(gate, key_digest(keys))).join(r, "_k", "left")
    return j.withColumn("final_score", F.when(gate, F.col("_teacher")).otherwise(F.col(heuristic))).drop("_k", "_teacher")
