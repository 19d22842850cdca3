"""Operator 4: exact duplicates against a minimal perfect hash of historical digests.

Texts are equal when identical after lower-casing A-Z.  Only 32-byte SHA-256
digests move, never texts:

1. Historical rows are grouped by digest (partial aggregates, so a copied text
   sends one row per task) and sharded by digest prefix.  Digests are uniform,
   so every shard holds about ``SHARD`` of them however the copies are spread.
2. Each shard becomes a minimal perfect hash: levels of bit arrays, a key
   sitting at the first level where its position is its own; the rank of its
   bit is its slot.  Slots hold the full digest, the winner's doc_id (the
   locator) and the number of copies.
3. Incoming rows are grouped the same way and looked up shard by shard.  A
   lookup counts only if all 32 bytes of the slot agree; members are repeats
   of the historical text, nonmembers form groups of their own.

Defined cases: null text is the empty text; null doc_ids are never winners
unless a group has nothing else (keep_id is then null); of rows equal in both
doc_id and text one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, crc_mod, keep_by_key, repeated, row_key, written
from .registry import documents, query

SHARD = 100_000  # historical digests a shard, on average
GAMMA = 2.0      # bits a key at each level
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased, null as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @staticmethod
    def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
        h = words[:, level % 4] + np.uint64((level + 1) * _ODD[level % 4] % 2 ** 64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_ODD[(level + 1) % 4])
        return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        """``words``: (n, 4) uint64, rows distinct."""
        sizes, parts, left, level = [], [], words, 0
        while len(left):
            size = max(1, int(GAMMA * len(left)))
            at = cls._places(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds a bit for it (a sure nonmember)."""
        out = np.full(len(words), -1, np.int64)
        todo, base = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._places(words[todo], level, int(size))
            hit = self.bits[at]
            out[todo[hit]] = self.ranks[at[hit]]
            todo, base = todo[~hit], base + int(size)
        return out


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


INDEX_SCHEMA = "shard int, sizes binary, bits binary, digests binary, winners binary, known binary, copies binary"


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    digests = _words(rows["digest"])
    mph = PerfectHash.build(digests)
    order = np.argsort(mph.slots(digests))
    known = rows["top"].notna().to_numpy()
    return pd.DataFrame({
        "shard": [key[0]], "sizes": [mph.sizes.tobytes()], "bits": [np.packbits(mph.bits).tobytes()],
        "digests": [digests[order].tobytes()], "winners": [rows["top"].fillna(0).to_numpy(np.int64)[order].tobytes()],
        "known": [known[order].tobytes()], "copies": [rows["n"].to_numpy(np.int64)[order].tobytes()]})


GROUP_SCHEMA = "digest binary, keep_id long, group_size long, historical boolean, incoming boolean"


def _look_up(key: tuple, new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Incoming distinct digests of one shard against its slots; every digest of either side comes out once."""
    if len(index):
        r = index.iloc[0]
        sizes = np.frombuffer(r["sizes"], np.int64)
        mph = PerfectHash(sizes, np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(sizes.sum())).astype(bool))
        held = np.frombuffer(r["digests"], "<u8").reshape(-1, 4)
        winners, copies = (np.frombuffer(r[c], np.int64) for c in ("winners", "copies"))
        known = np.frombuffer(r["known"], bool)
    else:
        mph, held = PerfectHash(np.zeros(0, np.int64), np.zeros(0, bool)), np.zeros((0, 4), "<u8")
        winners, copies, known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    asked = _words(new["digest"]) if len(new) else np.zeros((0, 4), "<u8")
    slot = mph.slots(asked)
    member = slot >= 0
    member[member] = (held[slot[member]] == asked[member]).all(axis=1)
    hit = slot[member]
    top, n = new["top"].astype("Int64"), new["n"].to_numpy(np.int64) if len(new) else np.zeros(0, np.int64)
    of_slot = pd.array(winners, dtype="Int64")
    of_slot[~known] = pd.NA
    keep, size = top.array.copy(), n.copy()
    size[member] += copies[hit]
    both = pd.DataFrame({"a": keep[member], "b": of_slot[hit]}, dtype="Int64")
    keep[member] = both.max(axis=1).astype("Int64").array
    rest = np.ones(len(held), bool)
    rest[hit] = False
    return pd.DataFrame({
        "digest": [x.tobytes() for x in asked] + [x.tobytes() for x in held[rest]],
        "keep_id": pd.concat([pd.Series(keep), pd.Series(of_slot[rest])], ignore_index=True).astype("Int64"),
        "group_size": np.concatenate([size, copies[rest]]),
        "historical": np.concatenate([member, np.ones(int(rest.sum()), bool)]),
        "incoming": np.concatenate([np.ones(len(asked), bool), np.zeros(int(rest.sum()), bool)])})


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    """One row a digest and shard: largest doc_id and number of copies (``copies`` counts equal rows)."""
    by = rows.groupBy("digest").agg(F.max("doc_id").alias("top"), F.sum("copies").alias("n"))
    prefix = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return by.select(F.pmod(prefix, F.lit(shards)).cast("int").alias("shard"), "digest", "top", "n")


def digest_index(rows: DataFrame, shards: int) -> DataFrame:
    """Historical rows (doc_id, digest, copies) as one perfect-hash row a shard."""
    return _distinct(rows, shards).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def digest_rows(docs: DataFrame, historical: Column) -> DataFrame:
    """(doc_id, digest, historical, copies): rows equal in doc_id and normalised text counted together."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"),
                        F.coalesce(historical, F.lit(False)).alias("historical"))
            .groupBy("doc_id", "digest").agg(F.max("historical").alias("historical"), F.count(F.lit(1)).alias("copies")))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, historical, incoming) for every distinct digest of ``digest_rows``."""
    old, new = rows.where("historical"), rows.where("not historical")
    shards = 1 + old.count() // SHARD
    index = digest_index(old, shards)
    return (_distinct(new, shards).groupBy("shard").cogroup(index.groupBy("shard"))
            .applyInPandas(_look_up, GROUP_SCHEMA))


def exact_duplicates(docs: DataFrame, historical: Column | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, copy.

    ``historical`` marks the rows whose digests make the perfect hash; by
    default the half of the ids whose crc32 is even."""
    historical = crc_mod("doc_id", 2) == 0 if historical is None else historical
    rows = written(digest_rows(docs, historical), "digests")
    out = rows.join(duplicate_groups(rows).select("digest", "keep_id", "group_size"), "digest")
    return repeated(out, "copies", "copy").select("doc_id", "keep_id", "group_size", "digest", "copy",
                         (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """Documents without exact repeats: of equal texts the row with the largest doc_id stays."""
    rows = exact_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id", "digest")
    own = docs.select("doc_id", "text").select("doc_id", text_digest(F.col("text")).alias("digest"),
                                               row_key().alias("row_key"))
    # texts of one digest and one doc_id may differ in case: the least key stays
    kept = (own.join(rows.withColumnRenamed("doc_id", "keep_id"), "digest")
            .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .groupBy("digest").agg(F.min("row_key").alias("row_key")))
    return keep_by_key(docs, kept)


@query("op4_exact_dedup", sql="""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents),
w AS (
  SELECT doc_id, h, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
         row_number() OVER (PARTITION BY h, doc_id) AS copy
  FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND copy = 1) AS kept, h AS text_sha256
FROM w""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
