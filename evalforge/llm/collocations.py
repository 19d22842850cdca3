"""Operator 13: phrase collocations from an FM-index per shard over word ids.

A shard is some SHARD bytes of whole pieces of one language.  Its words become
ids, and ``WordIndex`` keeps the Burrows-Wheeler transform of the id sequence
and of its reverse.  A phrase is an interval of rows in both; one extension to
the left (or right) by every word that stands there turns all phrases of a
length into those of the next, with their counts, as array operations.  Rows
are sorted by the next DEPTH words only, all that phrases of up to DEPTH words
need.  Counts of the shards are added up by Spark, level by level:

1. words; those seen fewer than LEAST times in their language end a piece, as
   no phrase with one can be frequent;
2. pairs, by left extension; a shard gets back its pairs that are frequent
   in all shards together;
3. phrases of three and four words whose pairs are all frequent, by left
   extension of a pair and right extension of what that gives.

No count is estimated and nothing frequent is lost: a phrase seen LEAST times
has only words and pairs seen as often.  Words and pairs are added up by a
window over their rows, one a shard, so that total and shard stand side by
side after one shuffle; a word that is in every text has one row a shard.

A candidate's cuts look up the counts of both parts in a join; containment
needs the phrases one word longer only, because a phrase two words longer that
is frequent enough has one in between that is at least as frequent.

Defined cases: null text is empty, a null lang is `und`; texts without words
count nothing; a text longer than a shard is cut between pieces; repeated rows
count each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, drop_written, placed, written
from .registry import documents, query

DEPTH, LEAST, TOP, INSIDE, SHARD = 4, 30, 2000, 80, 12 << 20
_STOPS = ",;:!?\n\x0b\x0c\r"
_MAP = bytes.maketrans((UPPER + _STOPS + "\t").encode(), (UPPER.lower() + "." * len(_STOPS) + " ").encode())


# ---------------------------------------------------------------- shards

def encode(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words by falling count, their counts, and the text as ids from 1, 0 between pieces.  ``data``: pieces end at dots."""
    buf = np.frombuffer(data.replace(b".", b" . "), np.uint8)
    own = buf != 32
    before = np.empty(len(own), bool)
    before[:1], before[1:] = False, own[:-1]
    starts = np.flatnonzero(own & ~before)
    offsets = np.append(np.cumsum(own)[starts] - 1, own.sum()).astype(np.int32)
    letters = np.ascontiguousarray(buf[own])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    names, ids = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(ids, minlength=len(names))
    order = sorted((k for k in range(len(names)) if names[k] != b"."), key=lambda k: (-counts[k], names[k]))
    new = np.zeros(len(names), np.uint32)
    new[order] = np.arange(1, len(order) + 1)
    return [names[k].decode() for k in order], counts[order], new[ids]


def pack(ids: np.ndarray) -> bytes:
    """Ids as four planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pieces(text: str, size: int) -> Iterator[bytes]:
    """The text in parts of whole pieces, each of about ``size`` bytes."""
    data = text.encode().translate(_MAP)
    while len(data) > size:
        cut = data.find(b".", size) + 1
        if not cut:
            break
        yield data[:cut]
        data = data[cut:]
    yield data


SHARDS = "shard long, lang string, words array<string>, counts array<long>, ids binary"


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """One row a shard: its words, their counts and its text as ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, total = TaskContext.get().partitionId() << 18, 0, 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> pd.DataFrame:
            words, counts, ids = encode(b".".join(held.pop(lang)))
            sizes.pop(lang)
            return pd.DataFrame({"shard": [base + made], "lang": [lang], "words": [words], "counts": [counts.tolist()],
                                 "ids": [pack(ids)]})
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                for part in pieces(text, size):
                    held.setdefault(lang, []).append(part)
                    sizes[lang], total = sizes.get(lang, 0) + len(part), total + len(part)
                    if sizes[lang] >= size or total >= 4 * size:
                        full = [lang] if sizes[lang] >= size else list(held)
                        for name in full:
                            total -= sizes[name]
                            yield out(name)
                            made += 1
        for name in list(held):
            yield out(name)
            made += 1
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInPandas(run, SHARDS), "phrase-shards", release=True)


# ---------------------------------------------------------------- index

class WordIndex:
    """FM-index in both directions of ids (0: no word); intervals are (row, reverse row, size) of phrases up to ``depth``."""

    def __init__(self, ids: np.ndarray, depth: int = DEPTH):
        self.text, self.depth = np.concatenate([[0], ids, [0]]).astype(np.int64), depth
        self.width = int(self.text.max()) + 1
        self.sides: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def side(self, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """The transform of the text (or its reverse) and the row that each row's word leads to."""
        if reverse not in self.sides:
            text = self.text[::-1] if reverse else self.text
            rank, seen = text, 1
            while seen < self.depth:
                ahead = np.concatenate([rank[seen:], np.zeros(seen, np.int64)])
                rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1]
                seen *= 2
            bwt = text[np.argsort(rank, kind="stable") - 1]
            lead = np.empty(len(bwt), np.int64)
            lead[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
            self.sides[reverse] = bwt, lead
        return self.sides[reverse]

    def words(self) -> tuple[np.ndarray, ...]:
        """Word ids and their intervals."""
        sizes = np.bincount(self.text, minlength=self.width)
        first = np.cumsum(sizes) - sizes
        own = np.flatnonzero(sizes)
        own = own[own > 0]
        return own, first[own], first[own], sizes[own]

    def extend(self, row: np.ndarray, back: np.ndarray, size: np.ndarray, right: bool = False) -> tuple[np.ndarray, ...]:
        """All extensions by one word to the left (or right): index of the phrase extended, the word, and the new intervals."""
        bwt, lead = self.side(right)
        if right:
            row, back = back, row
        of = np.repeat(np.arange(len(row)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + row[of]
        key, first, n = np.unique(of * self.width + bwt[at], return_index=True, return_counts=True)
        of, word = np.divmod(key, self.width)
        less = np.cumsum(n) - n  # rows of the phrase with a smaller word: those before, less those of earlier phrases
        less -= (np.cumsum(size) - size)[of]
        new, other = lead[at[first]], back[of] + less
        keep = word > 0
        new, other = (other, new) if right else (new, other)
        return of[keep], word[keep], new[keep], other[keep], n[keep]


FREQUENT = "shard long, ids binary, wids array<long>"


def keep_frequent(key: tuple, held: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """The text of a shard with its frequent words alone, as ids from 1 in the order of the common ids ``wids``."""
    if not len(held) or not len(words):
        return pd.DataFrame({"shard": [], "ids": [], "wids": []}, dtype=object)
    ids, words = unpack(held["ids"].iloc[0]), words.sort_values("wid")
    small = np.zeros(int(ids.max()) + 1, np.uint32)
    small[words["id"].to_numpy(np.int64)] = np.arange(1, len(words) + 1)
    return pd.DataFrame({"shard": [key[0]], "ids": [pack(small[ids])], "wids": [words["wid"].to_numpy(np.int64)]})


PAIRS = "shard long, a long, b long, c long"


def shard_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of all pairs of words of each shard."""
    for batch in batches:
        for shard, ids, wids in zip(batch["shard"], batch["ids"], batch["wids"]):
            index = WordIndex(unpack(ids))
            word, row, back, size = index.words()
            of, left, _, _, n = index.extend(row, back, size)
            yield pd.DataFrame({"shard": shard, "a": wids[left - 1], "b": wids[word[of] - 1], "c": n})


PHRASES = "a long, b long, c long, d long, n long"


def shard_phrases(key: tuple, held: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Counts of the phrases of three and four words (d is -1 for three) whose pairs are all frequent."""
    none = np.zeros(0, np.int64)
    out = {c: [none] for c in "abcdn"}
    if len(held) and len(pairs):
        ids, wids = unpack(held["ids"].iloc[0]), np.asarray(held["wids"].iloc[0], np.int64)
        la, lb = (np.searchsorted(wids, pairs[c].to_numpy(np.int64)) + 1 for c in "ab")
        paired = np.zeros(len(wids) + 1, np.uint32)
        paired[la] = la
        paired[lb] = lb
        index = WordIndex(paired[ids])
        known = np.sort(la * index.width + lb)

        def frequent(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            k = x * index.width + y
            return known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k
        word, row, back, size = index.words()
        of, b, row, back, n = index.extend(row, back, size)
        keep = frequent(b, word[of])
        b, c, row, back, n = b[keep], word[of][keep], row[keep], back[keep], n[keep]
        of, a, row, back, n = index.extend(row, back, n)
        keep = frequent(a, b[of])
        of, a, row, back, n = of[keep], a[keep], row[keep], back[keep], n[keep]
        b, c = b[of], c[of]
        more, d, _, _, m = index.extend(row, back, n, right=True)
        keep = frequent(c[more], d)
        more, d, m = more[keep], d[keep], m[keep]
        for name, three, four in (("a", a, a[more]), ("b", b, b[more]), ("c", c, c[more])):
            out[name] += [wids[three - 1], wids[four - 1]]
        out["d"] += [np.full(len(a), -1), wids[d - 1]]
        out["n"] += [n, m]
    return pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})


# ---------------------------------------------------------------- counts of all shards

def phrase_counts(docs: DataFrame, least: int = LEAST, size: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (wid, lang, word, f), phrases (w, f) of one to DEPTH words with f >= ``least``, and words a language (lang, n)."""
    held = shards(docs, size)
    every = held.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "shard", "lang", (F.col("pos") + 1).cast("long").alias("id"), F.col("col.words").alias("word"), F.col("col.counts").alias("c"))
    totals = held.select("lang", F.expr("aggregate(counts, 0L, (x, c) -> x + c)").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    same = Window.partitionBy("lang", "word")
    vocabulary = written(every.select(
        "shard", "id", "lang", "word", F.sum("c").over(same).alias("f"),
        F.min(F.struct("shard", "id")).over(same).alias("first")).where(F.col("f") >= least)
        .select("shard", "id", "lang", "word", "f", F.shiftleft(F.col("first.shard"), 24).bitwiseOR(F.col("first.id")).alias("wid"),
                (F.col("first.shard") == F.col("shard")).alias("leads")), "phrase-words", release=True)
    words = vocabulary.where("leads").select("wid", "lang", "word", "f")
    totals = written(totals, "phrase-totals")
    texts = written(held.select("shard", "ids").groupBy("shard").cogroup(vocabulary.select("shard", "id", "wid").groupBy("shard"))
                    .applyInPandas(keep_frequent, FREQUENT), "phrase-texts", release=True)
    drop_written(held)
    two = Window.partitionBy("a", "b")
    pairs = written(texts.mapInPandas(shard_pairs, PAIRS)
                    .select("shard", "a", "b", F.sum("c").over(two).alias("f"), F.min("shard").over(two).alias("first"))
                    .where(F.col("f") >= least), "phrase-pairs", release=True)
    longer = (texts.groupBy("shard").cogroup(pairs.select("shard", "a", "b").groupBy("shard")).applyInPandas(shard_phrases, PHRASES)
              .groupBy("a", "b", "c", "d").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    phrases = (words.select(F.array("wid").alias("w"), "f")
               .union(pairs.where("shard = first").select(F.array("a", "b"), "f"))
               .union(longer.select(F.when(F.col("d") < 0, F.array("a", "b", "c")).otherwise(F.array("a", "b", "c", "d")), "f")))
    return words, written(phrases, "phrases", release=True), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    words, phrases, totals = phrase_counts(docs, least, size)
    many = phrases.where(F.size("w") > 1)
    cuts = many.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "w", "a", "k", F.slice("w", 1, F.col("k")).alias("left"), F.slice("w", F.col("k") + 1, F.size("w")).alias("right"))
    part = lambda side, f: phrases.select(F.col("w").alias(side), F.col("f").alias(f))
    scored = (cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
              .withColumn("score", F.expr("cast((cast(2000000 as decimal(38, 0)) * a) div (cast(l as decimal(38, 0)) + r) as long)"))
              .groupBy("w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    around = (phrases.where(F.size("w") > 2)
              .select(F.explode(F.array(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w")))).alias("w"), "f")
              .groupBy("w").agg(F.max("f").alias("longer")))
    kept = written(scored.join(around, "w", "left")
                   .where(f"longer is null or cast(100 as decimal(38, 0)) * longer < cast({inside} as decimal(38, 0)) * a")
                   .select("w", "a", "cut"), "collocations")
    named = (kept.select("w", F.posexplode("w").alias("pos", "wid")).join(words.select("wid", "lang", "word"), "wid")
             .groupBy("w").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
             .select("w", "lang", F.array_join("words.word", " ").alias("phrase")))
    best = placed(kept.join(named, "w").select("lang", "phrase", "a", "cut"), "lang",
                  [F.desc("cut.score"), F.desc("a"), F.col("phrase")], "collocations-ranked")
    return (best.where(F.col("idx") < top).join(totals, "lang")
            .select("lang", (F.col("idx") + 1).alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


@query("op13_collocations", sql=f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS piece_id, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT piece_id, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM q),
e AS (
  SELECT lang, x AS x1, lead(x, 1) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4
  FROM t WINDOW o AS (PARTITION BY piece_id ORDER BY i)),
g AS (
  SELECT lang, 1 AS m, x1 AS phrase, count(*) AS f FROM e GROUP BY ALL
  UNION ALL SELECT lang, 2, x1 || ' ' || x2, count(*) FROM e WHERE x2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, concat_ws(' ', x1, x2, x3), count(*) FROM e WHERE x3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, concat_ws(' ', x1, x2, x3, x4), count(*) FROM e WHERE x4 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM g WHERE m = 1 GROUP BY lang),
k AS (SELECT * FROM g WHERE f >= {LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM k WHERE m > 1),
s AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r,
         ((2000000::hugeint * c.f) // (x.f::hugeint + y.f))::bigint AS score
  FROM c, (SELECT unnest(range(1, {DEPTH})) AS cut)
  JOIN k x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ')
  JOIN k y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
  WHERE cut < c.m),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s),
z AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(f) AS longer
  FROM c, (SELECT unnest(range(1, {DEPTH})) AS i), (SELECT unnest(range(2, {DEPTH})) AS j)
  WHERE j < m AND i + j - 1 <= m GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT b.lang, b.phrase, a, l, r, n, score,
             row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
      FROM b JOIN n ON n.lang = b.lang LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase
      WHERE o = 1 AND (longer IS NULL OR 100 * longer < {INSIDE} * a))
WHERE rank <= {TOP}""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
