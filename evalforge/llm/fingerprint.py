"""Operator 1: document fingerprints by SimHash, with permuted block tables. DataFrame and SQL functions only.

Terms are pairs of neighbouring words (lower-cased, cut at white space; the
last word stands alone).  A term weighs 1 if one of its words has at most three
characters, else 2, and each occurrence votes: its two 64-bit hashes add or
subtract the weight at each of 128 positions; a positive sum sets the bit.
Votes are 64 sums after an explode, each sum holding two 32-bit counters of the
weights that voted for a bit (sum > 0 is the same as 2 * counter > total).

Search: 128 bits in ``BLOCKS`` blocks; two fingerprints within ``RADIUS`` bits
agree in at least BLOCKS - RADIUS blocks.  There is a table for each choice of
that many blocks (the bits permuted so that those blocks lead), keyed by their
value.  Members of a key are compared in chunks of about ``CHUNK``, as many as its
measured count asks for: each chunk goes to each other as an array, joined by the
other's number, and each member counts its neighbours there, so no pair is emitted,
no key is gathered, and a key of any size is as many join keys as it has chunks.
A pair counts only in the first table that shows it.

Results return to the rows by fingerprint.  A fingerprint of more than 1/HOT of all
rows is one of at most HOT; those are broadcast, so copies of one text stay where they are.
No other table is: Spark sizes rows after an explode as those before it, so the others are joined by sorting.

Defined cases: null text is empty; an empty or white-space text has no terms
and fingerprint zero; null doc_ids sort first; equal doc_ids are ordered by
a hash of the text, then the text; a single document is its own next one; repeated rows come back each.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWEST, repeated, written
from .registry import documents, query

BLOCKS, RADIUS, CHUNK, BUCKETS = 8, 6, 256, 8
HOT = 1 << 14  # rows of the broadcast, at most: 40 bytes each
LANE = 0x0000000100000001


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def terms(text: Column, shift: int = 0) -> Column:
    """array<struct<h, w>>: hash and weight (plus ``shift``) of every term of the text."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def of(words: Column) -> Column:
        short = lambda c: F.coalesce(F.char_length(c) <= 3, F.lit(False))
        return F.transform(words, lambda a, i: F.struct(
            F.xxhash64(a, F.get(words, i + 1)).alias("h"),
            (F.lit(2 + shift) - (short(a) | short(F.get(words, i + 1))).cast("int")).alias("w")))
    return F.get(F.transform(F.array(words), of), 0)  # the words are split once


def votes(rows: DataFrame, keys: list[str], h: str = "h", w: str = "w") -> DataFrame:
    """Rows of terms to one row a key with the fingerprint halves ``hi`` and ``lo``."""
    lanes = lambda c, k: F.shiftrightunsigned(c, k).bitwiseAND(F.lit(LANE)) * F.col(w)
    two = F.xxhash64(F.col(h), F.lit(1))
    sums = [F.sum(lanes(c, k)).alias(f"{p}{k}") for p, c in (("hi", F.col(h)), ("lo", two)) for k in range(32)]
    got = rows.groupBy(*keys).agg(F.sum(F.col(w).cast("long")).alias("total"), *sums)

    def half(p: str) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            low, high = F.col(f"{p}{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"{p}{k}"), 32)
            for bit, c in ((k, low), (k + 32, high)):
                out = out.bitwiseOR(F.when(2 * c > F.col("total"), F.lit(_signed(1 << bit)).cast("long"))
                                    .otherwise(F.lit(0).cast("long")))
        return F.coalesce(out, F.lit(0).cast("long"))
    return got.select(*keys, half("hi").alias("hi"), half("lo").alias("lo"))


def _range_cuts(docs: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """Lower ends (id, hash of the text) of at most about ``buckets`` ranges of near-equal row counts, ascending.

    An id that holds several quantiles is cut by the hash of its texts, each cut at a hash that occurs; for other ids
    the hash is LOWEST.  The list is as long as the number of ranges.  Null ids count as the least long."""
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    row = docs.select(at.alias("v")).agg(F.min("v").alias("lo"),
                                         F.percentile_approx("v", shares, 20 * buckets).alias("q")).first()
    if row is None or row["lo"] is None:
        return []
    parts = Counter(row["q"])
    cuts = {(v, LOWEST) for v in {row["lo"], *parts} if parts[v] < 2}
    if hot := {v: n for v, n in parts.items() if n > 1}:
        n = F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("v"))
        h = docs.select(at.alias("v"), _text_hash("text").alias("h")).where(F.col("v").isin(*hot))
        sub = F.floor((F.col("h") / float(2 ** 64) + 0.5) * n)
        cuts |= {(r["v"], r["h"]) for r in h.groupBy("v", sub.alias("sub")).agg(F.min("h").alias("h")).collect()}
    return sorted(cuts)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(2))


def with_next(docs: DataFrame) -> DataFrame:
    """(part, place, own, doc_id, text, next): each text with the text of the next document by doc_id (the first
    after the last).  Documents are cut into ranges of doc_id, an id of very many rows by the hash of its texts too;
    the first rows of a range also stand, as guests (``own`` false), at the end of the range before."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _range_cuts(docs, BUCKETS * n) or [(LOWEST, LOWEST)]
    m = len(cuts)
    at = F.coalesce("doc_id", F.lit(LOWEST))
    ids, hashes = (F.array(*[F.lit(c[k]) for c in cuts]) for k in (0, 1))
    steps = [1 << k for k in reversed(range(m.bit_length()))]
    reached = lambda i: (F.get(ids, i) < at) | ((F.get(ids, i) == at) & (F.get(hashes, i) <= F.col("h")))
    part = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda i, s: F.when((i + s < m) & reached(i + s), i + s).otherwise(i))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                        _text_hash("text").alias("h")).withColumn("part", part))
    low = F.get(hashes, F.col("part"))
    first = (F.get(ids, F.col("part")) == at) & ((low == LOWEST) | (low == F.col("h")))
    place = lambda part, wrap, own: F.struct(
        part.cast("int").alias("part"), wrap.alias("wrap"), F.lit(own).alias("own"))
    here = place(F.col("part"), F.lit(False), True)
    before = place(F.pmod(F.col("part") - 1, F.lit(m)), F.col("part") == 0, False)
    spread = rows.select("doc_id", "text", "h", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here)))
                         .alias("p")).select("doc_id", "text", "h", "p.*")
    order = Window.partitionBy("part").orderBy("wrap", at, "h", "text", F.desc("own"))
    return spread.select("part", F.row_number().over(order).alias("place"), "own", "doc_id", "text",
                         F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, hi, lo, edited_hi, edited_lo, near_edited, near_next."""
    n = F.char_length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", n).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half)))
    keys = ["part", "place", "own", "doc_id", "n_chars", "edited_digest"]
    voting = rows.select(
        "part", "place", "own", "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_digest"),
        F.concat(F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("w")),
                         F.struct(F.lit(0).cast("long").alias("h"), F.lit(4).alias("w"))),
                 terms(F.col("text")), terms(F.col("edited"), 4)).alias("t"))
    each = voting.select(*keys, F.explode("t").alias("t")).select(
        *keys, F.shiftright("t.w", 2).alias("kind"), F.col("t.h").alias("h"), F.col("t.w").bitwiseAND(3).alias("w"))
    by = votes(each, [*keys, "kind"])
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    got = by.groupBy(*keys).agg(pick("hi", 0).alias("hi"), pick("lo", 0).alias("lo"),
                                pick("hi", 1).alias("edited_hi"), pick("lo", 1).alias("edited_lo"))
    order = Window.partitionBy("part").orderBy("place")
    ahead = got.withColumns({"next_hi": F.lead("hi").over(order), "next_lo": F.lead("lo").over(order)})
    near = lambda a, b: 1 - (F.bit_count(F.col("hi").bitwiseXOR(F.col(a)))
                             + F.bit_count(F.col("lo").bitwiseXOR(F.col(b)))) / 128.0
    return ahead.where("own").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_digest")).alias("edited_sha256"), "hi", "lo", "edited_hi",
        "edited_lo", near("edited_hi", "edited_lo").cast("double").alias("near_edited"),
        near("next_hi", "next_lo").cast("double").alias("near_next"))


def _block(hi: Column, lo: Column, b: int, blocks: int) -> Column:
    """Bits of block b as a long; 128 must be a multiple of ``blocks`` and no block may cross the halves."""
    size = 128 // blocks
    at = b * size
    return F.shiftrightunsigned(hi if at < 64 else lo, at % 64).bitwiseAND(F.lit((1 << size) - 1))


def neighbours(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(hi, lo, n_links) of every fingerprint that has others within ``radius`` bits, n_links counting them all."""
    if not radius < blocks <= 16 or 128 % blocks:
        raise ValueError("blocks must divide 128, exceed the radius and be at most 16")
    tables = list(combinations(range(blocks), blocks - radius))
    own = prints.select("hi", "lo").distinct()
    hi, lo = F.col("hi"), F.col("lo")
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[_block(hi, lo, b, blocks) for b in use]).alias("key"))
                     for t, use in enumerate(tables)])
    index = own.select("hi", "lo", F.explode(keys).alias("k")).select("hi", "lo", "k.*")
    shared = index.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = index.join(shared.hint("merge"), ["table", "key"]).withColumn("of", F.ceil(F.col("n") / chunk)).withColumn(
        "chunk", F.pmod(F.xxhash64("hi", "lo", F.lit(3)), F.col("of")))
    chunks = written(members.groupBy("table", "key", "chunk", "of").agg(F.collect_list(F.struct("hi", "lo")).alias("many")),
                     "block-tables")
    asked = repeated(chunks.select("table", "key", "of", F.col("many").alias("mine")), "of", "other")
    met = (asked.withColumn("chunk", F.col("other") - 1).join(chunks.drop("of").hint("merge"), ["table", "key", "chunk"])
           .select("table", "many", F.explode("mine").alias("m")).select("table", "many", "m.*"))

    def linked(x: Column) -> Column:
        a, b = x["hi"].bitwiseXOR(hi), x["lo"].bitwiseXOR(lo)
        apart = F.bit_count(a) + F.bit_count(b)
        same = [F.when(_block(a, b, k, blocks) == 0, F.lit(1 << k)).otherwise(0) for k in range(blocks)]
        agree = same[0]
        for s in same[1:]:
            agree = agree + s
        # the first table that shows the pair: the lowest blocks that agree
        bits = agree
        taken = F.lit(0)
        for _ in range(blocks - radius):
            low = bits.bitwiseAND(-bits)
            taken, bits = taken + low, bits - low
        mask = F.element_at(F.array(*[F.lit(sum(1 << k for k in use)) for use in tables]), F.col("table") + 1)
        return (apart > 0) & (apart <= radius) & (taken == mask)
    found = met.select("hi", "lo", F.size(F.filter("many", linked)).alias("n")).where("n > 0")
    return found.groupBy("hi", "lo").agg(F.sum("n").alias("n_links"))


def _hex(hi: str, lo: str) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in (hi, lo)])


@query("op1_document_fingerprints")
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also class_id, the smallest doc_id with the same fingerprint, and n_links, the number of
    other fingerprints of documents within RADIUS bits."""
    return with_links(written(fingerprints(documents(spark, sf_dir)), "document-fingerprints")).select(
        "doc_id", "n_chars", "edited_sha256", _hex("hi", "lo").alias("fingerprint"),
        _hex("edited_hi", "edited_lo").alias("edited_fingerprint"), "near_edited", "near_next", "class_id", "n_links")


def with_links(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows`` (doc_id, hi, lo, ...) with class_id and n_links."""
    classes = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    linked = written(classes.join(neighbours(classes).hint("merge"), ["hi", "lo"], "left").select(
        "hi", "lo", "class_id", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "fingerprint-classes")
    many = F.col("copies") * hot > (linked.agg(F.sum("copies")).first()[0] or 0)
    often, rare = linked.where(many).drop("copies"), linked.where(~many).drop("copies")
    return (rows.join(F.broadcast(often), ["hi", "lo"])
            .unionByName(rows.join(F.broadcast(often), ["hi", "lo"], "left_anti").join(rare.hint("merge"), ["hi", "lo"])))
