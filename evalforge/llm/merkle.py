"""Operator 11: Merkle dataset manifest by time-forward processing.

Every row is a leaf digest; the leaves of a language make a tree, the roots of
the trees make the tree of the manifest.  A tree is a graph whose nodes are
labelled so that every edge goes from a smaller label to a larger one:

* Forward sweep: nodes are visited by label.  A node takes the digests that an
  external priority queue, ordered by label, holds for it, and sends its own to
  the label of its parent.  What it took is noted.
* Reversed sweep: nodes are visited from the largest label down.  A node takes
  the proof suffix the queue holds for it, and sends each child that suffix
  behind the digests of the child's siblings.  Leaves end up with whole proofs.

``LabelQueue`` keeps a bounded heap in memory and sorted runs in a file of the
task's own folder.  One task sweeps a block of FANOUT ** LEVELS neighbouring
nodes; messages between blocks go through tables in the shared folder, where
the shuffle by (tree, block) delivers them: the roots of blocks are the nodes
of the next layer, until a tree has one node left.  The reversed sweep reads
the layers backwards.  A tree of n leaves has log(n) / (LEVELS log FANOUT)
layers; neither the driver nor a task ever holds more than one block.

Leaves are placed by a range-partitioned sort, numbered inside their partition
and moved on by the counts of the partitions before, so a language that holds
a third of all rows is many tasks.

Defined cases: a null field is `-`; a null lang is a tree of its own and comes
first; null doc_ids come first in their tree, equal doc_ids are ordered by leaf
digest, fully equal rows have a leaf each; a null doc_id or null n_chars is
never tampered with; an empty table gives an empty manifest; extra columns are
not read.
"""

from __future__ import annotations

import heapq
import struct
import tempfile
from collections.abc import Iterator
from hashlib import sha256
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import placed, written
from .registry import documents, query

FANOUT, LEVELS = 2, 12
ROOM = 1 << 16  # messages of a queue in memory
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class LabelQueue:
    """External priority queue of (label, place, payload), smallest label first, places in order."""

    def __init__(self, room: int = ROOM):
        self.room, self.heap, self.file = room, [], None
        self.heads: list[tuple] = []  # (label, place, payload, run) of each spilled run
        self.runs: list[list[int]] = []  # next byte and end of each run

    def _next(self, run: int) -> None:
        at, end = self.runs[run]
        if at < end:
            self.file.seek(at)
            label, place, size = struct.unpack("<qqI", self.file.read(20))
            heapq.heappush(self.heads, (label, place, self.file.read(size), run))
            self.runs[run][0] = at + 20 + size

    def push(self, label: int, place: int, payload: bytes) -> None:
        if len(self.heap) >= self.room:
            self.file = self.file or tempfile.TemporaryFile()
            start = self.file.seek(0, 2)
            for lab, pl, data in sorted(self.heap):
                self.file.write(struct.pack("<qqI", lab, pl, len(data)) + data)
            self.runs.append([start, self.file.tell()])
            self.heap = []
            self._next(len(self.runs) - 1)
        heapq.heappush(self.heap, (label, place, payload))

    def pop(self, label: int) -> list[tuple[int, bytes]]:
        """(place, payload) of all messages for ``label``; labels must be asked for in order."""
        out = []
        while self.heap and self.heap[0][0] == label:
            out.append(heapq.heappop(self.heap)[1:])
        while self.heads and self.heads[0][0] == label:
            _, place, payload, run = heapq.heappop(self.heads)
            out.append((place, payload))
            self._next(run)
        return sorted(out, key=itemgetter(0)) if len(out) > 1 else out

    def __enter__(self) -> LabelQueue:
        return self

    def __exit__(self, *_) -> None:
        if self.file:
            self.file.close()


def hashed(digests: list[bytes]) -> bytes:
    """Digest of a run: its digests as hex text, one after the other."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def depth(total: int, fanout: int) -> int:
    """Levels above ``total`` nodes until one is left."""
    n = 0
    while total > 1:
        total, n = -(-total // fanout), n + 1
    return n


def shape(n: int, levels: int, fanout: int) -> list[tuple[int, int]]:
    """(first label, nodes) of each level, level by level from the leaves."""
    out, first = [], 0
    for _ in range(levels + 1):
        out.append((first, n))
        first, n = first + n, -(-n // fanout)
    return out


def forward(digests: list[bytes], levels: int, fanout: int = FANOUT, room: int = ROOM) -> tuple[bytes, list[list[bytes]]]:
    """Root of a block, and what each inner node took, in label order."""
    took, own = [], b""
    plan = shape(len(digests), levels, fanout)
    with LabelQueue(room) as queue:
        for level, (first, n) in enumerate(plan):
            above = plan[level + 1][0] if level < levels else None
            for i in range(n):
                if level:
                    children = [d for _, d in queue.pop(first + i)]
                    took.append(children)
                    own = hashed(children)
                else:
                    own = digests[i]
                if above is not None:
                    queue.push(above + i // fanout, i % fanout, own)
    return own, took


def reversed_sweep(n: int, took: list[list[bytes]], suffix: bytes, levels: int, fanout: int = FANOUT,
                   room: int = ROOM) -> list[bytes]:
    """Proof of each of the ``n`` leaves of a block whose root has the proof ``suffix``.

    A proof is a row of steps from the leaf up: own place in the run, length of the run, the others' digests."""
    plan, out, at = shape(n, levels, fanout), [b""] * n, len(took)
    with LabelQueue(room) as queue:
        queue.push(-plan[-1][0], 0, suffix)
        for level in range(levels, -1, -1):
            first, m = plan[level]
            for i in range(m - 1, -1, -1):
                (_, rest), = queue.pop(-(first + i))
                if not level:
                    out[i] = rest
                    continue
                at -= 1
                children, below = took[at], plan[level - 1][0] + i * fanout
                for place in range(len(children)):
                    others = b"".join(children[:place] + children[place + 1:])
                    queue.push(-(below + place), 0, bytes((place, len(children))) + others + rest)
    return out


def steps(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(own place, siblings) level by level."""
    at = 0
    while at < len(proof):
        place, n = proof[at], proof[at + 1] - 1
        at += 2
        yield place, [proof[at + 32 * k:at + 32 * k + 32] for k in range(n)]
        at += 32 * n


def fold(leaf: bytes, proof: bytes) -> bytes:
    """Root that a leaf and its proof lead to."""
    for place, others in steps(proof):
        leaf = hashed(others[:place] + [leaf] + others[place:])
    return leaf


def siblings_digest(proof: bytes) -> bytes:
    return hashed([d for _, others in steps(proof) for d in others])


# ---------------------------------------------------------------- leaves and places

def leaf_digest(n_chars: Column | None = None, fields: tuple = FIELDS) -> Column:
    def part(name: str) -> Column:
        v = (n_chars if name == "n_chars" and n_chars is not None else F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(f) for f in fields]), 256))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, other): leaf of each row and leaf of the row as tampered with."""
    touched = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select("doc_id", "source", "lang", "n_chars", "text").select(
        F.coalesce(F.concat(F.lit("l:"), F.col("lang")), F.lit("-")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest().alias("digest"),
        F.when(touched, leaf_digest(F.col("n_chars") + 1)).alias("other"))


# ---------------------------------------------------------------- layers

def layer(nodes: DataFrame, payload: list[str], fanout: int, levels: int, name: str) -> DataFrame:
    """Nodes (tree, idx, total, digest, payload...) to one row a block: its digests and payloads in order, and its root."""
    size = fanout ** levels
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        total = int(rows["total"].iloc[0])
        root, _ = forward(list(rows["digest"]), min(levels, depth(total, fanout)), fanout)
        held = {c: [[None if pd.isna(v) else v for v in rows[c].astype(object)]] for c in payload}
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "total": [total], "root": [root],
                             "digest": [b"".join(rows["digest"])], **held})
    schema = ", ".join(["tree string, block long, total long, root binary, digest binary",
                        *[f"{c} array<{kinds[c]}>" for c in payload]])
    return written(nodes.select("tree", "idx", "total", "digest", *payload,
                                F.floor(F.col("idx") / size).cast("long").alias("block"))
                   .groupBy("tree", "block").applyInPandas(gather, schema), name)


def climb(nodes: DataFrame, payload: list[str], fanout: int, levels: int, name: str) -> list[DataFrame]:
    """Layers of all trees, the lowest first; the last holds one block, the root, for each tree."""
    size = fanout ** levels
    layers = [layer(nodes, payload, fanout, levels, f"{name}-0")]
    while (layers[-1].agg(F.max("total")).first()[0] or 0) > size:
        below = layers[-1].select("tree", F.col("block").alias("idx"), F.ceil(F.col("total") / size).alias("total"),
                                  F.col("root").alias("digest"))
        layers.append(layer(below, [], fanout, levels, f"{name}-{len(layers)}"))
    return layers


HANDED = "subroot binary, root binary"


def descend(held: DataFrame, suffixes: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """Suffix of each block's root (tree, block, suffix, subroot, root) handed down to its nodes (tree, idx, suffix, ...)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                proofs, _ = block_proofs(r, fanout, levels)
                yield pd.DataFrame({"tree": r.tree, "block": range(r.block * fanout ** levels, r.block * fanout ** levels + len(proofs)),
                                    "suffix": proofs, "subroot": r.subroot, "root": r.root})
    rows = held.select("tree", "block", "total", "digest").join(suffixes, ["tree", "block"])
    return written(rows.mapInPandas(run, f"tree string, block long, suffix binary, {HANDED}"), name)


def block_proofs(r, fanout: int, levels: int) -> tuple[list[bytes], list[bytes]]:
    digests = [r.digest[k:k + 32] for k in range(0, len(r.digest), 32)]
    deep = min(levels, depth(int(r.total), fanout))
    _, took = forward(digests, deep, fanout)
    return reversed_sweep(len(digests), took, r.suffix, deep, fanout), digests


RESULT = "tree string, doc_id long, leaf binary, proof binary, siblings binary, folded binary, subroot binary, root binary"


def manifest(rows: DataFrame, order: list[Column], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Manifest of leaves (tree, doc_id, digest, other): one row each with its proof up to the root over all trees,
    ``siblings``, the digest of all digests in the proof, and ``folded``, the root that ``other`` (null: the leaf itself) and the proof lead to.

    Trees are ordered by name, UTF-8 bytewise."""
    if not 2 <= fanout <= 255 or levels < 1:
        raise ValueError("fanout must be 2 to 255, levels at least 1")
    low = climb(placed(rows, "tree", order, "leaves"), ["doc_id", "other"], fanout, levels, "layer")
    tops = low[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    high = climb(placed(tops, "tree", [F.col("name")], "trees"), ["name"], fanout, levels, "top")
    handed = high[-1].select("tree", "block", F.unhex(F.lit("")).alias("suffix"), F.col("root").alias("subroot"), "root")
    for k, held in enumerate(reversed(high)):
        if k < len(high) - 1:
            handed = descend(held, handed, fanout, levels, "down-top")
            continue

        def name_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    proofs, digests = block_proofs(r, fanout, levels)
                    yield pd.DataFrame({"tree": list(r.name), "block": 0, "suffix": proofs, "subroot": digests, "root": r.root})
        handed = written(held.select("tree", "block", "total", "digest", "name").join(handed, ["tree", "block"])
                         .mapInPandas(name_trees, f"tree string, block long, suffix binary, {HANDED}"), "down-trees")
    for held in reversed(low[1:]):
        handed = descend(held, handed, fanout, levels, "down")

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                proofs, digests = block_proofs(r, fanout, levels)
                folded = [fold(d if o is None else o, p) for d, o, p in zip(digests, r.other, proofs)]
                yield pd.DataFrame({"tree": r.tree, "doc_id": pd.array(list(r.doc_id), dtype="Int64"), "leaf": digests,
                                        "proof": proofs, "siblings": [siblings_digest(p) for p in proofs], "folded": folded,
                                        "subroot": r.subroot, "root": r.root})
    leaves = low[0].select("tree", "block", "total", "digest", "doc_id", "other")
    return leaves.join(handed, ["tree", "block"]).mapInPandas(prove, RESULT)


def merkle_manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Manifest of documents, a tree a language; ``verified`` holds for rows whose stored n_chars was not tampered with."""
    out = manifest(leaf_rows(docs), [F.col("doc_id"), F.col("digest")], fanout, levels)
    return out.withColumn("verified", F.col("folded") == F.col("root"))


@query("op11_merkle_manifest", sql="""
WITH RECURSIVE
c AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
           lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS t),
f AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS z
  FROM documents),
d AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') || z) AS leaf, n_chars,
         sha256(a || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1)::varchar, '-') || z) AS changed
  FROM f),
o AS (
  SELECT doc_id, coalesce('l:' || lang, '-') AS tree, leaf,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS width,
         CASE WHEN n_chars IS NOT NULL AND xor(list_reduce(
                list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::varchar, ''), lambda x: unicode(x)::BIGINT)),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 7 = 0 THEN changed ELSE leaf END AS given
  FROM d, c),
up AS (
  SELECT tree, 0 AS lev, idx, width, leaf AS h FROM o
  UNION ALL
  SELECT tree, lev + 1, idx // 2, max((width + 1) // 2), sha256(string_agg(h, '' ORDER BY idx))
  FROM up WHERE width > 1 GROUP BY tree, lev, idx // 2),
s AS (
  SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS width FROM up WHERE width = 1),
top AS (
  SELECT 0 AS lev, idx, width, h FROM s
  UNION ALL
  SELECT lev + 1, idx // 2, max((width + 1) // 2), sha256(string_agg(h, '' ORDER BY idx))
  FROM top WHERE width > 1 GROUP BY lev, idx // 2),
low(doc_id, tree, leaf, lev, idx, width, h, sib) AS (
  SELECT doc_id, tree, leaf, 0, idx, width, given, '' FROM o
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf, w.lev + 1, w.idx // 2, (w.width + 1) // 2,
         sha256(CASE WHEN u.h IS NULL THEN w.h WHEN w.idx % 2 = 0 THEN w.h || u.h ELSE u.h || w.h END),
         w.sib || coalesce(u.h, '')
  FROM low w LEFT JOIN up u ON u.tree = w.tree AND u.lev = w.lev AND u.idx = xor(w.idx, 1)
  WHERE w.width > 1),
high(doc_id, tree, leaf, lev, idx, width, h, sib) AS (
  SELECT w.doc_id, w.tree, w.leaf, 0, s.idx, s.width, w.h, w.sib FROM low w JOIN s ON s.tree = w.tree WHERE w.width = 1
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf, w.lev + 1, w.idx // 2, (w.width + 1) // 2,
         sha256(CASE WHEN u.h IS NULL THEN w.h WHEN w.idx % 2 = 0 THEN w.h || u.h ELSE u.h || w.h END),
         w.sib || coalesce(u.h, '')
  FROM high w LEFT JOIN top u ON u.lev = w.lev AND u.idx = xor(w.idx, 1)
  WHERE w.width > 1)
SELECT w.doc_id, w.leaf, s.h AS subroot, r.h AS root, sha256(w.sib) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM high w JOIN s ON s.tree = w.tree JOIN top r ON r.width = 1 WHERE w.width = 1""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = lambda c: F.lower(F.hex(c))
    return merkle_manifest(documents(spark, sf_dir)).select(
        "doc_id", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        hexed("siblings").alias("proof_sha256"), hexed("folded").alias("folded_root"), "verified")
