"""Operator 9: language-model scores by a hierarchical Pitman-Yor model.

Chinese restaurants share their parents:

* after every word the next token is a customer of that word's own restaurant;
  its parent is the root;
* the root's customers are the first tokens of the training texts and the tables
  of the context restaurants; its parent is a spelling model, so every string has
  a base probability;
* spelling has a restaurant for each context of the two symbols before (bytes
  in 139 classes, with a start and an end), whose parent is the restaurant of
  one symbol before, then of none, then the uniform distribution.

A table opened in a restaurant is a customer of its parent.  Gibbs sampling
seats the customers of every dish anew, given all the others, for SWEEPS
sweeps: the number of tables of a dish is drawn from its conditional given its
customers and the other tables, whatever their number.  The generalised Stirling
numbers in it come from their recurrence up to EXACT customers, and above from
the integral along the branch cut of their generating function, continued by
its saddle point where the integral cancels (more tables than some four times
c ** discount).  Predictive probabilities are averaged over the sweeps after
the first BURN_IN.

As in the add-one base score, a word never seen in training is one outcome
(V + 1 outcomes in all): its base probability is what the spelling model leaves
over for the words that are not known.

Frequent words are those with at least FREQUENT of the training tokens (at most
1 / FREQUENT of them).  A word with a share of s has at least s / 2 in some part of
the corpus, so each part names its words over s / 2, and the counts of those named
decide; a word named below s does no harm.  Cells of frequent words stand with the
word that follows, so that no key has more than FREQUENT of the tokens; the cells
of all other words are kept by pair (``PairCells``): blocks send their pairs packed to
buckets of the first word, a bucket adds them up, and sweeps draw rows of a cell each.
A pair that occurs once has one table at any time, so only the others are drawn.
Both kinds have the same draws.

Word counts, context cells and their tables live in Spark, one row a distinct
word, and grow with the corpus; each draw depends only on the word, its context
and the sweep, so a retried task draws the same.  Up to the first kept sweep the
seating is written with the words; from there a task works out the state of its
words anew from the sweeps' totals.  The spelling model has at most the
cells of SHAPE (2.7 million, 11 MB), whatever the corpus; only its cell counts
reach the driver, and it is broadcast as the contexts that occur.

Texts are read twice: for the frequent words, then a task turns them into blocks
of word numbers with the block's own word list, written as a table.  Whole
slices of texts are cut and numbered as Arrow columns, with no Python step a word.  A word's
probabilities meet a block once, not once a token, and blocks of bounded size
score their documents.

Defined cases: null text is empty: the end token alone; without training rows
the word restaurants are empty and the spelling model uniform; null doc_ids count
as the id "" for the held-out rule; repeated rows are scored each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, drop_written, written
from .registry import documents, query

SWEEPS, BURN_IN, EXACT = 3, 1, 256
FREQUENT = 1 / 256                  # of the training tokens, from which a word's cells stand with the word that follows
STRENGTH = 1.0                      # of every restaurant
SPELL_DISCOUNT = (0.5, 0.7, 0.8)    # by context length
BLOCK_TOKENS, BLOCK_WORDS = 4_000_000, 400_000
BUCKET = 500_000                    # tokens of a bucket of pairs, on average
SLICE = 4_000_000                   # bytes of text that are cut into words at once
PACK = "zstd"                       # of the word numbers, their four bytes apart
END = b" "                          # the end token; no word holds a space
END_BASE = 1e-3                     # its share of the base distribution

# Symbols: a-z, 0-9, each ASCII mark, other ASCII, continuation bytes, lead bytes, end; start is a context only.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each byte, and log10 of a byte's share of its symbol."""
    sym = np.full(256, 68)
    for k, b in enumerate([*range(97, 123), *range(48, 58), *_MARKS]):
        sym[b] = k
    sym[0x80:0xC0] = 69 + np.arange(64)
    sym[0xC0:0xE0] = 135
    sym[0xC2], sym[0xC3] = 133, 134
    sym[0xE0:0xF0], sym[0xF0:] = 136, 137
    sym[ord("\n")] = 138
    return sym, -np.log10(np.bincount(sym, minlength=139)[sym])


SYMBOL, SHARE = _symbols()
STOP, START, N_SYM = 138, 139, 139
SHAPE = (140, 140, N_SYM)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each symbol with its context, log10 share of each byte, first place of each word), ends included."""
    flat = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    s = SYMBOL[flat]
    before = np.concatenate([[START], s[:-1]])
    before[before == STOP] = START
    two = np.concatenate([[START], before[:-1]])
    two[before == START] = START
    cell = (two * 140 + before) * N_SYM + s
    start = np.concatenate([[0], np.flatnonzero(s == STOP)[:-1] + 1])
    return cell, np.where(s == STOP, 0.0, SHARE[flat]), start


def cells_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``spelled`` with a stand-in for the end token."""
    return spelled([b"x" if w == END else w for w in words])


@dataclass
class Spelling:
    """log10 of the predictive probabilities: one row a context that has customers, and one row a
    symbol before for all contexts that have none and are their parent's copy."""
    row_of: np.ndarray  # by context (two symbols before)
    rows: np.ndarray    # (rows, N_SYM)

    @classmethod
    def of(cls, dense: np.ndarray, parent: np.ndarray, seen: np.ndarray) -> Spelling:
        """``dense``: SHAPE; ``parent``: by the symbol before; ``seen``: contexts with customers."""
        row_of = np.broadcast_to(np.arange(140, dtype=np.int32), (140, 140)).copy()
        row_of[seen] = 140 + np.arange(int(seen.sum()), dtype=np.int32)
        return cls(row_of.ravel(), np.log10(np.concatenate([parent, dense[seen]])).astype(np.float32))

    def log(self, cell: np.ndarray) -> np.ndarray:
        context, symbol = np.divmod(cell, N_SYM)
        return self.rows.ravel()[self.row_of[context].astype(np.int64) * N_SYM + symbol]

    def words(self, words: list[bytes], at: tuple | None = None) -> np.ndarray:
        """Base probability of each word: spelling without the empty word, and the end token apart.
        ``at``: what ``cells_of`` gives for the words, if at hand."""
        if not len(words):
            return np.zeros(0)
        cell, share, start = at or cells_of(words)
        got = np.add.reduceat(self.log(cell) + share, start)
        empty = 10.0 ** float(self.log(np.array([(START * 140 + START) * N_SYM + STOP]))[0])
        out = np.maximum(10.0 ** got, 1e-300) * (1 - END_BASE) / (1 - empty)
        out[[i for i, w in enumerate(words) if w == END]] = END_BASE
        return out


@lru_cache(maxsize=8)
def log_stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t), c and t up to ``size``."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0], t = 0.0, np.arange(size + 1)
    for c in range(size):
        stay = np.where((t > 0) & (c > discount * t), out[c] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1] = np.logaddexp(np.concatenate([[-np.inf], out[c, :-1]]), stay)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """All 64 bits depend on all bits of x."""
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


GOLD = 0x9E3779B97F4A7C15


def _uniform(seeds: np.ndarray) -> np.ndarray:
    return ((_mixed(seeds) >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


NODES, WIDE = 240, 768  # quadrature nodes; tables up to which Stirling numbers are listed


def _log_saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) by the saddle point of [z^c] (1 - (1 - z)^d)^t; c and t broadcast, 1 <= t < c."""
    c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
    goal = np.log(t * discount / c)
    u = np.clip(goal / (1 - discount), -60.0 / (1 - discount), -1e-12)
    for _ in range(48):  # u = log(1 - z) by Newton: its equation rises, concave, with slopes between (1 - d) / 2 and 1 - d
        z, f = -np.expm1(u), -np.expm1(discount * u)
        step = (np.log(f / z) + (1 - discount) * u - goal) / (1 - discount - discount * (1 - f) / f + (1 - z) / z)
        u = np.clip(u - step, -60.0 / (1 - discount), -1e-12)
        if (np.abs(step) <= 1e-13 - 1e-12 * u).all():
            break
    z, f = -np.expm1(u), -np.expm1(discount * u)
    a = z * discount * np.exp((discount - 1) * u) / f
    spread = t * a * (1 + (1 - discount) * z / np.exp(u) - a)
    return (t * np.log(f) - c * np.log(z) - 0.5 * np.log(2 * np.pi * spread) - t * math.log(discount)
            - _log_gamma(t + 1) + _log_gamma(c + 1))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function from 1 on (Stirling's series, shifted by eight)."""
    x = np.asarray(x, float)
    y = x + 8
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - np.log(shift)


def log_stirling_above(c: np.ndarray, tables: int, discount: float) -> np.ndarray:
    """log S(c, t) for t from 1 to ``tables`` (columns; -inf over c) of some c above EXACT (rows).

    [z^c] (1 - (1 - z)^d)^t is an integral along z = 1 + x of the imaginary part of (1 - x^d e^(-i pi d))^t over
    pi (1 + x)^(c + 1), which dies out within some 120 / c for few tables and 4000 / c for up to c / 2: a sum over NODES
    values of log x.  It holds while the parts that cancel are within 1e5 of the sum."""
    c = np.asarray(c, float)[:, None]
    low, high = math.log(1e-14), np.log(np.maximum(120.0, np.minimum(30.0 * c, 4000.0)))
    x = np.exp(low + (high - low) * np.linspace(0, 1, NODES)[None, :]) / c
    weight = np.exp(-(c + 1) * np.log1p(x)) * x * ((high - low) / (NODES - 1) / np.pi)
    step = 1 - x ** discount * np.exp(-1j * np.pi * discount)
    f, size, grows = np.ones(step.shape, complex), weight.copy(), np.abs(step)
    out, last = np.full((len(c), tables), -np.inf), np.zeros(len(c), np.int64)  # tables up to which the integral holds
    sound = np.arange(len(c))
    for t in range(1, tables + 1):
        f *= step
        size *= grows
        value = (weight * f.imag).sum(axis=1)
        holds = (value > 1e-5 * size.sum(axis=1)) & (t <= c[sound, 0] / 2)
        if not holds.all():
            sound, value = sound[holds], value[holds]
            if not len(sound):
                break
            f, size, step, grows, weight = f[holds], size[holds], step[holds], grows[holds], weight[holds]
        out[sound, t - 1] = np.log(value)
        last[sound] = t
    t = np.arange(1, tables + 1, dtype=float)
    out += _log_gamma(c + 1) - t * math.log(discount) - _log_gamma(t + 1)
    short = np.flatnonzero(last < np.minimum(tables, c[:, 0]))
    first = np.maximum(1, last[short])
    many = np.minimum(tables, c[short, 0] - 1).astype(np.int64) - first + 1
    ends = np.cumsum(many)
    more = _log_saddle(np.repeat(c[short, 0], many), np.repeat(first - ends + many, many) + np.arange(many.sum()), discount)
    for row, at, n, end in zip(short, first, many, ends):
        own = more[end - n:end]
        out[row, at - 1:at - 1 + n] = out[row, at - 1] + own - own[0] if last[row] else own
        if tables >= c[row, 0]:
            out[row, int(c[row, 0]) - 1] = 0.0
    return out


def _stirling_rows(counts: np.ndarray, tables: int, discount: float) -> np.ndarray:
    """log S(c, t) for t from 1 to ``tables`` (columns) of ascending counts (rows)."""
    out = np.full((len(counts), tables), -np.inf)
    few, width = int(np.searchsorted(counts, EXACT, side="right")), min(tables, EXACT)
    out[:few, :width] = log_stirling(discount)[counts[:few], 1:width + 1]
    for k in range(few, len(counts), 256):
        out[k:k + 256] = log_stirling_above(counts[k:k + 256], tables, discount)
    return out


def _seat_wide(c: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float,
               draw: np.ndarray) -> np.ndarray:
    """Tables of dishes with more than some WIDE likely tables: by the saddle point around the mode."""
    c, base, r = np.asarray(c, float), np.asarray(base, float), strength / discount + np.asarray(others, float)

    def log_p(t: np.ndarray) -> np.ndarray:
        own = lambda x: x.reshape(x.shape + (1,) * (t.ndim - 1))
        return (_log_saddle(own(c), t, discount) + _log_gamma(own(r) + t) - _log_gamma(own(r))
                + t * np.log(discount * own(base)))
    low, high = np.ones_like(c), c - 1.0
    for _ in range(30):  # the density is log-concave
        mid = (low + high) / 2
        up = log_p(np.minimum(mid + 0.5, c - 0.5)) > log_p(mid)
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    wide = np.maximum(1.0, low / 100)
    near = [log_p(np.clip(low + k * wide, 1, c - 1)) for k in (-1, 0, 1)]
    spread = 8 * wide / np.sqrt(np.maximum(-(near[0] - 2 * near[1] + near[2]), 1e-9))
    t = np.clip(low[:, None] + spread[:, None] * np.linspace(-1, 1, 129)[None, :], 1, c[:, None] - 1)
    lp = log_p(t)
    mass = np.exp(lp - lp.max(axis=1, keepdims=True))
    steps = np.diff(t, axis=1) * (mass[:, 1:] + mass[:, :-1]) / 2
    cum = np.concatenate([np.zeros((len(c), 1)), np.cumsum(steps, axis=1)], axis=1)
    got = [np.interp(u * x[-1], x, y) for u, x, y in zip(draw, cum, t)]
    return np.clip(np.rint(got), 1, c).astype(np.int64)


def seat(customers: np.ndarray, base: np.ndarray, others: np.ndarray | float, discount: float, strength: float,
         seeds: np.ndarray) -> np.ndarray:
    """Tables of each dish, drawn given the tables of the other dishes of its restaurant (``others``).

    With c customers, P(t) is in proportion to S(c, t) * prod_{k<t}(strength + discount * (others + k)) * base^t."""
    c, base = np.asarray(customers, np.int64), np.asarray(base, float)
    others = np.broadcast_to(np.asarray(others, float), c.shape)
    seeds = _mixed(np.asarray(seeds).view(np.uint64))
    out = np.minimum(c, 1)
    draw = (seeds >> np.uint64(11)).astype(float) / 2.0 ** 53
    at = np.flatnonzero(c > 1)
    at = at[np.argsort(c[at], kind="stable")]
    tables = 12
    while len(at):  # most dishes have few tables: those whose probabilities have not died out by then come again
        wait = []
        for i in range(0, len(at), 8192):
            some = at[i:i + 8192]
            counts, row = np.unique(c[some], return_inverse=True)
            rest, other = np.unique(others[some], return_inverse=True)
            t = np.arange(1, tables + 1)
            z = _stirling_rows(counts, tables, discount)[row]
            z += np.cumsum(np.log(strength + discount * (rest[:, None] + t - 1)), axis=1)[other]
            z += t * np.log(base[some, None])
            most = z.max(axis=1, keepdims=True)
            done = (z[:, -1] < most[:, 0] - 30) | (c[some] <= tables)
            z -= most
            z = np.cumsum(np.exp(z, out=z), axis=1, out=z)
            out[some[done]] = 1 + (z[done] < draw[some[done], None] * z[done, -1:]).sum(axis=1)
            wait.append(some[~done])
        at, tables = np.concatenate(wait), tables * 4
        if tables > WIDE:
            for i in range(0, len(at), 512):
                some = at[i:i + 512]
                out[some] = _seat_wide(c[some], base[some], others[some], discount, strength, draw[some])
            break
    return out


def fit_spelling(cells: np.ndarray, counts: np.ndarray, seed: int, sweeps: int = 2) -> Spelling:
    """Seat the symbols of the spelling restaurants: cell numbers and customer counts (arrays of fixed bound)."""
    rng = np.random.default_rng(seed)
    c3 = np.zeros(140 * 140 * N_SYM, np.int64)
    c3[cells] = counts
    c3 = c3.reshape(SHAPE)
    t3 = np.minimum(c3, 1)

    def predict(c, t, d, parent):
        total, tables = c.sum(-1, keepdims=True), t.sum(-1, keepdims=True)
        return (c - d * t + (STRENGTH + d * tables) * parent) / (STRENGTH + total)
    d0, d1, d2 = SPELL_DISCOUNT
    uniform = np.full(N_SYM, 1 / N_SYM)
    t2 = t1 = None
    for _ in range(sweeps + 1):
        c2 = t3.sum(0)
        t2 = np.minimum(c2, 1) if t2 is None else np.minimum(np.maximum(t2, np.minimum(c2, 1)), c2)
        c1 = t2.sum(0)
        t1 = np.minimum(c1, 1) if t1 is None else np.minimum(np.maximum(t1, np.minimum(c1, 1)), c1)
        p1 = predict(c1, t1, d0, uniform)
        p2 = predict(c2, t2, d1, p1)
        seeds = lambda n: rng.integers(0, 2 ** 63, n)
        for c, t, d, parent in ((c3, t3, d2, np.broadcast_to(p2, SHAPE)), (c2, t2, d1, np.broadcast_to(p1, c2.shape)),
                                (c1, t1, d0, uniform)):
            at = np.nonzero(c)
            rest = np.broadcast_to(t.sum(-1, keepdims=True), c.shape)[at] - t[at]
            t[at] = seat(c[at], parent[at], rest, d, STRENGTH, seeds(len(at[0])))
    c2, c1 = t3.sum(0), np.minimum(t2, t3.sum(0)).sum(0)
    t2 = np.minimum(np.maximum(t2, np.minimum(c2, 1)), c2)
    c1 = t2.sum(0)
    t1 = np.minimum(np.maximum(t1, np.minimum(c1, 1)), c1)
    p2 = predict(c2, t2, d1, predict(c1, t1, d0, uniform))
    return Spelling.of(predict(c3, t3, d2, p2), p2, c3.sum(-1) > 0)


@dataclass
class Sweep:
    """Totals after one sweep: tables and customers of the root, tables of each context, the spelling model
    seated from the root's tables, and the base probability of all known words together."""
    tables: float
    customers: float
    context_tables: np.ndarray
    spelling: Spelling
    known: float = 0.0


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at space, tab, line feed, vertical tab, form feed and return; then the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def sliced(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """The rows in runs that end once their texts have ``chars`` bytes."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            stop = min(len(ends), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars)) + 1)
            yield batch.slice(at, stop - at)
            at = stop


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` of many texts without their ends: all words in a row, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    full = pc.not_equal(pc.binary_length(flat), 0)  # nothing before the first and after the last space
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full).cast(pa.binary()), np.diff(kept[np.concatenate([[0], ends])])


def frequent_words(rows: DataFrame, share: float = FREQUENT, part: int = BLOCK_TOKENS) -> list[bytes]:
    """All words with at least ``share`` of the training tokens, and perhaps some with at least half of that:
    at most 2 / share words.  Parts are some ``part`` tokens of a task at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, min(2 * part, SLICE)):  # characters stand in for tokens; any cut into parts will do
            flat, _ = split_texts(batch["text"])
            found, total = pc.value_counts(flat), len(flat) + len(batch)
            some = found.filter(pc.greater_equal(found.field("counts"), total * share / 2))
            ends = [(END, len(batch))] if len(batch) >= total * share / 2 else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([b"", *(w for w, _ in ends), *some.field("values").to_pylist()], pa.binary()),
                 pa.array([total, *(n for _, n in ends), *some.field("counts").to_pylist()], pa.int64())], ["word", "n"])
    got = written(rows.where("not held_out").select("text").mapInArrow(run, "word binary, n long")
                  .groupBy("word").agg(F.sum("n").alias("n")), "frequent-words")
    total = got.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    named = got.where((F.length("word") > 0) & (F.col("n") >= total * share / 2)).collect()
    return sorted(bytes(r["word"]) for r in named)


BLOCK_SCHEMA = ("kind int, block long, doc_id long, held_out boolean, n_tokens long, ids binary, word binary, "
                "number int, trained long")


BLOCK_TYPES = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
                         ("n_tokens", pa.int64()), ("ids", pa.binary()), ("word", pa.binary()), ("number", pa.int32()),
                         ("trained", pa.int64())])


def packed_ids(ids: np.ndarray) -> bytes:
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec=PACK, asbytes=True)


def unpacked_ids(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * n, codec=PACK, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def _filled(types: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    """The columns given, nulls in the others; a plain value is that of all rows."""
    def one(f: pa.Field) -> pa.Array:
        x = columns.get(f.name)
        if x is None:
            return pa.nulls(rows, f.type)
        if isinstance(x, int):
            return pa.repeat(pa.scalar(x, f.type), rows)
        return (x if isinstance(x, pa.Array) else pa.array(x)).cast(f.type)
    return pa.RecordBatch.from_arrays([one(f) for f in types], schema=types)


def _one_block(docs: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray, words: pa.Array, n_frequent: int,
               block: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block; the word numbers of its documents end at ``ends``."""
    lengths, held = np.diff(ends, prepend=0), docs["held_out"].to_numpy(zero_copy_only=False).astype(bool)
    i = 0
    while i < len(ends):
        stop = min(len(ends), int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 500_000)) + 1)
        yield _filled(BLOCK_TYPES, stop - i, kind=0, block=block, doc_id=docs["doc_id"][i:stop], held_out=held[i:stop], n_tokens=lengths[i:stop],
                      ids=[packed_ids(ids[b - n:b]) for b, n in zip(ends[i:stop].tolist(), lengths[i:stop].tolist())])
        i = stop
    learn = np.repeat(~held, lengths)
    trained = np.bincount(ids[learn], minlength=len(words))
    for i in range(0, len(words), 50_000):
        some = words[i:i + 50_000]
        yield _filled(BLOCK_TYPES, len(some), kind=1, block=block, word=some, number=np.arange(i, i + len(some)), trained=trained[i:i + 50_000])
    learn &= ids < n_frequent
    learn[ends - 1] = False  # nothing follows the end
    after = np.flatnonzero(learn)
    keys, counts = np.unique(ids[after] * (1 << 32) + ids[after + 1], return_counts=True)
    for i in range(0, len(keys), 50_000):
        head, number = np.divmod(keys[i:i + 50_000], 1 << 32)
        yield _filled(BLOCK_TYPES, len(head), kind=2, block=block, word=words.take(pa.array(number)), number=head, trained=counts[i:i + 50_000])


def _blocks(batches: Iterator[pa.RecordBatch], frequent: list[bytes], max_tokens: int,
            max_words: int) -> Iterator[pa.RecordBatch]:
    """Documents as word numbers (kind 0), the word list of their block with its training tokens (1), and the
    training tokens that follow a frequent word (2, ``number``: of the frequent word).  Frequent words
    have the first numbers of every block.

    Slices are gathered to ``max_tokens`` tokens and their words numbered as they come; a block ends after the
    document that fills it, and what is left waits for more."""
    from pyspark import TaskContext
    block = TaskContext.get().partitionId() << 24
    first = pa.array(frequent if END in frequent else [*frequent, END], pa.binary())
    end = first.to_pylist().index(END)
    docs, flats, counts, tokens, size = [], [], [], 0, 0  # gathered: documents, words, words of each document

    def numbered() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(word numbers with the ends, place after each document's, words) of all that is gathered."""
        coded = pa.chunked_array([first, *flats]).dictionary_encode()
        ends = np.cumsum(np.concatenate(counts) + 1)
        ids, inside = np.full(ends[-1], end, np.int64), np.ones(ends[-1], bool)
        inside[ends - 1] = False
        ids[inside] = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks])[len(first):]
        return ids, ends, coded.chunk(coded.num_chunks - 1).dictionary

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal block, docs, flats, counts, tokens, size
        rows = pa.Table.from_batches(docs).combine_chunks().to_batches()[0]
        ids, ends, words = numbered()
        docs, flats, counts, tokens, size = [], [], [], 0, 0
        while len(ends):
            top = np.maximum.accumulate(ids)[ends - 1] + 1
            full = np.flatnonzero((ends >= max_tokens) | (top >= max_words + len(first)))
            if not len(full) and not last:
                inside = ids != end
                docs, flats, counts = [rows], [words.take(pa.array(ids[inside]))], [np.diff(ends, prepend=0) - 1]
                tokens, size = len(ids), flats[0].nbytes
                return
            at = int(full[0]) + 1 if len(full) else len(ends)
            done = int(ends[at - 1])
            yield from _one_block(rows.slice(0, at), ids[:done], ends[:at], words.slice(0, max(len(first), int(top[at - 1]))),
                                  len(frequent), block)
            block += 1
            rows, ends = rows.slice(at), ends[at:] - done
            if len(ends):  # numbered anew, the first words as ever
                codes, known = pd.factorize(np.concatenate([np.arange(len(first)), ids[done:]]))
                ids, words = codes[len(first):], words.take(pa.array(known))
    for batch in sliced(batches, min(SLICE, 8 * max_tokens)):
        flat, n = split_texts(batch["text"])
        docs.append(batch.select(["doc_id", "held_out"]))
        flats.append(flat)
        counts.append(n)
        tokens += len(flat) + len(batch)
        size += flat.nbytes
        if tokens >= max_tokens or size >= 16 * SLICE:
            yield from cut(size >= 16 * SLICE)
    if docs:
        yield from cut(True)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """Batches joined to about ``rows`` rows: the draws work on whole columns."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _joined(column: pa.ChunkedArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(the values that are packed in the rows of a binary column, their number in each row)."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    data = b"".join(memoryview(c.buffers()[2])[o[0]:o[-1]] for c in column.chunks if len(c) and c.buffers()[2] is not None
                    for o in [np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1].tolist()])
    return np.frombuffer(data, dtype), pc.binary_length(column).to_numpy() // dtype.itemsize


class WordModel:
    """The fitted model: counts, discounts, customers of each context (0: no restaurant) and the sweeps."""

    def __init__(self, tokens: int, distinct: int, discount: float, context_discount: float, contexts: np.ndarray,
                 frequent: list[bytes]):
        self.tokens, self.distinct, self.discount = tokens, distinct, discount
        self.context_discount, self.contexts = context_discount, contexts
        self.seeds = np.array([1 + zlib.crc32(w) for w in frequent] or [1], np.uint64)  # by word, not by number
        self.sweeps: list[Sweep] = []
        self.held = 0  # the sweep whose seating the words table carries

    def backoff(self) -> np.ndarray:
        """(contexts, kept sweeps): weight of the root's probability in each context."""
        d = self.context_discount
        return np.stack([(STRENGTH + d * s.context_tables) / (STRENGTH + self.contexts)
                         for s in self.sweeps[BURN_IN + 1:]], axis=1)


SEAT = np.dtype("<i8")
ROW_TYPES = {"word": pa.binary(), "trained": pa.int64(), "heads": pa.list_(pa.int32()), "counts": pa.list_(pa.int64()),
             "h": pa.int64(), "id": pa.int64(), "rest": pa.int64(), "more": pa.list_(pa.int64()), "tables": pa.int64(), "seats": pa.binary()}


class WordRows:
    """Some words with their training tokens and their cells (tokens after each frequent word).  ``rest``: tokens after
    other words; ``more``: the tables of those, by sweep."""

    def __init__(self, model: WordModel, batch: pa.Table | pd.DataFrame):
        if isinstance(batch, pd.DataFrame):
            batch = pa.table({c: pa.array(batch[c].tolist(), ROW_TYPES[c]) for c in batch.columns if c in ROW_TYPES})
        self.model, self.words = model, batch["word"].to_pylist()
        self.trained, self.hashes = batch["trained"].to_numpy(), batch["h"].to_numpy().view(np.uint64)
        cells = pc.fill_null(pc.list_value_length(batch["heads"]), 0).to_numpy()
        self.at = np.repeat(np.arange(len(self.words)), cells)
        self.head = pc.list_flatten(batch["heads"]).to_numpy().astype(np.int64)
        self.count = pc.list_flatten(batch["counts"]).to_numpy().astype(np.int64)
        own = model.contexts[self.head] > 0
        self.at, self.head, self.count = self.at[own], self.head[own], self.count[own]
        self.direct = self.trained - np.bincount(self.at, self.count, minlength=len(self.words)).astype(np.int64)
        self.more = np.zeros((len(self.words), 99), np.int64)
        if "rest" in batch.column_names:
            self.direct -= batch["rest"].to_numpy().astype(np.int64)
            if len(more := pc.list_flatten(batch["more"])):
                self.more = more.to_numpy().astype(np.int64).reshape(len(self.words), -1)
        self.cells = cells_of(self.words) if self.words else None
        self.held = None  # tables and cell tables after sweep ``model.held``, as an earlier pass has written them
        if "seats" in batch.column_names:
            self.held = batch["tables"].to_numpy(), _joined(batch["seats"], SEAT)[0].astype(np.int64)
        self.bases: dict[int, np.ndarray] = {}

    def _seeds(self, k: int, at=slice(None)) -> np.ndarray:
        return _mixed(self.hashes[at] + np.uint64(k * GOLD % 2 ** 64))

    def base(self, k: int) -> np.ndarray:
        if k not in self.bases:
            self.bases[k] = self.model.sweeps[k].spelling.words(self.words, self.cells)
        return self.bases[k]

    def root(self, k: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probability of each word in the root after sweep k; unseen words as the one outcome."""
        s, d = self.model.sweeps[k], self.model.discount
        base = np.where(self.trained > 0, self.base(k), max(1e-12, 1 - s.known))
        return (customers - d * tables + (STRENGTH + d * s.tables) * base) / (STRENGTH + s.customers)

    def states(self, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(sweep, root customers, root tables, cell tables) from the sweep that is written, or 0 (one table a dish),
        to ``last``."""
        n, m = len(self.words), self.model
        first = 0 if self.held is None else m.held
        cell = np.ones(len(self.at), np.int64) if self.held is None else self.held[1]
        customers = self.direct + self.more[:, first] + np.bincount(self.at, cell, minlength=n).astype(np.int64)
        tables = np.minimum(customers, 1) if self.held is None else self.held[0]
        yield first, customers, tables, cell
        for k in range(first + 1, last + 1):
            was = m.sweeps[k - 1]
            p = self.root(k - 1, customers, tables)
            cell = seat(self.count, p[self.at], np.maximum(0.0, was.context_tables[self.head] - 1), m.context_discount, STRENGTH,
                        self._seeds(k, self.at) + m.seeds[self.head])
            customers = self.direct + self.more[:, k] + np.bincount(self.at, cell, minlength=n).astype(np.int64)
            tables = seat(customers, self.base(k - 1), max(0.0, was.tables - 1), m.discount, STRENGTH, self._seeds(k))
            yield k, customers, tables, cell

    def packed(self, values: np.ndarray) -> pa.Array:
        """The values of each word's cells as bytes."""
        ends = np.searchsorted(self.at, np.arange(len(self.words) + 1)) * values.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(self.words), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])

    def prices(self) -> tuple[np.ndarray, np.ndarray]:
        """Predictive probabilities after the burn-in: (words, sweeps) in the root, and their mean in each cell."""
        m = self.model
        d, roots, cells = m.context_discount, [], np.zeros(len(self.at))
        for k, customers, tables, cell in self.states(len(m.sweeps) - 1):
            if k > BURN_IN:
                roots.append(self.root(k, customers, tables))
                total = m.sweeps[k].context_tables[self.head]
                cells += (self.count - d * cell + (STRENGTH + d * total) * roots[-1][self.at]) / (STRENGTH + m.contexts[self.head])
        return np.stack(roots, axis=1), cells / len(roots)


def _discount(one: int, two: int) -> float:
    return min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5


STATE = list(ROW_TYPES)
STATE_SCHEMA = ("kind int, word binary, trained long, heads array<int>, counts array<long>, h long, id long, rest long, more array<long>, "
                "tables long, seats binary, cell long, n double")


PAIR_TYPES = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("pair", pa.binary()),
                        ("cells", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()),
                        ("single", pa.int64()), ("many", pa.int64())])
PAIR_SCHEMA = ("kind int, bucket long, block long, size long, pair binary, cells binary, a long, b long, n long, "
               "single long, many long")


def packed_longs(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec=PACK, asbytes=True)


def unpacked_longs(column: pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    """The values of all rows."""
    got = [np.ascontiguousarray(np.frombuffer(pa.decompress(x, decompressed_size=8 * n, codec=PACK, asbytes=True), np.uint8)
                                .reshape(8, n).T).view("<i8").ravel() for x, n in zip(column.to_pylist(), sizes.tolist())]
    return np.concatenate(got) if got else np.zeros(0, np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values, and the length."""
    return np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _buckets(a: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def pairs_of(docs: pa.Table, words: pa.Table, n_frequent: int, buckets: int) -> pa.Table:
    """Of one block: the pairs of a word that is not frequent and the next one, as their numbers there (``pair``) and in all
    words (a, b), with their training tokens, perhaps none.  One packed row a bucket of a."""
    own = np.zeros(len(words), np.int64)
    own[words["number"].to_numpy()] = words["id"].to_numpy()
    n = docs["n_tokens"].to_numpy()
    ids = np.concatenate([unpacked_ids(x, k) for x, k in zip(docs["ids"].to_pylist(), n.tolist())]).astype(np.int64)
    followed = ids >= n_frequent
    followed[np.cumsum(n) - 1] = False  # nothing follows the end
    after = np.flatnonzero(followed)
    learn = np.repeat(~docs["held_out"].to_numpy().astype(bool), n)[after]
    keys = (ids[after] << 33) + (ids[after + 1] << 1) + learn
    del ids, followed, after, learn
    keys.sort()
    first = _runs(keys >> 1)[:-1]
    trained = np.add.reduceat(keys & 1, first) if len(first) else keys
    keys = keys[first] >> 1
    head, number = np.divmod(keys, 1 << 32)
    bucket = _buckets(own, buckets)[head]
    order = np.argsort(bucket, kind="stable")
    columns = [x[order] for x in (keys, own[head], own[number], trained)]
    runs = _runs(bucket[order])
    packed = [[packed_longs(x[i:j]) for i, j in zip(runs[:-1], runs[1:])] for x in columns]
    return pa.table({"block": pa.repeat(docs["block"][0], len(runs) - 1), "bucket": bucket[order][runs[:-1]], "size": np.diff(runs),
                     **{c: pa.array(x, pa.binary()) for c, x in zip(("pair", "a", "b", "trained"), packed)}})


def merged_pairs(rows: pa.Table) -> pa.Table:
    """A bucket's pairs of all blocks, added up: by block the pairs that training has once (kind 0) and more often, with the
    numbers of their cells (1); these cells, numbered in the order of a and b (2); by the first word its tokens, pairs that occur once and pairs (3), and so by
    the next word (4)."""
    sizes = rows["size"].to_numpy()
    pair, a, b, n = (unpacked_longs(rows[c], sizes) for c in ("pair", "a", "b", "trained"))
    block, bucket = np.repeat(rows["block"].to_numpy(), sizes), rows["bucket"][0].as_py()
    order = np.lexsort((b, a))
    pair, a, b, n, block = (x[order] for x in (pair, a, b, n, block))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    cell, first = np.cumsum(new) - 1, np.flatnonzero(new)
    a, b, n = a[first], b[first], np.add.reduceat(n, first)
    number, out = np.cumsum(n > 1) - 1, []
    for kind, some in enumerate((n == 1, n > 1)):
        at = np.flatnonzero(some[cell])
        at = at[np.argsort(block[at], kind="stable")]
        for i, j in zip((runs := _runs(block[at]))[:-1], runs[1:]):
            out.append(_filled(PAIR_TYPES, 1, kind=kind, bucket=bucket, block=int(block[at[i]]), size=int(j - i), pair=[packed_longs(pair[at[i:j]])],
                               cells=[packed_longs(number[cell[at[i:j]]])] if kind else None))
    many = n > 1
    out.append(_filled(PAIR_TYPES, int(many.sum()), kind=2, bucket=bucket, a=a[many], b=b[many], n=n[many]))
    known = n > 0
    for kind, c, x in ((3, "a", a[known]), (4, "b", b[known])):
        words, at = np.unique(x, return_inverse=True)
        sums = (np.bincount(at, w, len(words)).astype(np.int64) for w in (n[known], n[known] == 1, np.ones(len(x))))
        out.append(_filled(PAIR_TYPES, len(words), kind=kind, **{c: words}, **dict(zip(("n", "single", "many"), sums))))
    return pa.Table.from_batches([x.slice(i, 50_000) for x in out for i in range(0, len(x), 50_000)], PAIR_TYPES)  # small batches for Spark


class PairCells:
    """The cells of all words that are not frequent.  ``found``: what the buckets have (``merged_pairs``); ``drawn``: the
    cells of more than one token; ``heads``: restaurants (a, h, customers, single, seats: tables by sweep); ``nexts``: by the
    next word its tokens (``rest``), its pairs that occur once, and the tables of the last sweep (``more``)."""

    def __init__(self, texts: DataFrame, listed: DataFrame, words: DataFrame, n_frequent: int, bucket: int = BUCKET):
        self.buckets = buckets = 1 + (texts.agg(F.sum("n_tokens")).first()[0] or 0) // bucket
        pairs = texts.groupBy("block").cogroup(listed.groupBy("block")).applyInArrow(
            lambda d, w: pairs_of(d, w, n_frequent, buckets),
            "block long, bucket long, size long, pair binary, a binary, b binary, trained binary")
        self.found = by_kind(pairs.groupBy("bucket").applyInArrow(merged_pairs, PAIR_SCHEMA), "pair-cells", release=True)
        heads = self.found.where("kind = 3").select("a", F.col("n").alias("customers"), "single", F.array("many").alias("seats"))
        self.heads = written(heads.join(words.select(F.col("id").alias("a"), "h").hint("merge"), "a").select(
            "a", "h", "customers", "single", "seats"), "pair-heads", release=True)
        self.nexts = written(self.found.where("kind = 4").groupBy("b").agg(
            F.sum("n").alias("rest"), F.sum("single").alias("single"), F.sum("many").alias("more")), "pair-nexts", release=True)
        self.one = self.heads.agg(F.sum("single")).first()[0] or 0
        self.two = self.found.where("kind = 2 AND n = 2").count()
        # ``kept``: tables of all kept sweeps together
        self.drawn = self.found.where("kind = 2").select("a", "b", "n", F.lit(0).cast("long").alias("kept"))

    def sweep(self, k: int, prices: DataFrame, discount: float) -> None:
        """``prices``: (b, hash, p), the root's probabilities after the sweep before."""
        buckets = self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in gathered(batches):
                a, b, n, h, hash_, last, kept = (batch[c].to_numpy() for c in ("a", "b", "n", "h", "hash", "last", "kept"))
                seeds = _mixed(hash_.view(np.uint64) + np.uint64(k * GOLD % 2 ** 64)) + h.view(np.uint64)
                tables = seat(n, batch["p"].to_numpy(), np.maximum(0.0, last - 1.0), discount, STRENGTH, seeds)
                yield pa.RecordBatch.from_pydict({"bucket": _buckets(a, buckets), "a": a, "b": b, "n": n,
                                                  "kept": kept + tables * (k > BURN_IN), "tables": tables})
        asked = (self.drawn.select("a", "b", "n", "kept").join(prices.hint("merge"), "b")
                 .join(self.heads.select("a", "h", F.element_at("seats", -1).alias("last")).hint("merge"), "a"))
        old = [self.heads, self.nexts, *([self.drawn] if k > 1 else [])]
        self.drawn = written(asked.mapInArrow(run, "bucket long, a long, b long, n long, kept long, tables long"), f"pair-seats-{k}", release=True)
        sums = lambda c: self.drawn.groupBy(c).agg(F.sum("tables").alias("_t")).hint("merge")
        now = F.col("single") + F.coalesce("_t", F.lit(0))
        self.heads = written(self.heads.join(sums("a"), "a", "left").select(
            "a", "h", "customers", "single", F.concat("seats", F.array(now)).alias("seats")), f"pair-heads-{k}", release=True)
        self.nexts = written(self.nexts.join(sums("b"), "b", "left").select(
            "b", "rest", "single", now.alias("more")), f"pair-nexts-{k}", release=True)
        for table in old:
            drop_written(table)

    def values(self, discount: float, sweeps: int) -> DataFrame:
        """(block, size, pair, e): of each block's pairs that training knows, packed, the customers less the discount of their
        tables as 4-byte numbers; null for pairs that occur once."""
        def run(rows: pa.Table, cells: pa.Table) -> pa.Table:
            order = np.lexsort((cells["b"].to_numpy(), cells["a"].to_numpy()))
            e = (cells["n"].to_numpy() - discount * cells["kept"].to_numpy() / (sweeps - BURN_IN))[order].astype("<f4")
            own = [e[unpacked_longs(rows["cells"][i:i + 1], rows["size"][i:i + 1].to_numpy())].tobytes() for i in range(len(rows))]
            return pa.table({"block": rows["block"], "size": rows["size"], "pair": rows["pair"], "e": pa.array(own, pa.binary())})
        many = (self.found.where("kind = 1").groupBy("bucket").cogroup(self.drawn.groupBy("bucket"))
                .applyInArrow(run, "block long, size long, pair binary, e binary"))
        return many.unionByName(self.found.where("kind = 0").select("block", "size", "pair", F.lit(None).cast("binary").alias("e")))


def fit(words: DataFrame, frequent: list[bytes], share: float = FREQUENT, sweeps: int = SWEEPS) -> WordModel:
    return fit_seated(words, frequent, share, sweeps)[0]


def fit_seated(words: DataFrame, frequent: list[bytes], share: float = FREQUENT, sweeps: int = SWEEPS,
               others: PairCells | None = None) -> tuple[WordModel, DataFrame]:
    """Gibbs sampling over (word, trained, heads, counts) rows: each sweep is one pass and one small aggregate.
    A pass seats the words given the sweeps before and sums up the last one's base; the last pass only sums.
    Up to the first kept sweep a pass also writes the words with their seating (kind 0) beside its sums (kind 1),
    and later ones go on from there.  Before a pass the pairs of ``others``, if any, are seated.
    Returns the model and all words with the last seating written."""
    spark = words.sparkSession
    known = words.where("trained > 0")
    s = known.agg(F.sum("trained"), F.count(F.lit(1)), F.count(F.when(F.col("trained") == 1, 1)),
                  F.count(F.when(F.col("trained") == 2, 1))).first()
    tokens = int(s[0] or 0)
    h = F.col("h") if "h" in words.columns else F.xxhash64("word").alias("h")
    enough = {bytes(r["word"]): r["h"] for r in known.where(F.col("word").isin([bytearray(w) for w in frequent])
                                                            & (F.col("trained") >= tokens * share)).select("word", h).collect()} if frequent else {}
    per = (known.where(F.col("heads").isNotNull()).select(F.explode(F.arrays_zip("heads", "counts")).alias("c"))
           .groupBy("c.heads").agg(F.sum("c.counts").alias("n"), F.count(F.when(F.col("c.counts") == 1, 1)).alias("one"),
                                   F.count(F.when(F.col("c.counts") == 2, 1)).alias("two")).collect())
    contexts = np.zeros(max(1, len(frequent)))
    own = [r for r in per if frequent[r["heads"]] in enough]
    for r in own:
        contexts[r["heads"]] = r["n"]
    model = WordModel(tokens, int(s[1]), _discount(s[2], s[3]),
                      _discount(sum(r["one"] for r in own) + (others.one if others else 0),
                                sum(r["two"] for r in own) + (others.two if others else 0)), contexts, frequent)
    nothing = F.lit(0).cast("long")
    plain = ["word", "trained", "heads", "counts", h, "id" if "id" in words.columns else nothing.alias("id"), nothing.alias("rest"),
             (F.array_repeat(nothing, sweeps + 1) if others else F.lit(None).cast("array<long>")).alias("more")]
    seated, carry = known.select(*plain), min(BURN_IN + 1, sweeps)
    if others:
        if enough:
            model.seeds = np.array([enough.get(w, 0) for w in frequent], np.int64).view(np.uint64)
        seated = seated.drop("rest", "more").join(others.nexts.select(F.col("b").alias("id"), "rest", "more").hint("merge"), "id", "left").select(
            *STATE[:6], F.coalesce("rest", nothing).alias("rest"), F.array(F.coalesce("more", nothing)).alias("more"))
        seated = written(seated, "seated-0", release=True)
    types = pa.schema([("kind", pa.int32()), *ROW_TYPES.items(), ("cell", pa.int64()), ("n", pa.float64())])
    for k in range(sweeps + 2):
        held, write, before = spark.sparkContext.broadcast(model), 0 < k <= carry, seated
        if others and 0 < k <= sweeps:
            def root(batches: Iterator[pa.RecordBatch], k: int = k, held=held) -> Iterator[pa.RecordBatch]:
                for batch in gathered(batches, 50_000):
                    rows = WordRows(held.value, batch)
                    *_, (_, customers, tables, _) = rows.states(k - 1)
                    yield pa.RecordBatch.from_pydict({"b": pa.concat_arrays(batch["id"].chunks), "hash": rows.hashes.view(np.int64),
                                                          "p": rows.root(k - 1, customers, tables)})
            others.sweep(k, seated.mapInArrow(root, "b long, hash long, p double"), model.context_discount)
            seated = seated.join(others.nexts.select(F.col("b").alias("id"), F.col("more").alias("_now")).hint("merge"), "id", "left")
            seated = seated.select(*[F.concat("more", F.array(F.coalesce("_now", nothing))).alias(c) if c == "more" else c
                                     for c in before.columns])
            if not write:
                seated = written(seated, f"seated-{k}", release=True)
                drop_written(before)

        def run(batches: Iterator[pa.RecordBatch], k: int = k, held=held, write=write) -> Iterator[pa.RecordBatch]:
            model = held.value
            cells, extra = np.zeros(140 * 140 * N_SYM), np.zeros(3)  # tables, base of the sweep before, customers
            context = np.zeros(len(model.contexts))
            for batch in gathered(batches, 50_000):
                rows = WordRows(model, batch)
                if k:
                    extra[1] += float(rows.base(k - 1).sum())
                if k > sweeps or not rows.words:
                    continue
                *_, (_, customers, tables, cell) = rows.states(k)
                if write:
                    yield _filled(types, len(batch), kind=0, tables=tables, seats=rows.packed(cell.astype(SEAT)), cell=-1, n=0,
                                  **{c: pa.concat_arrays(batch[c].chunks) for c in STATE[:8]})
                extra += (tables.sum(), 0, customers.sum())
                context += np.bincount(rows.head, cell, minlength=len(context))
                at, _, start = rows.cells
                t = np.where([w == END for w in rows.words], 0, tables)
                cells += np.bincount(at, np.repeat(t, np.diff(np.append(start, len(at)))), minlength=len(cells))
            at = np.flatnonzero(cells)
            cell, n = np.concatenate([at, [-1, -2, -3], -10 - np.arange(len(context))]), np.concatenate([cells[at], extra, context])
            for i in range(0, len(cell), 50_000):
                some = {"cell": cell[i:i + 50_000], "n": n[i:i + 50_000]}
                yield _filled(types, len(some["n"]), kind=1, **some) if write else pa.RecordBatch.from_pydict(some)
        if write:
            passed = by_kind(seated.mapInArrow(run, STATE_SCHEMA), f"seated-{k}", release=others is not None)
            if model.held or others:
                drop_written(before)
            seated, sums = passed.where("kind = 0").select(*STATE), passed.where("kind = 1")
            model.held = k
        else:
            sums = seated.mapInArrow(run, "cell long, n double")
        got = sums.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most a row for each cell of SHAPE and each context
        held.destroy()
        value = dict(zip(got["cell"], got["n"]))
        if k:
            model.sweeps[k - 1].known = min(1.0, value.get(-2, 0.0))
        if k <= sweeps:
            got = got[got["cell"] >= 0].sort_values("cell")
            model.sweeps.append(Sweep(value.get(-1, 0.0), value.get(-3, 0.0),
                                      np.array([value.get(-10 - i, 0.0) for i in range(len(contexts))]),
                                      fit_spelling(got["cell"].to_numpy(), got["n"].to_numpy(np.int64), 1000 + k)))
    none = words.where("trained = 0").select(*plain)
    if model.held:
        none = none.select("*", nothing.alias("tables"), F.lit(None).cast("binary").alias("seats"))
    return model, seated.unionByName(none)


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
CELL = np.dtype([("head", "<i2"), ("p", "<f4")])  # price of a word after a frequent word


def _score(docs: pa.Table, words: pa.Table, floor: float, backoff: np.ndarray, contexts: np.ndarray, discount: float) -> pa.Table:
    """Documents of one block; words: number, trained, a root probability of each sweep, cells, and of a word that has a
    restaurant but is not frequent the customers and the backoff of each sweep; also the block's known pairs (``values``)."""
    values, words = words.filter(pc.is_valid(words["pair"])), words.filter(pc.is_null(words["pair"]))
    number = words["number"].to_numpy().astype(np.int64)
    trained = np.zeros(len(number), np.int64)
    trained[number] = words["trained"].to_numpy()
    base, known = np.log10(trained + 1) - floor, trained > 0
    roots = np.zeros((len(number), backoff.shape[1]))
    roots[number] = np.stack([words[c].to_numpy() for c in words.column_names if c.startswith("root")], axis=1)
    plain = np.log10(roots.mean(axis=1))
    cells, n_cells = _joined(words["cells"], CELL)
    customers, backs = np.zeros(len(number)), np.zeros(roots.shape)
    customers[number] = pc.fill_null(words["customers"], 0).to_numpy()
    backs[number] = np.stack([pc.fill_null(words[c], 0.0).to_numpy() for c in words.column_names if c.startswith("back")], axis=1)
    customers[:len(contexts)], backs[:len(contexts)] = contexts, backoff[:len(contexts)]
    sizes = values["size"].to_numpy()
    pair = unpacked_longs(values["pair"], sizes)
    e = np.concatenate([np.zeros(0), *(np.full(n, 1 - discount) if x is None else np.frombuffer(x, "<f4").astype(float)
                                       for x, n in zip(values["e"].to_pylist(), sizes.tolist()))])
    head, word = np.divmod(pair, 1 << 32)
    own = e / (STRENGTH + customers[head]) + (backs[head] * roots[word]).mean(axis=1)
    key = np.concatenate([cells["head"].astype(np.int64) * (1 << 32) + np.repeat(number, n_cells), pair])
    order = np.argsort(key)
    key, price = np.append(key[order], -1), np.append(np.log10(np.concatenate([cells["p"].astype(float), own])[order]), 0.0)
    ids, n_tokens = docs["ids"], docs["n_tokens"].to_numpy()
    ends, out, at = np.cumsum(n_tokens), [], 0
    while at < len(docs):  # some documents at once
        stop = min(len(docs), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000)) + 1)
        some = np.concatenate([unpacked_ids(x, n) for x, n in zip(ids[at:stop].to_pylist(), n_tokens[at:stop].tolist())]).astype(np.int64)
        start = ends[at:stop] - n_tokens[at:stop] - (ends[at - 1] if at else 0)
        score, follows = plain[some], np.append(customers[some[:-1]] > 0, False)
        follows[start[1:] - 1] = False  # nothing follows the end
        after = np.flatnonzero(follows)
        head, word = some[after], some[after + 1]
        asked = head * (1 << 32) + word
        asked, back = np.unique(asked, return_inverse=True)
        place = np.searchsorted(key[:-1], asked)
        known_cell, (head, word) = key[place] == asked, np.divmod(asked, 1 << 32)
        new = ~known_cell
        cell = price[place]
        cell[new] = np.log10((backs[head[new]] * roots[word[new]]).mean(axis=1))
        score[after + 1] = cell[back]
        out.append([np.add.reduceat(x, start) for x in (known[some].astype(np.int64), base[some], score)])
        at = stop
    n_known, base_score, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "n_known": n_known,
                     "base_score": base_score, "score": score})


def by_kind(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``written`` with a folder a kind; a task keeps a file of each open, so that rows need no sort before the write."""
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    try:
        conf.set(key, "5")
        return written(df, name, "kind", release)
    finally:
        conf.set(key, before)


def word_rows(table: DataFrame) -> DataFrame:
    """(word, trained, heads, counts): one row a distinct word of the blocks; its cells are at most as many as
    there are frequent words."""
    words = table.where("kind = 1").groupBy("word").agg(F.sum("trained").alias("trained"))
    cells = (table.where("kind = 2").groupBy("word", "number").agg(F.sum("trained").alias("n"))
             .groupBy(F.col("word").alias("of")).agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("c")))
    return words.join(cells, F.col("word") == F.col("of"), "left").select(
        "word", "trained", F.col("c.number").alias("heads"), F.col("c.n").alias("counts"))


def score_documents(docs: DataFrame, held_out: Column, max_tokens: int = BLOCK_TOKENS, max_words: int = BLOCK_WORDS,
                    share: float = 0.0) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).
    ``share``: of the training tokens, from which a word has a restaurant of its own; 0: every word has one."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       "text")
    frequent = frequent_words(rows, share or FREQUENT)
    table = by_kind(rows.mapInArrow(lambda it: _blocks(it, frequent, max_tokens, max_words), BLOCK_SCHEMA), "word-blocks")
    words = written(word_rows(table).withColumns({"h": F.xxhash64("word"), "id": F.monotonically_increasing_id()}), "words", release=True)
    listed = written(table.where("kind = 1").select("block", "number", "word").join(words.select("word", "id").hint("merge"), "word")
                     .select("block", "number", "id"), "block-words", release=True)
    drop_written(table, "/kind=1/")  # the words hold these and the cells now
    drop_written(table, "/kind=2/")
    texts = table.where("kind = 0").select("block", "doc_id", "held_out", "n_tokens", "ids")
    others = None if share else PairCells(texts, listed, words, len(frequent))
    model, seated = fit_seated(words, frequent, share, others=others)
    held = spark.sparkContext.broadcast(model)
    samples = [f"root{k}" for k in range(BURN_IN + 1, len(model.sweeps))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            rows = WordRows(held.value, batch)
            roots, cells = rows.prices()
            packed = np.empty(len(cells), CELL)
            packed["head"], packed["p"] = rows.head, cells
            yield pa.RecordBatch.from_pydict({
                "id": pa.concat_arrays(batch["id"].chunks), "known": rows.trained,
                **{name: roots[:, i].astype("<f4") for i, name in enumerate(samples)}, "cells": rows.packed(packed)})
    priced = seated.mapInArrow(run, f"id long, known long, {', '.join(f'{c} float' for c in samples)}, cells binary")
    discount, backs = model.context_discount, [f"back{k}" for k in range(BURN_IN + 1, len(model.sweeps))]
    if others:
        weight = lambda k: (STRENGTH + discount * F.col("seats")[k]) / (STRENGTH + F.col("customers"))
        priced = priced.join(others.heads.select(F.col("a").alias("id"), "customers", *[
            weight(k).alias(c) for k, c in enumerate(backs, BURN_IN + 1)]).hint("merge"), "id", "left")
    else:
        priced = priced.select("*", F.lit(None).cast("long").alias("customers"), *[F.lit(None).cast("double").alias(c) for c in backs])
    prices = listed.join(priced.hint("merge"), "id").select(
        F.col("block").alias("of_block"), "number", F.col("known").alias("trained"), *samples, "cells", "customers", *backs)
    if others:
        prices = prices.unionByName(others.values(discount, len(model.sweeps) - 1).select(F.col("block").alias("of_block"), "size", "pair", "e"),
                                    allowMissingColumns=True)
    else:
        prices = prices.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("pair", "binary"), ("e", "binary"))])
    floor, backoff, contexts = math.log10(model.tokens + model.distinct + 1), model.backoff(), model.contexts[:len(frequent)]
    return (texts.groupBy("block").cogroup(prices.groupBy("of_block"))
            .applyInArrow(lambda d, w: _score(d, w, floor, backoff, contexts, discount), SCORE_SCHEMA)
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                    "base_score", "score"))


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token by held_out, for the model and for the add-one base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))


@query("op9_lm_scores")
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), crc_mod("doc_id", 7) == 2)
