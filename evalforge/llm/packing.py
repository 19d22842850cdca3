"""Operator 8: packing documents into training sequences by order-preserving dynamic programming.

Documents are tokenised whole (public word BPE, then the end id 2) and laid
end to end in the order of their rows.  Sequences are consecutive windows of
that stream, so order is kept and each id lies in exactly one piece.  Cuts may
fall at document ends (free), sentence ends (``SENTENCE``), or, inside a
stretch without either, every ``STRETCH`` ids (``WORD``).  With f(k) the least
cost of the stream up to cut k,

    f(k) = min over cuts i with at most 4096 ids between  f(i) + padding + penalty(k)

and padding = 4096 - (b_k - b_i), so the minimum of f(i) + b_i over a sliding
window: a monotone queue, amortised constant time a cut.  A window of exactly
a power of two pads nothing; that is used for the last ids of a partition,
which are split by their binary digits.

Tasks pack the rows of their own partition as a stream: at every ``BLOCK`` ids
the best cut near the end is committed and the ids after it are carried on, so
memory is bounded by BLOCK ids and the longest document.

Defined cases: null text is empty; an empty text is the end id alone; null
doc_ids are carried through; repeated rows are packed each; an empty table
gives an empty result.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import documents, query

LIMIT, END = 4096, 2
SENTENCE, WORD, STRETCH = 4, 16, 64
BLOCK = 1 << 18
KNOWN = 600_000  # words a Python worker remembers from batch to batch and from task to task
CHARS = 2_000_000  # characters tokenised at once

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")

#: White space that the tokenizer drops between words (Unicode White_Space), where it differs from ``str.split``.
_SPLIT = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+").split
_ODD = re.compile("[\\x1c-\\x1f]").search
#: ASCII marks that end a word; apostrophes are left out, the tokenizer joins them to letters.
_MARKS = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~\""
_CLOSING = "\"')]”’»*#&%$"
_STOPS = (".", "!", "?", "…", "。")
#: The tokenizer's letters for bytes that are not printable: the n-th of them is chr(256 + n).
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def default_tokenizer() -> str:
    """Path of the public word BPE; pass another path where it lies elsewhere."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer(dict):
    """Ids of whole texts by way of their words; the dict numbers the words seen.

    Tokens never span white space, and never span letters and the marks after
    them, so a word's ids can be remembered, and "word" and "word.&&" share
    those of "word".  The ids of all numbered words stand in one flat array; a
    batch of texts is one lookup per word and one gather."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self._forget()

    def _forget(self) -> None:
        """Start anew with the end id as word number 0."""
        self.clear()
        self.marks: dict[str, tuple[array, bool]] = {}
        self.flat, self.start, self.count, self.stop = array("I", [END]), array("q", [0]), array("q", [1]), array("b", [0])
        self.seen = np.zeros(1, np.int64)
        self[""] = 0

    def _thin(self) -> None:
        """Forget the words seen once; if too many are left, all."""
        words, seen = list(self), self.seen
        keep = np.flatnonzero(seen >= 2)
        if len(keep) > KNOWN // 2:
            return self._forget()
        flat, start, count, stop = self.flat, self.start, self.count, self.stop
        self._forget()
        for i in keep.tolist():
            if i:
                self._add(words[i], flat[start[i]:start[i] + count[i]], stop[i])
        self.seen = np.ones(len(self), np.int64)

    def _add(self, word: str, ids, stop) -> int:
        n = self[word] = len(self.start)
        self.start.append(len(self.flat))
        self.count.append(len(ids))
        self.stop.append(stop)
        self.flat.extend(ids)
        return n

    def encode(self, x: str) -> list[int]:
        return self.tok.encode(x, add_special_tokens=False).ids

    def _letters(self, x: str) -> list[int]:
        if x.islower() and (x.isascii() or _is_latin(x)):  # one pre-token, already in normal form
            return [t.id for t in self.model.tokenize(
                x if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_LETTERS))]
        return self.encode(x)

    def __missing__(self, word: str) -> int:
        core = word.rstrip(_MARKS)
        if not (core.isalpha() and (core.isascii() or core.lower().isalpha())):
            return self._add(word, self.encode(word), word.rstrip(_CLOSING).endswith(_STOPS))
        if len(core) == len(word):
            return self._add(word, self._letters(core), False)
        marks = word[len(core):]
        after = self.marks.get(marks)
        if after is None:
            after = self.marks[marks] = array("I", self.encode(marks)), marks.rstrip(_CLOSING).endswith(_STOPS)
        n = self[core]
        at = self.start[n]
        return self._add(word, self.flat[at:at + self.count[n]] + after[0], after[1])

    @staticmethod
    def words(text: str | None) -> list[str]:
        text = text or ""
        if "<|" not in text and _is_latin(text):  # no special token can be meant or made; one lower case a letter
            text = text.lower()
        return [w for w in _SPLIT(text) if w] if _ODD(text) else text.split()

    def _numbers(self, words: list[list[str]], total: int) -> np.ndarray:
        """Number of each word; new words are learnt.  Nothing here makes cycles, and passes of the garbage
        collector over as many new objects as there are new words would cost more than the words."""
        gc.disable()
        try:
            return np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, total)
        finally:
            gc.enable()

    def batch(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids with the end id, positions after sentence ends) of each text."""
        if len(self) > KNOWN or len(self.marks) > KNOWN // 10:
            self._thin()
        words = [[*self.words(t), ""] for t in texts]
        sizes = np.cumsum([len(w) for w in words])
        w = self._numbers(words, int(sizes[-1]) if len(sizes) else 0)
        seen = np.bincount(w, minlength=len(self.start))
        seen[:len(self.seen)] += self.seen
        self.seen = seen
        count = np.array(self.count)[w]
        past = np.cumsum(count)
        place = np.repeat(np.array(self.start)[w] - (past - count), count) + np.arange(int(past[-1]) if len(past) else 0)
        ids = np.array(self.flat, "<u4")[place]
        stop = np.flatnonzero(np.array(self.stop, bool)[w])
        first = 0
        for i, n in enumerate(sizes):
            lo, hi = (int(past[first - 1]) if first else 0), int(past[n - 1])
            a, b = np.searchsorted(stop, (first, n))
            yield ids[lo:hi], past[stop[a:b]] - lo
            first = int(n)

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return next(self.batch([text]))


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, with the words that its earlier tasks have met."""
    return WordTokenizer(path)


def cuts(lengths: list[int], sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from 0, ascending) and penalties of all admissible cuts of consecutive documents."""
    ends = np.cumsum(lengths)
    inner = [base + e[e < n - 1] for base, n, e in zip(ends - lengths, lengths, sentences)]
    pos = np.concatenate([[0], ends, *inner]).astype(np.int64)
    pen = np.full(len(pos), SENTENCE)
    pen[:1 + len(ends)] = 0
    order = np.argsort(pos, kind="stable")
    pos, pen = pos[order], pen[order]
    first = np.concatenate([[True], pos[1:] > pos[:-1]])  # a document's end goes before a sentence's
    pos, pen = pos[first], pen[first]
    more = (np.diff(pos) - 1) // STRETCH  # word cuts in each gap
    at = np.repeat(pos[:-1], more) + STRETCH * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    pos, pen = np.concatenate([pos, at]), np.concatenate([pen, np.full(len(at), WORD)])
    order = np.argsort(pos, kind="stable")
    return pos[order], pen[order]


def best_windows(pos: list[int], pen: list[int], limit: int = LIMIT, to_end: bool = True) -> list[int]:
    """Indices of the chosen cuts, the first included.  ``to_end`` False: the last chosen cut is the
    cheapest one less than ``limit`` before the end, and the ids after it are left for later."""
    n = len(pos)
    cost, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for k in range(1, n):
        at = pos[k]
        while at - pos[queue[0]] > limit:
            queue.popleft()
        i = queue[0]
        cost[k] = c = cost[i] + limit - (at - pos[i]) + pen[k]
        back[k] = i
        c += at
        while queue and cost[queue[-1]] + pos[queue[-1]] >= c:
            queue.pop()
        queue.append(k)
    k = n - 1
    if not to_end:
        near = [i for i in range(n) if pos[-1] - pos[i] < limit]
        k = min(near, key=lambda i: (cost[i], -i))
    out = [k]
    while k:
        k = back[k]
        out.append(k)
    return out[::-1]


def _tail(lo: int, hi: int) -> list[tuple[int, int]]:
    """The ids of [lo, hi) as windows of powers of two, the largest first."""
    out = []
    while lo < hi:
        size = min(LIMIT, 1 << ((hi - lo).bit_length() - 1))
        out.append((lo, lo + size))
        lo += size
    return out


class Packer:
    """Stream of documents in, pieces out."""

    def __init__(self, first_sequence: int):
        self.docs: list[list] = []  # doc_id, ids, sentence ends, ids already packed
        self.size, self.next = 0, first_sequence

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> list[tuple]:
        self.docs.append([doc_id, ids, ends, 0])
        self.size += len(ids)
        return self._pack(False) if self.size >= BLOCK else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.docs else []

    def _pack(self, last: bool) -> list[tuple]:
        left = [len(d[1]) - d[3] for d in self.docs]
        pos, pen = cuts(left, [d[2][d[2] > d[3]] - d[3] for d in self.docs])
        pos_, pen_ = pos.tolist(), pen.tolist()
        chosen = best_windows(pos_, pen_, to_end=False)
        windows = [(pos_[a], pos_[b]) for a, b in zip(chosen, chosen[1:])]
        done = pos_[chosen[-1]]
        if last:
            windows += _tail(done, pos_[-1])
            done = pos_[-1]
        out, d, base = [], 0, 0  # base: place of document d's first unpacked id
        for lo, hi in windows:
            at = lo
            while at < hi:
                while base + left[d] <= at:
                    base += left[d]
                    d += 1
                doc_id, ids, _, used = self.docs[d]
                end = min(hi, base + left[d])
                a, b = used + at - base, used + end - base
                out.append((doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids), self.next, at - lo, hi - lo))
                at = end
            self.next += 1
        while d < len(self.docs) and base + left[d] <= done:
            base += left[d]
            d += 1
        self.docs = self.docs[d:]
        if self.docs:
            self.docs[0][3] += done - base
        self.size = sum(len(x[1]) - x[3] for x in self.docs)
        return out


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece; sequences are numbered within each partition of ``docs``, in row order."""
    path = tokenizer or default_tokenizer()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        packer, tok = Packer(TaskContext.get().partitionId() << 40), tokenizer_of(path)

        def frame(rows):
            return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
        for batch in batches:
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"].array]
            texts = [None if pd.isna(t) else t for t in batch["text"].array]
            ends = np.cumsum([len(t or "") for t in texts]) // CHARS
            out = []
            for part in np.unique(ends):
                some = np.flatnonzero(ends == part)
                for i, (own, stops) in zip(some, tok.batch([texts[i] for i in some])):
                    out += packer.add(ids[i], own, stops)
            if out:
                yield frame(out)
        if rest := packer.finish():
            yield frame(rest)
    # nullable ids reach pandas as text, not as doubles, which would round large ones
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, SCHEMA)


@query("op8_pack_sequences")
def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
