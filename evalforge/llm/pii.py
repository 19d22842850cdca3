"""Operator 3: personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans of whole texts: digit
runs, words around an @, addresses spelled out ("name at host dot com"), long
key-like tokens in quotes or after "=".  The strict formats of the contract
(email, ip, card, phone) are a subset that always stays.  Boosted trees
(logistic loss, depth 3, histogram splits, trained here in numpy) score the
other candidates by format features (digits, groups, separators, Luhn, entropy)
and context features (words before, neighbouring characters); a span is added
when its score reaches the threshold of its kind.  Of added spans that overlap
each other or a base span, base spans win, then the higher score.

Labels come from two sides.  In every whole text, candidates that coincide with a base span are
positive; those that have the shape of one but fail its check, short numbers and every 60th word (never a
candidate itself) are negative.  And each kind has positives and negatives of its own, which every
text gets written between words of its own (``worded``): addresses spelled out against plain words around "at" and
"dot", random keys after words such as token or secret against long words in quotes, numbers of local phones and
social security after their words against dates, prices, versions and page numbers: one a text, or, in a corpus of
fewer than ``WORDED`` texts, as many of each as make up that number.  Thresholds are calibrated for each kind on the
half of the texts (by hash) that the trees don't see: the lowest score from which on precision is at least
``PRECISION``, never under ``FLOOR``.

All texts take part.  Spark groups the spans of the corpus by their features (half-precision numbers, so that
values are bounded) with their counts; bin edges are quantiles of these counts; each level of a tree is one pass
that sums the gradients of all spans by node, feature and bin, and only these sums (at most 4 x 33 x 17 cells) reach
the driver.  Gradients are multiples of 2 ** -20, so sums are exact in any order.  Scores of the trees so far
are written with the spans every ``CARRY`` trees.

Scans are linear in the text: each generator starts from a rare character and
looks only at the run of characters that could belong to its match.

Defined cases: null or empty text has no spans (hash of the empty text); an
empty corpus gives no trees, then base spans only; repeated rows come back each.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, written
from .registry import documents, query

WORDED = 3000  # labelled spans written for the kinds, at least
GRID = 1 << 14  # score steps of the calibration
CARRY = 10
PRECISION, FLOOR = 0.98, 0.9
BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "handle", "spelled", "key")

# Fixed formats of the contract, written so that no scan restarts inside a run.
_AT_RUN = re.compile(r"[A-Za-z0-9._%+@-]*@[A-Za-z0-9._%+@-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT_RUN = re.compile(r"\+?[0-9][0-9\x20().-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
# Wider shapes of the method.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"[(]?[0-9](?:[\x20().-]{0,2}[0-9])*")
_SPELLED = re.compile(r"(?<![\w.+-])([A-Za-z0-9._+-]{1,64})[\x20]?(?:\(at\)|\[at\]|\x20at\x20)[\x20]?"
                      r"([A-Za-z0-9-]{1,63})[\x20]?(?:\(dot\)|\[dot\]|\x20dot\x20)[\x20]?([A-Za-z]{2,24})(?!\w)", re.IGNORECASE)
_DOT = re.compile(r"[\x20(\[][Dd][Oo][Tt][\x20)\]]")
_TLD = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "it", "nl", "eu")
_KEY = re.compile(r"(?<=[\"'=:])[A-Za-z0-9_/+-]{20,}(?=[\"'\s]|$)")
_CUES = (("phone", "call", "tel", "mobile", "fax"), ("mail", "contact", "write", "address"), ("card", "visa", "credit"),
         ("ip", "host", "server", "addr"), ("token", "key", "secret", "password", "api"),
         ("ssn", "passport", "iban", "account", "id"), ("page", "chapter", "vol", "version", "section", "year", "no"))


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(valid spans by kind then start, spans of that shape that failed their check)."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    failed: list[tuple[int, int]] = []
    at = text.find("@")
    while at >= 0:
        # the run of address characters around this @
        lo = at
        while lo and (text[lo - 1] in _LOCAL):
            lo -= 1
        m = _AT_RUN.match(text, lo)
        run, s = m.group(), 0
        while (a := run.find("@", s)) >= 0:
            d = _DOMAIN.match(run, a + 1) if a > s else None
            if d:
                found["email"].append((lo + s, lo + d.end()))
                s = d.end()
            else:
                s = a + 1
        at = text.find("@", m.end())
    for r in _DIGIT_RUN.finditer(text):
        run, o = r.group(), r.start()
        if len(run) < 7:
            continue
        if run.count(".") >= 3:
            for m in _IP.finditer(run):
                ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
                (found["ip"] if ok else failed).append((o + m.start(), o + m.end()))
        if len(run) >= 16:
            for m in _CARD.finditer(run):
                d = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(d) <= 19 and luhn(d):
                    found["card"].append((o + m.start(), o + m.end()))
                elif len(d) >= 8:
                    failed.append((o + m.start(), o + m.end()))
        if run[0] == "+" and (m := _PHONE.match(run)):
            ok = 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15
            (found["phone"] if ok else failed).append((o + m.start(), o + m.end()))
    return [(k, s, e) for k in BASE for s, e in found[k]], failed


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Wider spans, overlapping each other and the base spans freely."""
    out = []
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo and text[lo - 1] in _LOCAL:
            lo -= 1
        hi = at + 1
        while hi < len(text) and text[hi] in _LOCAL:
            hi += 1
        if lo < at and hi > at + 1:
            out.append(("handle", lo, hi))
        at = text.find("@", hi)
    for r in _DIGIT_RUN.finditer(text):
        if len(r.group()) >= 7:
            open_ = r.start() > 0 and text[r.start() - 1] == "(" and ")" in r.group()
            for m in _NUMBER.finditer(text, r.start() - open_, r.end()):
                if m.end() - m.start() >= 7:
                    out.append(("number", m.start(), m.end()))
            if r.group()[0] == "+":
                out.append(("number", r.start(), r.start() + len(r.group().rstrip(" ().-"))))
    if _DOT.search(text):
        out += [("spelled", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if '"' in text or "=" in text or "'" in text:
        out += [("key", m.start(), m.end()) for m in _KEY.finditer(text)]
    return out


FEATURES = 33


def features(text: str, kind: str, s: int, e: int) -> list[float]:
    """Format and context of one span."""
    x = text[s:e]
    n = len(x)
    digits = _NOT_DIGIT.sub("", x)
    groups = re.findall(r"[0-9]+", x)
    letters = sum(c.isalpha() for c in x)
    counts = [x.count(c) for c in set(x)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    before = text[max(0, s - 48):s].lower()
    words = re.findall(r"[a-z]+", before)[-4:]
    prev, nxt = text[s - 1:s] if s else "", text[e:e + 1]
    tail = re.search(r"[a-z]*$", x.lower()).group()
    return [ADDED.index(kind) if kind in ADDED else -1, n, len(digits), len(digits) / n, letters / n, len(groups),
            max((len(g) for g in groups), default=0), min((len(g) for g in groups), default=0), x.count("."),
            x.count("-"), x.count(" "), x.count("(") + x.count(")"), float(x[0] == "+"), x.count("@"), entropy,
            float(len(digits) >= 12 and luhn(digits)), float(any(len(g.lstrip("0")) > 3 or int(g) > 255 for g in groups)
                                                              if groups and max(map(len, groups)) < 19 else 1),
            float(x.islower()), float(x.isupper()), float(prev.isalnum()), float(prev in ("", " ", "\n")),
            float(nxt.isalnum()), float(nxt in ("", " ", "\n")), float(tail in _TLD), float(len(tail)), float(any(c.isdigit() for c in x)),
            *(float(any(w in cue for w in words)) for cue in _CUES)]


def matrix(rows: list[list[float]]) -> np.ndarray:
    """Features in half precision: at most 2 ** 16 values each."""
    with np.errstate(over="ignore"):
        return np.array(rows, float).reshape(-1, FEATURES).astype(np.float16)


class BoostedTrees:
    """Gradient boosting of depth-3 regression trees on binned features, logistic loss."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[int, int, float]]] = []
        self.bias = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """From arrays; ``grow`` takes the sums from anywhere."""
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b, score, done = self._bin(x), np.zeros(len(x)), 0

        def sums(tree: list[tuple[int, int, float]]) -> np.ndarray:
            nonlocal score, done
            score, done = score + self.raw(b, done), len(self.trees)
            return self.sums(b, y, np.ones(len(y)), score, tree)
        return self.grow(y.mean(), sums)

    def grow(self, share: float, sums: Callable[[list[tuple[int, int, float]]], np.ndarray]) -> BoostedTrees:
        """Trees from ``sums(tree)``: what ``sums`` gives over all rows for the tree that is being grown."""
        p = np.clip(share, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        for _ in range(self.rounds):
            tree, values = [], []
            for _ in range(self.depth):
                own = [(self._split(*at), at) for at in sums(tree)]
                tree += [cut for cut, _ in own]
            for (f, k, _), (g, h) in own:
                for at in (slice(None, k + 1), slice(k + 1, None)):
                    values.append((-1, -1, float(self.rate * g[f, at].sum() / (h[f, at].sum() + 1.0))))
            self.trees.append([*tree, *values])
        return self

    def _walk(self, b: np.ndarray, tree: list[tuple[int, int, float]], levels: int) -> np.ndarray:
        at, node = np.array([(t[0], t[1]) for t in tree]).reshape(-1, 2), np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(levels):
            node = 2 * node + 1 + (b[rows, at[node, 0]] > at[node, 1])
        return node

    def raw(self, b: np.ndarray, first: int = 0) -> np.ndarray:
        """Sum of the trees from ``first`` on; the bias comes with the first."""
        score = np.full(len(b), 0.0 if first else self.bias)
        for tree in self.trees[first:]:
            score += np.array([t[2] for t in tree])[self._walk(b, tree, self.depth)]
        return score

    def sums(self, b: np.ndarray, y: np.ndarray, weight: np.ndarray, score: np.ndarray, tree: list[tuple[int, int, float]]) -> np.ndarray:
        """(node, gradient or hessian, feature, bin): sums over some rows at the level to which ``tree`` has grown."""
        level = (len(tree) + 1).bit_length() - 1
        node = self._walk(b, tree, level) - len(tree)
        prob = 1 / (1 + np.exp(-score))
        out = np.zeros((1 << level, 2, b.shape[1], self.bins + 1))
        for i, value in enumerate((y - prob, prob * (1 - prob))):
            value = np.rint(value * 2 ** 20) / 2 ** 20 * weight
            for f in range(b.shape[1]):
                out[:, i, f] = np.bincount(node * (self.bins + 1) + b[:, f], value, minlength=(self.bins + 1) << level).reshape(-1, self.bins + 1)
        return out

    def _split(self, g: np.ndarray, h: np.ndarray) -> tuple[int, int, float]:
        best, gain = (0, self.bins + 1, 0.0), 1e-6  # all to the left
        total_g, total_h = g[0].sum(), h[0].sum()
        cg, ch = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        won = cg ** 2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g ** 2 / (total_h + 1)
        for f in range(len(g)):
            k = int(won[f].argmax())
            if won[f, k] > gain:
                gain, best = won[f, k], (f, k, 0.0)
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self._bin(x))))


_WORD = re.compile(r"[\W\d_]([^\W\d_]{2,14})")


def worded(texts: list[str], n: int = WORDED, seed: int = 5, first: int = 0) -> list[tuple[str, str, int, int, float]]:
    """(text, kind, start, end, label): spans of each kind, and of what looks like it, between words from anywhere in the texts."""
    rng = random.Random(seed)

    def word(ascii_only: bool = False) -> str:
        for _ in range(8):
            t = texts[int(rng.random() * len(texts))]
            at = int(rng.random() * len(t))
            m = _WORD.search(t[at - 1:at + 200] if at else " " + t[:200])
            if m and (not ascii_only or m[1].isascii()):
                return m[1]
        return "word"
    ascii_word = lambda: word(True).lower()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def spelled(real: bool) -> tuple[str, str, str]:
        at, dot = rng.choice(((" at ", " dot "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" AT ", " DOT ")))
        if real:
            name = ascii_word() + rng.choice(("", "", f".{ascii_word()}", digits(2)))
            return rng.choice(("", "mail ", "contact: ", "write to ")), f"{name}{at}{ascii_word()}{dot}{rng.choice(_TLD)}", rng.choice(("", ".", " "))
        last = ascii_word()
        return "", f"{ascii_word()} at {ascii_word()} dot {last if last not in _TLD else last + 'er'}", ""

    def key(real: bool) -> tuple[str, str, str]:
        if real:
            letters = rng.choice(("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
                                  "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"))
            cue = rng.choice(("token", "secret", "password", "api_key", "key", "auth token", "access key"))
            mark = rng.choice((' = "', '="', ': "', "='", "="))
            return cue + mark, "".join(rng.choice(letters) for _ in range(rng.randint(20, 48))), '"' if '"' in mark else "'" if "'" in mark else " "
        join = rng.choice("-_/")
        body = join.join(ascii_word() for _ in range(rng.randint(4, 8)))
        body = body if len(body) >= 20 else body + join + "something" * 3
        return rng.choice(("title", "name", "path", "page", "class")) + rng.choice((' = "', '="')), body, '"'

    def number(real: bool) -> tuple[str, str, str]:
        if real:
            if rng.random() < 0.3:
                return rng.choice(("ssn ", "SSN: ", "passport ")), f"{digits(3)}-{digits(2)}-{digits(4)}", rng.choice((" ", ".", ","))
            shape = rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}",
                                f"{digits(3)}-{digits(4)}", f"0{digits(3)}-{digits(6)}", f"{digits(3)}.{digits(3)}.{digits(4)}"))
            return rng.choice(("call ", "phone ", "tel ", "Tel: ", "mobile ", "fax ", "phone: ")), shape, rng.choice((" ", ".", ","))
        shape = rng.choice((f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2030)}",
                            f"{digits(2)} {digits(3)} {digits(3)}", f"1.{digits(3)}.{digits(3)}", f"{rng.randint(1900, 2000)}-{rng.randint(2001, 2030)}", digits(rng.randint(7, 16)),
                            f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(3)}-{digits(4)}"))
        return rng.choice(("", "", "in ", "page ", "version ", "year ", "no ", "chapter ", "vol ")), shape, rng.choice((" ", ".", ","))
    out = []
    for k in range(first, first + n):
        kind, make = (("spelled", spelled), ("key", key), ("number", number))[k % 3]
        real = k // 3 % 2 == 0
        before, body, after = make(real)
        lead = " ".join(word() for _ in range(rng.randint(3, 9))) + rng.choice((" ", ". ", ", ")) + before
        text = f"{lead}{body}{after} " + " ".join(word() for _ in range(rng.randint(2, 6)))
        s = len(lead)
        base, _ = base_spans(text)
        if not any(a < s + len(body) and s < e for _, a, e in base):
            out.append((text, kind, s, s + len(body), float(real)))
    return out


def labelled(text: str) -> list[tuple[str, list[float], float]]:
    """(kind, features, label) of the candidates of a text, its failed shapes and every 60th word."""
    base, failed = base_spans(text)
    exact = {(s, e) for _, s, e in base}
    starts, ends = sorted(s for s, _ in exact), list(accumulate((e for _, e in sorted(exact)), max))
    spans = [*candidates(text), *(("number", s, e) for s, e in failed),
             *(("handle" if k == "email" else "number", s, e) for k, s, e in base)]
    words = [m.span() for m in islice(re.finditer(r"\S{4,}", text), 0, None, 60)]
    out = []
    for k, s, e in dict.fromkeys([*spans, *(("handle", a, b) for a, b in words if (a, b) not in exact)]):
        if (s, e) not in exact and (i := bisect_right(starts, s)) and ends[i - 1] >= e:
            continue  # part of a base span: neither label is right
        out.append((k, features(text, k, s, e), float((s, e) in exact)))
    return out


def written_spans(texts: list[str], n: int, seed: int = 5, first: int = 0) -> list[tuple[str, list[float], float]]:
    """(kind, features, label) of ``worded``, and of what else the generators find on its spans."""
    out = []
    for text, k, s, e, label in worded(texts, n, seed, first):
        out.append((k, features(text, k, s, e), label))
        for other, a, b in candidates(text):  # parts of it, and what lies across it, are no spans of their own
            if (other, a, b) != (k, s, e) and a < e and s < b:
                out.append((other, features(text, other, a, b), 0.0))
    return out


class SpanModel:
    """Trees with a threshold for each kind."""

    def __init__(self):
        self.trees: BoostedTrees | None = None
        self.thresholds = {k: 1.1 for k in ADDED}

    @classmethod
    def train(cls, texts: list[str]) -> SpanModel:
        """From texts at hand; ``fit`` does the same for a table."""
        rows = [r for text in texts for r in labelled(text)] + (written_spans(texts, WORDED) if texts else [])
        out = cls()
        kind, x, y = np.array([r[0] for r in rows]), matrix([r[1] for r in rows]), np.array([r[2] for r in rows])
        fit = np.random.default_rng(3).random(len(y)) < 0.5
        if len(y) < 20 or len(set(y[fit])) < 2:
            return out
        out.trees = BoostedTrees().fit(x[fit].astype(float), y[fit])
        out.calibrate(kind[~fit], out.trees.predict(x[~fit]), y[~fit], np.ones(int((~fit).sum())))
        return out

    def calibrate(self, kind: np.ndarray, score: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> None:
        for k in ADDED:
            own = kind == k
            if weight[own].sum() < 50 or not truth[own].any():
                own = np.ones(len(score), bool)
            scores, at = np.unique(score[own], return_inverse=True)
            hits = np.cumsum(np.bincount(at, truth[own] * weight[own], minlength=len(scores))[::-1])
            good = np.flatnonzero(hits >= PRECISION * np.cumsum(np.bincount(at, weight[own], minlength=len(scores))[::-1]))
            self.thresholds[k] = max(FLOOR, float(scores[::-1][good[-1]])) if len(good) else 1.1

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Candidates over their threshold that overlap no base span and no better candidate."""
        if self.trees is None:
            return []
        taken = sorted((s, e) for _, s, e in base)
        starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        free = lambda s, e: not (i := bisect_left(starts, e)) or ends[i - 1] <= s
        spans = [c for c in dict.fromkeys(candidates(text)) if free(c[1], c[2])]
        if not spans:
            return []
        score = self.trees.predict(matrix([features(text, *c) for c in spans]))
        out: list[tuple[str, int, int]] = []
        held: list[tuple[int, int]] = []
        for i in np.argsort(-score, kind="stable"):
            k, s, e = spans[i]
            at = bisect_left(held, (e, -1))  # added spans are disjoint: the last that starts before e decides
            if score[i] >= self.thresholds[k] and (not at or held[at - 1][1] <= s):
                out.append((k, s, e))
                held.insert(at, (s, e))
        return sorted(out, key=lambda x: (ADDED.index(x[0]), x[1]))


SPAN = np.dtype([("x", "<f2", FEATURES), ("kind", "u1"), ("label", "u1"), ("held", "u1")])
BINNED = np.dtype([("b", "u1", FEATURES), ("kind", "u1"), ("label", "u1"), ("held", "u1")])
DISTINCT, BLOCK = 100_000, 100_000  # distinct spans that a task holds, and that one row of the packed table does


def _counted(keys: Counter) -> pd.DataFrame:
    return pd.DataFrame({"v": list(keys), "n": list(keys.values())})


def _spans(batches: Iterator[pd.DataFrame], each: int) -> Iterator[pd.DataFrame]:
    """Labelled spans of whole texts with their number; ``held``: of a text the trees don't see."""
    seen: Counter[bytes] = Counter()
    for batch in batches:
        for text, h in zip(batch["text"].array, batch["h"]):
            rows = labelled(text) + written_spans([text], each, int(h), (int(h) >> 1) % 6)
            out = np.zeros(len(rows), SPAN)
            out["x"], out["kind"] = matrix([r[1] for r in rows]), [ADDED.index(r[0]) for r in rows]
            out["label"], out["held"] = [r[2] for r in rows], int(h) & 1
            seen.update(r.tobytes() for r in out)
            if len(seen) >= DISTINCT:
                yield _counted(seen)
                seen.clear()
    if seen:
        yield _counted(seen)


def _unpacked(batch: pd.DataFrame, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(batch["v"].array), kind)


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values of each feature with their number, in the texts the trees see."""
    for batch in batches:
        spans, n = _unpacked(batch, SPAN), batch["n"].to_numpy(float)
        fit = spans["held"] == 0
        for f in range(FEATURES):
            value, at = np.unique(spans["x"][fit, f], return_inverse=True)
            yield pd.DataFrame({"f": f, "value": value.astype(float), "n": np.bincount(at, n[fit], minlength=len(value)).astype(np.int64)})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``BLOCK`` distinct binned spans to a row, no scores yet."""
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            some = batch[i:i + BLOCK]
            yield pd.DataFrame({"v": [b"".join(some["v"].array)], "n": [some["n"].to_numpy("<i8").tobytes()],
                                "score": [np.zeros(len(some)).tobytes()]})


BLOCKS = "v binary, n binary, score binary"


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for v, n, score in zip(batch["v"].array, batch["n"].array, batch["score"].array):
            yield np.frombuffer(v, BINNED), np.frombuffer(n, "<i8"), np.frombuffer(score)


def _binned(spans: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Distinct binned spans with their number, packed in blocks and written."""
    trees = BoostedTrees()
    trees.edges = edges

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = _unpacked(batch, SPAN)
            out = np.zeros(len(seen), BINNED)
            out["b"] = trees._bin(seen["x"].astype(float))
            for c in ("kind", "label", "held"):
                out[c] = seen[c]
            yield pd.DataFrame({"v": [r.tobytes() for r in out], "n": batch["n"]})
    rows = spans.mapInPandas(run, "v binary, n long").groupBy("v").agg(F.sum("n").alias("n"))
    return written(rows.repartition(spans.count() // BLOCK + 1).mapInPandas(_packed, BLOCKS), "pii-binned", release=True)


def _grown(blocks: DataFrame, edges: list[np.ndarray], share: float) -> tuple[BoostedTrees, DataFrame]:
    """Trees from the blocks, one pass a level, and the blocks with what scores have been written."""
    trees, carried = BoostedTrees(), 0
    trees.edges = edges
    cells = FEATURES * (trees.bins + 1)

    def sums(tree: list[tuple[int, int, float]]) -> np.ndarray:
        nonlocal blocks, carried
        if len(trees.trees) - carried == CARRY:
            def carry(batches: Iterator[pd.DataFrame], first: int = carried) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield batch.assign(score=[(score + trees.raw(v["b"], first)).tobytes() for v, _, score in _each([batch])])
            old, blocks, carried = blocks, written(blocks.mapInPandas(carry, BLOCKS), "pii-scored"), len(trees.trees)
            drop_written(old)

        def run(batches: Iterator[pd.DataFrame], first: int = carried) -> Iterator[pd.DataFrame]:
            total = 0
            for v, n, score in _each(batches):
                fit = v["held"] == 0
                total += trees.sums(v["b"][fit], v["label"][fit], n[fit], score[fit] + trees.raw(v["b"][fit], first), tree)
            if not np.isscalar(total):
                g, h = total[:, 0].ravel(), total[:, 1].ravel()
                at = np.flatnonzero((g != 0) | (h != 0))
                yield pd.DataFrame({"cell": at, "g": g[at], "h": h[at]})
        got = blocks.mapInPandas(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        out = np.zeros((len(tree) + 1, 2, cells))
        for cell, g, h in got:
            out[cell // cells, :, cell % cells] = g, h
        return out.reshape(len(tree) + 1, 2, FEATURES, trees.bins + 1)
    return trees.grow(share, sums), blocks


def fit(docs: DataFrame) -> SpanModel:
    """Train and calibrate on all texts of ``docs``, each a whole text."""
    out = SpanModel()
    rows = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    each = max(1, math.ceil(WORDED / max(1, rows.count())))
    spans = written(rows.mapInPandas(lambda it: _spans(it, each), "v binary, n long").groupBy("v").agg(F.sum("n").alias("n")),
                    "pii-spans", release=True)
    label, held = (F.expr(f"ascii(substring(hex(v), {2 * SPAN.fields[c][1] + 2}, 1)) = 49") for c in ("label", "held"))
    seen = {(r["label"], r["held"]): r["n"] for r in
            spans.groupBy(label.alias("label"), held.alias("held")).agg(F.sum("n").alias("n")).collect()}
    pos, neg = seen.get((True, False), 0), seen.get((False, False), 0)
    if sum(seen.values()) < 20 or not pos or not neg:
        return out
    values = spans.mapInPandas(_values, "f int, value double, n long").groupBy("f", "value").agg(F.sum("n").alias("n")).toPandas()
    edges = []
    for _, own in values.sort_values(["f", "value"]).groupby("f"):
        up_to, at = own["n"].cumsum().to_numpy(), np.linspace(0, 1, BoostedTrees().bins + 1)[1:-1]
        edges.append(np.unique(own["value"].to_numpy()[np.searchsorted(up_to, np.floor(at * (up_to[-1] - 1)), side="right")]))
    blocks = _binned(spans, edges)
    drop_written(spans)
    out.trees, blocks = _grown(blocks, edges, pos / (pos + neg))
    trees, first = out.trees, (len(out.trees.trees) - 1) // CARRY * CARRY

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for v, n, score in _each(batches):
            held = v["held"] == 1
            score = 1 / (1 + np.exp(-score[held] - trees.raw(v["b"][held], first)))
            yield pd.DataFrame({"kind": v["kind"][held], "label": v["label"][held], "step": np.floor(score * GRID), "n": n[held]}).groupby(
                ["kind", "label", "step"], as_index=False).sum()
    got = blocks.mapInPandas(run, "kind int, label int, step long, n long").groupBy("kind", "label", "step").agg(F.sum("n").alias("n")).toPandas()
    drop_written(blocks)
    out.calibrate(np.array(ADDED)[got["kind"].to_numpy(int)], got["step"].to_numpy() / GRID, got["label"].to_numpy(float), got["n"].to_numpy(float))
    return out


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_added long")


def find_spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    """One row per document: counts and hash of the base spans, all spans as kind:start:end."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array):
                text = "" if pd.isna(text) else text
                base, _ = base_spans(text)
                more = model.added(text, base)
                said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
                kinds = [k for k, _, _ in base]
                rows.append((None if pd.isna(doc_id) else int(doc_id), *(kinds.count(k) for k in BASE),
                             hashlib.sha256(said.encode()).hexdigest(),
                             ",".join(f"{k}:{s}:{e}" for k, s, e in [*base, *more]), len(more)))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, SCHEMA)


def redact(text: str, model: SpanModel, mark: str = "[{}]") -> str:
    """The text with every span replaced by its kind."""
    base, _ = base_spans(text)
    out, at = [], 0
    for k, s, e in sorted([*base, *model.added(text, base)], key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], mark.format(k)]
        elif e <= at:
            continue
        at = e
    return "".join([*out, text[at:]])


@query("op3_pii_spans")
def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_spans(docs, fit(docs))
