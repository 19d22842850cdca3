"""Operator 5: language identification by a bidirectional gated recurrent network over bytes.

The network (a forward and a backward GRU over UTF-8 bytes, one softmax on
both states) labels every byte position; a document's probabilities are the
mean over all its positions.  It is trained here in numpy by backpropagation
through time on a bounded sample: at most ``PER_LANG`` documents a language
(by a hash order over all training rows) and ``SNIPPETS`` snippets of
``SNIPPET`` characters from each, at hashed places.

Prediction reads whole texts: each is cut into windows of ``WINDOW`` bytes
overlapping by twice ``CONTEXT``; a position is labelled in the window where it
has context on both sides, so each byte counts once.  Windows run side by side
(features x windows matrices), longest first, in bounded chunks.

Defined cases: null text or text without a letter gives ``und`` and score 0;
without any training row every text gives ``und``; lang, source and doc_id are
never inputs of a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, hash_share, whole_row
from .registry import documents, query

PER_LANG, SNIPPETS, SNIPPET = 384, 2, 80
HIDDEN, EPOCHS, BATCH, RATE = 8, 8, 64, 0.02
WINDOW, CONTEXT, CHUNK = 256, 12, 2048
LETTER = re.compile(r"[^\W\d_]")


class ByteGru:
    """Weights are float32.  Sigmoids are written as (1 + tanh(x / 2)) / 2, the halves folded into the weights."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        f = np.float32
        self.p = {}
        for d in "fb":  # rows: reset, update, candidate
            self.p[f"x{d}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(f)
            self.p[f"u{d}"] = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(f)
            self.p[f"o{d}"] = rng.normal(0, 0.3, (len(langs), hidden)).astype(f)
        self.p["o"] = np.zeros((len(langs), 1), f)

    def _step(self, d: str, byte: np.ndarray, h: np.ndarray):
        k = self.h
        x = self.p[f"x{d}"][:, byte]
        u = self.p[f"u{d}"] @ h
        g = np.tanh(x[:2 * k] + u[:2 * k])
        g += 1
        g *= 0.5
        c = np.tanh(x[2 * k:] + g[:k] * u[2 * k:])
        return c + g[k:] * (h - c), g, c, u[2 * k:]

    def train(self, bytes_: np.ndarray, lengths: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS,
              batch: int = BATCH, rate: float = RATE, seed: int = 11) -> None:
        """``bytes_``: (n, T) uint8, zero-padded; Adam on the mean cross-entropy of all positions."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(labels) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                grad = self._gradient(bytes_[some].T.astype(np.intp), lengths[some], labels[some])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                lr = rate * min(1.0, 5.0 / max(norm, 1e-9)) * (1 - 0.9 * step / steps)
                for k, g in grad.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] -= lr * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)

    def _gradient(self, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        steps, n = x.shape
        k, p = self.h, self.p
        live = (np.arange(steps)[:, None] < lengths[None, :]).astype(np.float32)  # (T, n)
        kept = {}
        for d in "fb":
            h, kept[d] = np.zeros((k, n), np.float32), {}
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                new, g, c, uc = self._step(d, x[t], h)
                kept[d][t] = (h, g, c, uc)
                h = h + live[t] * (new - h)
                kept[d][t] += (h,)
        grad = {name: np.zeros_like(v) for name, v in p.items()}
        out = {d: np.empty((steps, k, n), np.float32) for d in "fb"}
        total = live.sum()
        for t in range(steps):
            hf, hb = kept["f"][t][4], kept["b"][t][4]
            z = p["of"] @ hf + p["ob"] @ hb + p["o"]
            z = np.exp(z - z.max(axis=0))
            z /= z.sum(axis=0)
            z[labels, np.arange(n)] -= 1
            z *= live[t] / total
            grad["of"] += z @ hf.T
            grad["ob"] += z @ hb.T
            grad["o"] += z.sum(axis=1, keepdims=True)
            out["f"][t], out["b"][t] = p["of"].T @ z, p["ob"].T @ z
        for d in "fb":
            back = np.zeros((k, n), np.float32)
            gx = np.zeros((256, 3 * k), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, g, c, uc, _ = kept[d][t]
                back = back + out[d][t]
                dh = back * live[t]
                r, z = g[:k], g[k:]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z) * 2
                dr = dc * uc * r * (1 - r) * 2
                inner = np.concatenate([dr, dz, dc])
                through = np.concatenate([dr, dz, dc * r])
                np.add.at(gx, x[t], inner.T)
                grad[f"u{d}"] += through @ h.T
                back = back * (1 - live[t]) + dh * z + p[f"u{d}"].T @ through
            grad[f"x{d}"] += gx.T
        return grad

    def _windows(self, x: np.ndarray, lengths: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sum of the position probabilities in [lo, hi) of each window; x: (T, n), longest window first."""
        steps, n = x.shape
        live = [int(v) for v in np.searchsorted(-lengths, -np.arange(steps), side="left")]
        k, p = self.h, self.p
        states = np.zeros((steps, k, n), np.float32)
        h = np.zeros((k, n), np.float32)
        for t in range(steps):
            m = live[t]
            h = self._step("f", x[t, :m], h[:, :m])[0]
            states[t, :, :m] = h
        acc = np.zeros((len(self.langs), n), np.float32)
        h = np.zeros((k, n), np.float32)
        for t in range(steps - 1, -1, -1):
            m = live[t]
            h[:, :m] = new = self._step("b", x[t, :m], h[:, :m])[0]
            z = p["of"] @ states[t, :, :m]
            z += p["ob"] @ new
            z += p["o"]
            np.exp(z, out=z)
            z *= ((lo[:m] <= t) & (t < hi[:m])) / z.sum(axis=0)
            acc[:, :m] += z
        return acc

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(documents, languages): mean over all byte positions (zeros for an empty text)."""
        total = np.zeros((len(texts), len(self.langs)))
        stride = WINDOW - 2 * CONTEXT
        doc, start = [], []
        for i, t in enumerate(texts):
            s = np.arange(0, max(1, len(t) - 2 * CONTEXT), stride) if t else np.zeros(0, int)
            start.append(s)
            doc.append(np.full(len(s), i))
        if not doc:
            return total
        doc, start = np.concatenate(doc), np.concatenate(start)
        size = np.array([len(t) for t in texts], np.int64)
        length = np.minimum(WINDOW, size[doc] - start)
        lo = np.where(start == 0, 0, CONTEXT)
        hi = np.where(start + length >= size[doc], length, length - CONTEXT)
        flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        base = np.concatenate([[0], np.cumsum(size)])[doc] + start
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), CHUNK):
            some = order[at:at + CHUNK]
            steps = int(length[some[0]])
            x = flat[base[some][None, :] + np.arange(steps)[:, None]].astype(np.intp)
            acc = self._windows(x, length[some], lo[some], hi[some])
            np.add.at(total, doc[some], acc.T)
        return total / np.maximum(size, 1)[:, None]

    def predict(self, texts: pd.Series, max_bytes: int = 8_000_000) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        todo, room = [], 0

        def flush():
            if todo:
                prob = self.document_probabilities([b for _, b in todo])
                for (i, _), row in zip(todo, prob):
                    best = int(row.argmax())
                    names[i], scores[i] = self.langs[best], float(min(1.0, max(0.0, row[best])))
                todo.clear()
        for i, t in enumerate(texts):
            if t and self.langs and LETTER.search(t):
                b = t.encode("utf-8", "replace")
                todo.append((i, b))
                room += len(b)
                if room > max_bytes:
                    flush()
                    room = 0
        flush()
        return names, scores


def snippets(docs: DataFrame, learn: Column) -> DataFrame:
    """Bounded training sample (lang, snippet): per language the first ``PER_LANG`` documents in hash order.
    Languages are counted first, so that only about twice that many rows of each are ranked."""
    text = F.col("text")
    rows = docs.where(learn & F.col("lang").isNotNull() & text.isNotNull() & (F.length(text) > 0))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * PER_LANG / n))).otherwise(share)
    keyed = rows.where(hash_share(F.col("h")) <= share).select("lang", "h", *[F.expr(
        f"substring(text, cast(1 + pmod(xxhash64(h, {k}), greatest(1, length(text) - {SNIPPET})) as int), {SNIPPET})")
        .alias(f"s{k}") for k in range(SNIPPETS)])
    by = Window.partitionBy("lang").orderBy("h")
    few = keyed.withColumn("r", F.row_number().over(by)).where(F.col("r") <= PER_LANG)
    return few.select("lang", F.explode(F.array(*[f"s{k}" for k in range(SNIPPETS)])).alias("snippet"))


def fit(docs: DataFrame, learn: Column) -> ByteGru:
    """Train on the rows that ``learn`` admits; at most PER_LANG * SNIPPETS snippets a language reach the driver."""
    rows = sorted((r["lang"], r["snippet"]) for r in snippets(docs, learn).collect() if r["snippet"])
    langs = sorted({lang for lang, _ in rows})
    net = ByteGru(langs)
    if len(langs) > 1:
        data = [s.encode("utf-8", "replace") for _, s in rows]
        length = np.array([len(b) for b in data])
        x = np.zeros((len(data), int(length.max())), np.uint8)
        for i, b in enumerate(data):
            x[i, :len(b)] = np.frombuffer(b, np.uint8)
        net.train(x, length, np.array([langs.index(lang) for lang, _ in rows]))
    return net


def language_column(net: ByteGru, text: str = "text") -> Column:
    """struct(lang_pred, score) of each whole text, by Arrow batches."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = net.predict(texts)
            yield pd.DataFrame({"lang_pred": names, "score": scores})
    return predict(F.col(text))


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose crc32(doc_id) mod 5 is not 0."""
    held = crc_mod("doc_id", 5) == 0
    net = fit(docs, ~held)
    return (docs.select("doc_id", held.alias("held_out"), language_column(net).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


# ---------------------------------------------------------------- filter

OTHER = "\x00other"   # class of what is in no learned language
SIZES = (24, 48, 80)  # bytes of the texts that the bar is calibrated on
LEAST_BAR, MOST_BAR = 0.9, 0.995
_SCRIPTS = ((0x0370, 0x03FF), (0x0400, 0x04FF), (0x0590, 0x05EA), (0x0620, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x10A0, 0x10FF),
            (0x3041, 0x3096), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def strange_texts(clean: list[str], n: int, seed: int) -> list[str]:
    """``n`` texts of SNIPPET characters in no language: random printable characters, encoded blobs, letters of scripts
    that ``clean`` does not use, and clean texts with their characters shuffled."""
    rng = np.random.default_rng(seed)
    used = set("".join(clean))
    scripts = [(a, b) for a, b in _SCRIPTS if not any(a <= ord(c) <= b for c in used)]
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            out.append("".join(map(chr, rng.integers(33, 127, SNIPPET))))
        elif kind == 1:
            letters = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")[i // 4 % 2]
            out.append("".join(letters[k] for k in rng.integers(0, len(letters), SNIPPET)))
        elif kind == 2 and scripts:
            a, b = scripts[i // 4 % len(scripts)]
            chars = [chr(c) for c in rng.integers(a, b + 1, SNIPPET)]
            out.append("".join(" " if k % 7 == 6 else c for k, c in enumerate(chars)))
        else:
            own = list(clean[int(rng.integers(len(clean)))]) or ["x"]
            out.append("".join(own[k] for k in rng.permutation(len(own))))
    return out


class LanguageFilter:
    """A network with one class more, for texts in no learned language, and the bar of that class by text length.

    A bar lies half way from the largest share of the class in held-out clean texts of its length to one, from LEAST_BAR to
    MOST_BAR: clean texts stay.  Texts shorter than the shortest length stay."""

    def __init__(self, net: ByteGru, bars: list[float]):
        self.net, self.bars = net, bars

    @classmethod
    def train(cls, rows: list[tuple[str, str]], seed: int = 21) -> LanguageFilter | None:
        """``rows``: (language, snippet); every fourth is held out for the bars.  None without a labelled text."""
        rows = [r for r in rows if r[1]]
        fit_rows, held = [r for k, r in enumerate(rows) if k % 4], rows[::4]
        if not fit_rows or not held:
            return None
        clean = [t for _, t in fit_rows]
        each = max(1, len(clean) // len({lang for lang, _ in fit_rows}))
        learn = sorted([*fit_rows, *((OTHER, t) for t in strange_texts(clean, 2 * each, seed))])
        langs = sorted({lang for lang, _ in learn})
        net = ByteGru(langs)
        data = [t.encode("utf-8", "replace") for _, t in learn]
        length = np.array([len(b) for b in data])
        x = np.zeros((len(data), int(length.max())), np.uint8)
        for i, b in enumerate(data):
            x[i, :len(b)] = np.frombuffer(b, np.uint8)
        net.train(x, length, np.array([langs.index(lang) for lang, _ in learn]))
        at, bars = langs.index(OTHER), []
        for size in SIZES:
            cut = [t.encode("utf-8", "replace")[:size] for _, t in held]
            most = float(net.document_probabilities([c for c in cut if c])[:, at].max())
            bars.append(min(MOST_BAR, max(LEAST_BAR, (1 + most) / 2)))
        return cls(net, bars)

    def keeps(self, texts: pd.Series) -> list[bool]:
        out, todo = [], []
        for t in texts:
            some = bool(t) and LETTER.search(t) is not None
            out.append(some)
            if some and len(b := t.encode("utf-8", "replace")) >= SIZES[0]:
                todo.append((len(out) - 1, b))
        at = self.net.langs.index(OTHER)
        for k in range(0, len(todo), 512):
            some = todo[k:k + 512]
            share = self.net.document_probabilities([b for _, b in some])[:, at]
            for (i, b), p in zip(some, share):
                out[i] = bool(p <= self.bars[max(j for j, size in enumerate(SIZES) if len(b) >= size)])
        return out


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """Documents in a learned language.

    Texts without a letter go, and those whose positions the network gives to the class of strange texts beyond the
    bar of their length.  Without a labelled row there is nothing to judge by, and all rows stay; with one language
    it is that language against strange texts.  Very short texts with a letter stay.  All columns come back."""
    rows = sorted((r["lang"], r["snippet"]) for r in snippets(docs, crc_mod("doc_id", 5) != 0).collect() if r["snippet"])
    rows = sorted(rows, key=lambda r: zlib.crc32(f"{r[0]}:{r[1]}".encode()))
    judge = LanguageFilter.train(rows)
    if judge is None:
        return docs

    @F.pandas_udf("boolean")
    def keeps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(judge.keeps(texts.where(texts.notna(), "")), dtype=bool)
    return docs.select(whole_row(docs), keeps(F.col("text")).alias("keep")).where("keep").select("row.*")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(documents(spark, sf_dir))
