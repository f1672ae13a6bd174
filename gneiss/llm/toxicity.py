"""Toxicity by a character n-gram linear classifier on naive Bayes features.

A text's features are the character n-grams of its words (lower-case, with a space at either end),
hashed to 2**22. Training gives each feature its naive Bayes log-count ratio r, the log of its share
among toxic texts over that among clean ones; features whose r is several standard errors from 0
stay. A logistic regression with an L2 penalty is fitted on presence * r, and the score is its output.

Only the fit is on a sample: at most ``most`` labelled rows, the smallest by hash of doc_id, of those
whose crc32(doc_id as text) mod 3 is not 1. It runs in one task. The model, at most ``features`` pairs
of numbers, goes to the driver and is broadcast. Scoring is one pass over whole texts without a shuffle.

Defined results: null text is empty; an empty text has the score of the intercept, or what the labels
share if there is one label only or none (0.5 then); of several labels of a document the largest
counts, null ones don't; repeated rows have a row each; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import derived, release

SIZES = (3, 4, 5, 6)
BITS = 22
WORDS = re.compile(r"\w+")
THRESHOLD = 0.7
#: Words of so many characters aren't kept: each is rare, and any may be large.
LONG = 64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _crc_table() -> np.ndarray:
    """CRC-32 by the byte, as zlib has it."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()


def _slow(word: str) -> np.ndarray:
    """The hashed n-grams of a word: CRC-32 of their UTF-8."""
    w = f" {word} "
    return np.fromiter((zlib.crc32(w[i : i + n].encode()) for n in SIZES for i in range(len(w) - n + 1)), np.uint32) & np.uint32((1 << BITS) - 1)


def _fast(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Those of ASCII words all at once: features, and which word each is of. A hash of n bytes goes on to that of n + 1."""
    line = np.frombuffer((" " + "  ".join(words) + " ").encode(), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(line))  # characters from here to the word's end
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(line))
    state = np.full(len(line), 0xFFFFFFFF, np.uint32)
    features, owners = [], []
    for n in range(1, max(SIZES) + 1):
        fits = left[at] >= n
        at, state = at[fits], state[fits]
        state = CRC[(state ^ line[at + n - 1]) & 0xFF] ^ (state >> 8)
        if n in SIZES:
            features.append(~state & np.uint32((1 << BITS) - 1))
            owners.append(word[at])
    return np.concatenate(features), np.concatenate(owners)


class Grams:
    """Features of words. ``of``, if given, keeps those it has: a table from feature to its place, -1 for none."""

    def __init__(self, of: np.ndarray | None = None, most: int = 200_000):
        self.of, self.most = of, most
        self.known: dict[str, np.ndarray | None] = {}

    def _kept(self, found: np.ndarray) -> np.ndarray | None:
        if self.of is not None:
            found = self.of[found]
            found = found[found >= 0]
        return found if len(found) else None

    def learn(self, words: set[str]) -> None:
        """Look words up that aren't known yet; those that are forgotten first make room, so what is kept is bounded."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(words)
        plain = [w for w in new if w.isascii()]
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            features, owner = _fast(some)
            if self.of is not None:
                features = self.of[features]
                hit = features >= 0
                features, owner = features[hit], owner[hit]
            self.known.update(dict.fromkeys(some))
            order = np.argsort(owner, kind="stable")
            features, owner = features[order], owner[order]
            cut = np.flatnonzero(np.diff(owner)) + 1
            for k, part in zip(owner[np.concatenate(([0], cut))].tolist() if len(owner) else [], np.split(features, cut), strict=False):
                self.known[some[k]] = part
        for w in new:
            if not w.isascii():
                self.known[w] = self._kept(_slow(w))

    def texts(self, texts: list[str | None], at_once: int = 200) -> Iterator[np.ndarray]:
        """Each text's distinct features."""
        for i in range(0, len(texts), at_once):
            words = [set(WORDS.findall((t or "").lower())) for t in texts[i : i + at_once]]
            self.learn(set().union(*words))
            known = self.known
            for own in words:
                found = [g for w in own if (g := known[w]) is not None]
                yield np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
            for w in [w for own in words for w in own if len(w) >= LONG]:
                known.pop(w, None)


def fit(texts: pd.Series, toxic: np.ndarray, features: int, error: float = 4.0, penalty: float = 0.3) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights (log-count ratios times coefficients) and the intercept."""
    n, pos = len(toxic), int(toxic.sum())
    prior = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    empty = np.empty(0, np.int64), np.empty(0), prior
    if not 0 < pos < n:
        return empty
    counts = np.zeros((2, 1 << BITS), np.int32)
    texts = list(texts)
    for own, y in zip(Grams().texts(texts), toxic.tolist(), strict=True):
        counts[y, own] += 1
    p, q = counts[1] + 1.0, counts[0] + 1.0
    ratio = np.log(p / (pos + 2)) - np.log(q / (n - pos + 2))
    z = np.abs(ratio) / np.sqrt(1 / p - 1 / (pos + 2) + 1 / q - 1 / (n - pos + 2))
    z[(counts[0] + counts[1]) < 4] = 0
    chosen = np.flatnonzero(z >= error)
    chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")[:features]])
    if not len(chosen):
        return empty
    of = np.full(1 << BITS, -1, np.int32)
    of[chosen] = np.arange(len(chosen))
    found = list(Grams(of).texts(texts))
    row = np.repeat(np.arange(n), [len(x) for x in found])
    col = np.concatenate(found)
    scale = ratio[chosen]
    weights, bias = logistic(row, col, scale[col], toxic, len(chosen), penalty, prior)
    return chosen, weights * scale, bias


def logistic(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, penalty: float, bias: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on sparse rows by L-BFGS with ten pairs."""
    n = len(y)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, x * w[col], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.append(np.bincount(col, x * (p - y)[row], width) + penalty * w[:-1], (p - y).sum())
        return float(np.logaddexp(0, np.where(y == 1, -z, z)).sum() + penalty / 2 * (w[:-1] ** 2).sum()), g

    w = np.append(np.zeros(width), bias)
    f, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, t in reversed(pairs):
            a = s @ d / (s @ t)
            kept.append(a)
            d -= a * t
        if pairs:
            s, t = pairs[-1]
            d *= s @ t / (t @ t)
        for (s, t), a in zip(pairs, reversed(kept), strict=True):
            d += s * (a - t @ d / (s @ t))
        rate = 1.0 if pairs else 1 / max(1.0, float(np.abs(g).sum()))
        while rate > 1e-12:
            f2, g2 = loss(w - rate * d)
            if f2 <= f - 1e-4 * rate * (g @ d):
                break
            rate /= 2
        else:
            break
        s, t = -rate * d, g2 - g
        w, done, f, g = w + s, abs(f - f2) < 1e-7 * max(1.0, abs(f)), f2, g2
        if s @ t > 1e-12:
            pairs = [*pairs[-9:], (s, t)]
        if done:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", most: int = 8_000, features: int = 40_000) -> tuple[np.ndarray, np.ndarray, float]:
    """The model: features, weights, intercept."""
    named = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = named.where("y in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col(text).alias("t")).join(F.broadcast(chosen), "doc_id").select(F.lit("all").alias("task"), "t", "y")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "y"], kind="stable")  # sums, and so scores, don't depend on the order in which rows arrive
        which, weights, bias = fit(rows["t"], rows["y"].to_numpy(np.int64), features)
        release()
        return pd.DataFrame({"feature": np.append(which, -1), "weight": np.append(weights, bias)})

    # Sorted here: a sort by Spark would run the fit once more for its sample.
    model = rows.groupBy("task").applyInPandas(run, "feature long, weight double").toPandas().sort_values("feature")
    if not len(model):
        return np.empty(0, np.int64), np.empty(0), 0.0
    return model["feature"].to_numpy()[1:], model["weight"].to_numpy()[1:], float(model["weight"].iloc[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, from 0 to 1; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], list[list]]:
        which, weights, bias = sent.value
        of = np.full(1 << BITS, -1, np.int32)
        of[which] = np.arange(len(which))
        grams = Grams(of)

        def scored(texts: list) -> list[list]:
            z = np.array([weights[own].sum() + bias for own in grams.texts(texts)])
            return [1 / (1 + np.exp(-np.clip(z, -500, 500)))]

        return scored

    return derived(docs, [c for c in docs.columns if c != name], text, {name: "double"}, make)
