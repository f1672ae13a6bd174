"""Periodic runs of words, found by the runs theorem.

A run is a longest stretch of words in which words one period apart are the same. The theorem says that each
run holds, under an order of the words or under its reverse, a root that is the longest Lyndon word at its
place. Longest Lyndon words end where the inverse suffix array has its next smaller value (under the reversed
order, its next greater one). A root of length p at i is extended to the right by the longest common prefix of
the suffixes at i and i + p, and to the left by that of the reversed text; both are range minima of an LCP
array, asked of a sparse table.

Texts are cut first where no run can be: a run of ``power`` periods holds each of its pairs of neighbouring
words ``power`` - 1 times at least, so nothing with a rarer pair in it is one. What is left after some such
cuts, of a batch of texts, gets one suffix array; without cuts the result would be the same.

Work is by row: a text's words meet in one task, some dozens of bytes each.

Defined results: null text has no words and no runs, and its ``kept`` is empty; runs are ordered by start, then
period; repeated rows and null ids have their own rows; an empty table gives an empty table; other columns,
whatever their names, come back if named in ``keep``.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import WORD, derived, word_count

#: A run has so many periods and words at least.
POWER, LEAST = 4, 6
#: Times that texts are cut at rare pairs before suffixes are sorted.
CUTS = 6
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Suffixes:
    """Suffix array, its inverse and LCP array of ``s``, and a sparse table of minima over that."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        levels, width = [rank], 1
        while n and rank.max() < n - 1:
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key)
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            levels.append(rank.astype(np.int32))
            width *= 2
        self.n, self.rank = n, rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.minima = [self._lcp(levels)]
        step = 1
        while 2 * step <= n - 1:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _lcp(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of neighbours in the array: the doubling's ranks tell whether stretches of 2^k are equal."""
        a, b = self.order[:-1], self.order[1:]
        met = np.zeros(max(self.n - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + met, b + met
            inside = np.maximum(x, y) < self.n
            same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
            met[same] += 1 << k
        return met.astype(np.int32)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, which differ; beyond the end all are empty."""
        out = np.zeros(len(a), np.int64)
        inside = np.flatnonzero(np.maximum(a, b) < self.n)
        x, y = self.rank[a[inside]], self.rank[b[inside]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            table = self.minima[k]
            out[inside[some]] = np.minimum(table[lo[some]], table[hi[some] - (1 << k)])
        return out


def next_smaller(values: list[int], stops: list[bool]) -> np.ndarray:
    """For each place the next one with a smaller value, or the next stop."""
    n = len(values)
    after = [n] * n
    for i in range(n - 1, -1, -1):
        if not stops[i]:
            j, own = i + 1, values[i]
            while not stops[j] and values[j] > own:
                j = after[j]
            after[i] = j
    return np.array(after, np.int64)


def runs_in(codes: np.ndarray, part: np.ndarray, power: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of words ``codes``; ``part`` rises from one text to the next. By start, then period."""
    none = np.empty(0, np.int64)
    if not len(codes):
        return none, none, none
    ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
    n_parts = len(ends)
    # each part is followed by an end of its own, smaller than all words
    place = np.arange(len(codes)) + np.repeat(np.arange(n_parts), np.diff(ends, prepend=0))
    s = np.empty(len(codes) + n_parts, np.int64)
    stops = np.ones(len(s), bool)
    s[place] = codes.astype(np.int64) + n_parts
    stops[place] = False
    s[stops] = np.arange(n_parts)
    forward, listed = Suffixes(s), stops.tolist()
    at, after = [], []
    for values in (forward.rank, len(s) - forward.rank):
        end = next_smaller(values.tolist(), listed)
        some = np.flatnonzero(~stops & ~stops[np.minimum(end, len(s) - 1)])
        at.append(some)
        after.append(end[some])
    i, j = np.concatenate(at), np.concatenate(after)
    right = forward.common(i, j)
    # a run's first root begins within the run's first period: what is right of it is long
    some = right > (power - 2) * (j - i)
    i, j, right = i[some], j[some], right[some]
    if not len(i):
        return none, none, none
    backward = Suffixes(s[::-1])
    left = backward.common(len(s) - i, len(s) - j)
    start, period = i - left, j - i
    length = left + period + right
    long = length >= np.maximum(least, power * period)
    found = np.unique(np.stack([start[long], period[long], length[long]]), axis=1)
    back = np.zeros(len(s), np.int64)
    back[place] = np.arange(len(codes))
    return back[found[0]], found[2], found[1]


def pairs_left(codes: np.ndarray, part: np.ndarray, n_codes: int, power: int) -> np.ndarray:
    """For each word but the last: does it stand, in its part, beside the next, and this pair there as often as a run wants?"""
    inside = part[1:] == part[:-1]
    first = part[:-1].astype(np.int64) * n_codes + codes[:-1]
    if int(first.max()) >= (1 << 62) // n_codes:
        first = np.unique(first, return_inverse=True)[1]
    key = first * n_codes + codes[1:]
    _, which, often = np.unique(key[inside], return_inverse=True, return_counts=True)
    inside[inside] = often[which] >= power - 1
    return inside


def stretches(codes: np.ndarray, part: np.ndarray, power: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that a run can hold, and the number of the stretch of each."""
    places, n_codes = np.arange(len(codes)), int(codes.max(initial=0)) + 1
    for _ in range(CUTS):
        if len(places) < least:
            return places[:0], part[:0]
        linked = pairs_left(codes[places], part, n_codes, power)
        number = np.concatenate(([0], np.cumsum(~linked)))
        stay = np.bincount(number)[number] >= least
        settled = linked.sum() == (part[1:] == part[:-1]).sum() and stay.all()
        places, part = places[stay], number[stay]
        if settled:
            break
    return places, part


def texts_runs(texts: list[str | None], power: int = POWER, least: int = LEAST) -> list[list]:
    """For each text its runs, a dict each, and its words without those that repeat a period."""
    words = [t.encode().split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    told: list[list[dict]] = [[] for _ in texts]
    drop: dict[int, np.ndarray] = {}
    if sizes.sum():
        codes = pa.array(chain.from_iterable(words), pa.binary(), size=int(sizes.sum())).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        places, part = stretches(codes, np.repeat(np.arange(len(texts)), sizes), power, least)
        start, length, period = runs_in(codes[places], part, power, least)
        start = places[start] if len(start) else start
        owner = np.searchsorted(first + sizes, start, side="right")
        for k, s, n, p in zip(owner.tolist(), (start - first[owner]).tolist(), length.tolist(), period.tolist(), strict=True):
            told[k].append({"start": s, "length": n, "period": p})
            mark = drop.setdefault(k, np.zeros(sizes[k] + 1, np.int64))
            mark[s + p] += 1
            mark[s + n] -= 1
    kept = [b" ".join(w if k not in drop else [x for x, d in zip(w, np.cumsum(drop[k]).tolist(), strict=False) if not d]).decode() for k, w in enumerate(words)]
    return [told, kept]


def find_runs(docs: DataFrame, keep: list[str], text: str | Column = "text", power: int = POWER, least: int = LEAST) -> DataFrame:
    """Columns ``keep``, then ``runs`` (all runs of ``power`` periods and ``least`` words or more) and ``kept`` (the words, one space apart, without what repeats a run's first period)."""
    return derived(docs, keep, text, {"runs": f"array<{RUN}>", "kept": "string"}, lambda: lambda texts: texts_runs(texts, power, least))


def with_planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one in ten ids (by checksum) its words from some place on replaced by repeats of some of them. A null id has none."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, h = word_count(text), F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    a = g % F.nullif(n, F.lit(0))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times))
    changed = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def digest_runs(found: DataFrame) -> DataFrame:
    """Per row doc_id, the number of runs, the longest one (first start, then smallest period, if several) and digests of runs and kept words."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    one = found.withColumn("best", best)
    length, period = -F.col("best.less"), F.col("best.period")
    return one.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
