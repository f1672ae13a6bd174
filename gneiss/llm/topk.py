"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Components are whole numbers, floor(256 x). A vector's component has an impact, its size; impacts are
quantised to powers of two, and an index block keeps its postings (vector, component, value) in segments
of one quantised impact, largest first, and nothing else: vectors are put together from postings. A block of
queries goes through a block's segments in that order and adds value * query to the accumulators. What a
vector has in the segments to come can add |query| * |rest of the vector| at the most (Cauchy and Schwarz), so
after each segment a query has a proven floor for its k-th score, the k-th largest accumulator less that much,
and drops the vectors whose accumulator plus that much lies below it. A query is done when few vectors are
possible, which alone are scored exactly; vectors that no query needs any more leave the segments to come.

Vectors are dealt into blocks by hash of their id, once. Queries, 512 in a row, are sent to each block, as
every query has to meet every vector; every meeting gives k rows a query, of which the best k stay.

Defined results: vectors that are null or hold null, NaN or infinity take no part; a shorter vector
counts as padded with 0, so an empty one scores 0; rows that repeat an id and vector count once;
a query's own rows are those with its id; fewer candidates than k give fewer rows; an empty table gives
none; a null id takes no part; other columns, whatever their names, are left out. Scores beyond 64 bits are
cut to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.blocks import expand_array, joined, parted, squeeze_array
from gneiss.llm.common import cut, release

SCALE = 256
BLOCK, QUERIES = 4_096, 512
FEW = 64
EXACT = float(1 << 53)


def whole(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): finite vectors as whole numbers in doubles (exact: scaling by a power of two and floor are)."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Spark's floor makes a long; components beyond its range keep their value: they are whole already.
    big = float(1 << 52)
    scaled = F.transform(v, lambda x: x.cast("double") * float(SCALE))
    floored = F.transform(scaled, lambda x: F.when(F.abs(x) < big, F.floor(x).cast("double")).otherwise(x))
    return df.where(v.isNotNull() & F.col(id_column).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), floored.alias("v"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    sizes = [len(v) for v in vectors]
    dim = max(sizes, default=0)
    if all(n == dim for n in sizes):
        return np.array([np.asarray(v, np.float64) for v in vectors], np.float64).reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _distinct(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)))
    return ids[new], rows[new]


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in doubles, in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0.0)
    kind = next((k for k in (np.int16, np.int32) if most <= np.iinfo(k).max), np.float64)
    return np.dtype(kind).char.encode() + squeeze_array(x.astype(kind))


def _unpacked(payload: memoryview) -> np.ndarray:
    return expand_array(payload[1:], np.dtype(chr(payload[0])).type).astype(np.float64)


class Index:
    """A block: ids in order, and segments of postings by falling impact, each by component and vector."""

    def __init__(self, payload: bytes):
        ids, shape, *segments = parted(payload)
        self.ids = np.frombuffer(ids, np.int64)
        self.dim = int(np.frombuffer(shape, np.int64)[0])
        self.segments = [(expand_array(v, np.uint32), expand_array(d, np.uint32), _unpacked(x)) for v, d, x in zip(*[iter(segments)] * 3, strict=True)]

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray) -> bytes:
        dim, vec = np.nonzero(x.T)
        value = x[vec, dim]
        impact = np.frexp(value)[1] if len(value) else np.empty(0, np.int64)
        parts = [ids.tobytes(), np.array([x.shape[1]], np.int64).tobytes()]
        for level in np.unique(impact)[::-1].tolist():
            of = impact == level
            parts += [squeeze_array(vec[of].astype(np.uint32)), squeeze_array(dim[of].astype(np.uint32)), _packed(value[of])]
        return joined(*parts)

    def vectors(self, wide: int) -> np.ndarray:
        out = np.zeros((len(self.ids), wide))
        for vec, dim, value in self.segments:
            out[vec, dim] = value
        return out


def search(who: np.ndarray, queries: np.ndarray, index: Index, k: int, read: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its place and the ids and scores of its k best in the block, ties to smaller ids. ``read``, if given, gets the number of accumulations of each segment."""
    wide = max(index.dim, queries.shape[1])
    queries = np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
    vectors, ids = index.vectors(wide), index.ids
    squares = np.square(vectors).sum(axis=1)
    sizes = np.linalg.norm(queries, axis=1)
    # Rounding of doubles is far below one unit unless scores near 2**53; then nothing is proven early.
    slack = 1 + 1e-9 * sizes * np.sqrt(squares.max(initial=0.0))
    big = (np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * max(wide, 1)) >= EXACT

    def exact(q: int, possible: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        if big:
            own = [int(x) for x in queries[q]]
            score = np.array([max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(own, vectors[j], strict=True)))) for j in possible], np.int64)
        else:
            score = (vectors[possible] @ queries[q]).astype(np.int64)
        best = np.lexsort((ids[possible], ~score))[:k]
        return q, ids[possible][best], score[best]

    active, rows = np.arange(len(queries)), np.arange(len(ids))
    acc = np.zeros((len(active), len(rows)))
    floor = np.full(len(queries), -np.inf)
    place = rows.copy()  # of each vector among those still needed, -1 for the others
    for vec, dim, value in index.segments if not big else ():
        at = place[vec]
        in_use = at >= 0
        plane = np.zeros((len(rows), wide))
        plane[at[in_use], dim[in_use]] = value[in_use]
        acc += queries[active] @ plane.T
        if read is not None:
            read.append(len(active) * int(in_use.sum()))
        squares = np.maximum(squares - np.bincount(vec, value * value, len(ids)), 0)
        may_add = sizes[active][:, None] * np.sqrt(squares[rows])[None, :] + slack[active][:, None]
        seen = np.where(ids[rows][None, :] == who[active][:, None], -np.inf, acc)
        if len(rows) > k:
            low = seen - may_add
            floor[active] = np.maximum(floor[active], np.partition(low, len(rows) - k, axis=1)[:, len(rows) - k])
        possible = (seen + may_add >= floor[active][:, None]) & (seen > -np.inf)
        done = possible.sum(axis=1) <= FEW
        for i in np.flatnonzero(done).tolist():
            yield exact(int(active[i]), rows[possible[i]])
        needed = possible[~done].any(axis=0)
        active, acc, rows = active[~done], acc[~done][:, needed], rows[needed]
        place = np.full(len(ids), -1)
        place[rows] = np.arange(len(rows))
        if not len(active):
            return
    for q in active.tolist():
        yield exact(q, rows[ids[rows] != who[q]])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """Each query's k best of all other vectors: query_id, rank, vec_id, score."""
    rows, asked = whole(vectors, id_column, vector), whole(queries, id_column, vector)
    n_blocks = max(1, -(-rows.count() // block))
    n_sides = max(1, -(-asked.count() // query_block))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = _distinct(rows["id"].to_numpy(np.int64), _matrix(rows["v"]))
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "index": [Index.build(ids, x)]})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = _distinct(rows["id"].to_numpy(np.int64), _matrix(rows["v"]))
        return pd.DataFrame({"asked": [joined(ids.tobytes(), np.array(x.shape, np.int64).tobytes(), _packed(x.ravel()))]})

    index = cut(rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInPandas(build, "block int, index binary"))
    sides = cut(asked.withColumn("side", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_sides))).groupBy("side").applyInPandas(pack, "asked binary"))
    sent = sides.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    # A block of the index lies in one place, and what is asked comes to it. No join by broadcast: both sides grow.
    met = index.repartitionById(n_blocks, "block").hint("shuffle_hash").join(sent.repartitionById(n_blocks, "block"), "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.block != last:
                    last, own = row.block, Index(row.index)
                ids, shape, x = parted(row.asked)
                who, q = np.frombuffer(ids, np.int64), _unpacked(x).reshape(np.frombuffer(shape, np.int64))
                found: list[list[np.ndarray]] = [[], [], [], []]
                for i, best, score in search(who, q, own, k):
                    for c, values in zip(found, (np.full(len(best), who[i]), np.full(len(best), i), best, score), strict=True):
                        c.append(values)
                yield pd.DataFrame({c: np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for c, x in zip(("query_id", "vector", "vec_id", "score"), found, strict=True)})
        release()

    found = met.select("block", "index", "asked").mapInPandas(run, "query_id long, vector long, vec_id long, score long")
    # A query id with several vectors has a list for each: ``vector`` tells them apart.
    order = Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
