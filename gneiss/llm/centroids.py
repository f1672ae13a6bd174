"""Centroid clustering of whole-number vectors with Drake's adaptive bounds, exact to the last tie.

Components are whole numbers, floor(256 x). Each vector keeps its cluster, an upper bound of its distance to
that centroid, lower bounds of its distances to its several next nearest centroids, by number, and one lower
bound for all the rest. Centroids move between rounds, and bounds with them. A vector whose upper bound stays
below all lower bounds keeps its cluster unseen; else its distance is measured, and as many of its next nearest
as the bounds can't rule out are measured and sorted anew, or all centroids if the order can't be certified
by the remaining bound. How many bounds are kept adapts: half of the first number or, if more, as many as the round before has used.

Distances are compared as whole numbers, ties go to the smaller number, and bounds are rounded outwards, so
the result is that of comparing every vector with every centroid. A round writes vectors with their bounds to the shared folder
(the round before goes) and, beside some of the rows, what joined and left each cluster; Spark sums that, so a centroid costs
one row a task and the driver sees k x dimensions numbers. Nothing else meets in one place: a cluster may hold any share of the rows.

Defined results: vectors that are null, have another number of components, or a null or non-finite one
take no part; components beyond +-2^27 count as that, so that distances fit in 64 bits; repeated rows are vectors of their own;
a null id hashes as the empty text; fewer vectors than centroids give as many centroids as vectors; an empty table gives an empty
table; ids may be of any type; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.common import forget, release, shared_folder

MOST = 1 << 27
#: Relative widening of bounds: far more than the rounding of a root.
SLACK = 1e-9


@dataclass(frozen=True)
class Round:
    """What a round of assignments needs: centroids, how far each has moved, bounds kept before and to keep."""

    centroids: np.ndarray
    moved: np.ndarray
    kept: int
    keep: int


def state_type(keep: int) -> np.dtype:
    return np.dtype([("cluster", "<i4"), ("upper", "<f8"), ("near", "<i4", (keep,)), ("lower", "<f8", (keep,)), ("rest", "<f8"), ("distance", "<i8")])


def measured(vectors: np.ndarray, centroids: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
    """Squared distances, exact: of each vector to all centroids, or to those that its row of ``which`` names."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * most * most * centroids.shape[1] < 1 << 53 else np.int64  # in doubles all sums are exact, or whole numbers are used
    v, c = vectors.astype(kind), centroids.astype(kind)
    if which is None:
        out = np.empty((len(v), len(c)), np.int64)
        for i in range(0, len(v), 2048):
            some = v[i : i + 2048]
            out[i : i + 2048] = (some * some).sum(1)[:, None] - 2 * (some @ c.T) + (c * c).sum(1)
        return out
    out = np.empty(which.shape, np.int64)
    for i in range(0, len(v), 2048):
        apart = v[i : i + 2048, None, :] - c[which[i : i + 2048]]
        out[i : i + 2048] = (apart * apart).sum(2)
    return out


def ordered(numbers: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row by distance, then number."""
    order = np.lexsort((numbers, distances), axis=1)
    return np.take_along_axis(numbers, order, 1), np.take_along_axis(distances, order, 1)


def assigned(vectors: np.ndarray, old: np.ndarray | None, now: Round) -> tuple[np.ndarray, int, int]:
    """New states, how many bounds were used at the most, and how many distances were measured."""
    n, k, keep = len(vectors), len(now.centroids), now.keep
    new = np.zeros(n, state_type(keep))
    root = lambda d: np.sqrt(d.astype(np.float64))

    def rescan(rows: np.ndarray) -> None:
        near, far = ordered(np.broadcast_to(np.arange(k), (len(rows), k)), measured(vectors[rows], now.centroids))
        new["cluster"][rows], new["distance"][rows] = near[:, 0], far[:, 0]
        new["upper"][rows] = root(far[:, 0]) * (1 + SLACK)
        new["near"][rows] = near[:, 1 : keep + 1]
        new["lower"][rows] = root(far[:, 1 : keep + 1]) * (1 - SLACK)
        new["rest"][rows] = root(far[:, keep + 1]) * (1 - SLACK) if k > keep + 1 else np.inf

    if old is None:
        rescan(np.arange(n))
        return new, 0, n * k
    cluster, upper = old["cluster"], (old["upper"] + now.moved[old["cluster"]]) * (1 + SLACK)
    far = now.moved.max(initial=0)
    lower = (old["lower"] - now.moved[old["near"]]) * (1 - SLACK) - SLACK
    rest = (old["rest"] - far) * (1 - SLACK) - SLACK
    # what bounds the z-th bounds all behind it: the least of those from z on, and of the rest
    least = np.minimum.accumulate(np.concatenate([lower, rest[:, None]], 1)[:, ::-1], axis=1)[:, ::-1]
    new["cluster"], new["upper"] = cluster, upper
    new["near"], new["lower"] = old["near"][:, :keep], lower[:, :keep]
    new["rest"] = rest if keep == now.kept else least[:, keep]
    new["distance"] = old["distance"]
    # the column is only read after the last round: what wasn't measured then is measured there
    new["distance"][:] = -1
    doubt = np.flatnonzero(upper >= least[:, 0])
    own = measured(vectors[doubt], now.centroids, cluster[doubt][:, None])[:, 0]
    new["distance"][doubt], new["upper"][doubt] = own, root(own) * (1 + SLACK)
    count = len(doubt)
    # z: so many of the next nearest can't be ruled out; past the last bound, none can
    ruled = new["upper"][doubt][:, None] < least[doubt]
    z = np.where(ruled.any(1), ruled.argmax(1), now.kept + 1)
    used = int(z[z <= now.kept].max(initial=0))
    for many in np.unique(z[(z > 0) & (z <= now.kept)]).tolist():
        rows, mine = doubt[z == many], own[z == many]
        some = measured(vectors[rows], now.centroids, old["near"][rows, :many])
        count += some.size
        near, dist = ordered(np.concatenate([cluster[rows][:, None], old["near"][rows, :many]], 1), np.concatenate([mine[:, None], some], 1))
        new["cluster"][rows], new["distance"][rows] = near[:, 0], dist[:, 0]
        new["upper"][rows] = root(dist[:, 0]) * (1 + SLACK)
        stay = min(many, keep)
        new["near"][rows, :stay] = near[:, 1 : stay + 1]
        new["lower"][rows, :stay] = root(dist[:, 1 : stay + 1]) * (1 - SLACK)
        if many > keep:  # measured, but no longer kept by number
            new["rest"][rows] = np.minimum(least[rows, many], root(dist[:, keep + 1]) * (1 - SLACK))
    rows = doubt[z > now.kept]
    rescan(rows)
    return new, used, count + len(rows) * k


def sums_of(vectors: np.ndarray, clusters: np.ndarray, k: int) -> np.ndarray:
    """A row a cluster: how many vectors, then the sum of each component."""
    out = np.zeros((k, vectors.shape[1] + 1), np.int64)
    order = np.argsort(clusters, kind="stable")
    first = np.flatnonzero(np.diff(clusters[order], prepend=-1))
    if len(order):
        out[clusters[order][first]] = np.add.reduceat(np.concatenate([np.ones((len(order), 1), np.int64), vectors[order]], 1), first, axis=0)
    return out


def column(values: np.ndarray) -> pa.Array:
    """Rows of equal width as binary values."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(-1)
    width = len(flat) // len(values) if len(values) else 0
    ends = pa.py_buffer(np.arange(0, len(flat) + 1, width, dtype=np.int32) if width else np.zeros(1, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(values), [None, ends, pa.py_buffer(flat)])


def values_of(binary: pa.Array, kind: np.dtype) -> np.ndarray:
    """The values of a binary column of equal width."""
    if not len(binary):
        return np.empty(0, kind)
    ends = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1]
    return np.frombuffer(binary.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)


def by_round(rows: DataFrame, now: Round, size: int, first: bool, last: bool) -> DataFrame:
    """vec_id, the vector, its new state, and on a batch's first row what its clusters have won and lost (in the last round: their inertia).

    ``rows``: vec_id and ``parts`` (an array) in the first round, else this function's result."""
    vec_id = rows.schema["vec_id"].dataType
    kept = state_type(now.kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if first:
                vectors, old = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, size), None
            else:
                vectors, old = values_of(batch.column(1), np.dtype("<i4")).reshape(n, size).astype(np.int64), values_of(batch.column(2), kept)
            new, used, count = assigned(vectors, old, now)
            k = len(now.centroids)
            if last:
                some = np.flatnonzero(new["distance"] < 0)
                new["distance"][some] = measured(vectors[some], now.centroids, new["cluster"][some][:, None])[:, 0]
                told = np.zeros((k, 2), np.int64)
                np.add.at(told, (new["cluster"], 0), 1)
                np.add.at(told, (new["cluster"], 1), new["distance"])
            elif first:
                told = sums_of(vectors, new["cluster"], k)
            else:
                went = new["cluster"] != old["cluster"]
                told = sums_of(vectors[went], new["cluster"][went], k) - sums_of(vectors[went], old["cluster"][went], k)
            changes = pa.array([np.concatenate([[used, count], told.reshape(-1)]).astype("<i8").tobytes(), *[None] * (n - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column(vectors.astype("<i4")), column(new), changes], names=["vec_id", "vector", "state", "changes"])
        release()

    return rows.mapInArrow(run, T.StructType([T.StructField("vec_id", vec_id), *(T.StructField(c, T.BinaryType()) for c in ("vector", "state", "changes"))]))


def summed(written: DataFrame, k: int, width: int) -> tuple[np.ndarray, int, int]:
    """All batches' changes, added up: a row a cluster and task meets in Spark's aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * width, np.int64)
        used = count = 0
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                told = np.frombuffer(payload, "<i8")
                used, count, total = max(used, int(told[0])), count + int(told[1]), total + told[2:]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(-1, k), pa.int32()), "numbers": pa.array([[used, count], *total.reshape(k, width).tolist()], pa.list_(pa.int64()))})

    each = written.where("changes is not null").select("changes").mapInArrow(run, "cluster int, numbers array<bigint>")
    numbers = each.select("cluster", F.posexplode("numbers").alias("at", "number"))
    # sums are wider than what is summed; an inertia beyond 64 bits is cut to them
    told = numbers.groupBy("cluster", "at").agg(F.sum(F.col("number").cast("decimal(38,0)")).alias("n"), F.max("number").alias("most")).collect()
    out, used, count = np.zeros((k, width), np.int64), 0, 0
    for r in told:
        if r["cluster"] >= 0:
            out[r["cluster"], r["at"]] = max(min(int(r["n"]), 2**63 - 1), -(2**63))
        elif r["at"] == 0:
            used = int(r["most"])
        else:
            count = int(r["n"])
    return out, used, count


def whole_vectors(vectors: DataFrame, size: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and ``parts``, floor(256 x) of each component, of the vectors that take part."""
    x = F.col(f"`{embedding}`")
    wide = F.transform(x, lambda v: v.cast("double"))
    good = (F.size(x) == size) & F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(wide, lambda v: F.floor(F.greatest(F.least(v * 256, F.lit(float(MOST))), F.lit(float(-MOST)))))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{vec_id}`").alias("vec_id"), whole.alias("parts"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of ``salt``, a colon and the id; of equal hashes those with smaller components come first."""
    said = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["parts"] for r in rows.orderBy(said, "parts").limit(k).select("parts").collect()], np.int64)


def cluster_vectors(vectors: DataFrame, k: int, size: int, rounds: int, salt: str = "2", bounds: int | None = None, seen: list | None = None) -> DataFrame:
    """A row a vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    ``rounds`` rounds of assigning and moving to the mean's floor, then one more assignment. ``bounds``: lower bounds
    a vector begins with, a quarter of ``k`` if not said. ``seen`` gets the number of distances measured in each round.
    """
    spark: SparkSession = vectors.sparkSession
    rows = whole_vectors(vectors, size)
    centroids = first_centroids(rows, k, salt)
    schema = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), *T._parse_datatype_string("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").fields])
    if not len(centroids):
        return spark.createDataFrame([], schema)
    n = len(centroids)
    kept = min(n - 1, bounds if bounds is not None else max(n // 4, 1))
    fewest = kept // 2
    now = Round(centroids, np.zeros(n), kept, kept)
    sums = np.zeros((n, size + 1), np.int64)
    at, before = f"{shared_folder(spark)}/centroids-{uuid.uuid4().hex}", None
    for r in range(rounds + 1):
        last = r == rounds
        path = f"{at}/{r}"
        by_round(rows, now, size, r == 0, last).write.parquet(path)
        rows = spark.read.parquet(path)
        told, used, count = summed(rows, n, 2 if last else size + 1)
        if seen is not None:
            seen.append(count)
        if before:
            forget(spark, before)
        before = path
        if not last:
            sums += told
            some = sums[:, 0] > 0
            moved_to = now.centroids.copy()
            moved_to[some] = sums[some, 1:] // sums[some, :1]
            apart = (moved_to - now.centroids).astype(np.float64)
            keep = now.keep if r == 0 else min(now.keep, max(fewest, used))
            now = Round(moved_to, np.sqrt((apart * apart).sum(1)) * (1 + SLACK), now.keep, keep)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now.centroids]
    of_all = min(sum(int(x) for x in told[:, 1]), 2**63 - 1)
    about = spark.createDataFrame([(c, int(told[c, 1]), of_all, digests[c]) for c in range(n)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    where = state_type(now.keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = values_of(batch.column(1), where)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(state["cluster"]), pa.array(state["distance"])], names=["vec_id", "cluster", "distance"])

    out = rows.select("vec_id", "state").mapInArrow(read, T.StructType(schema.fields[:3]))
    return out.join(F.broadcast(about), "cluster").select(*schema.names)  # a row a centroid

