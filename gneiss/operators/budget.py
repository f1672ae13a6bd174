"""Selection under a token budget."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import ordered

CHUNK = 10_000


def stop_at_overflow(rows: DataFrame, order: Iterable[Column], cost: str, budget: int, by: list[str] | None = None) -> DataFrame:
    """The longest run of rows from the first on that fits: a running sum, with ``used`` and ``nth``. Summed in ranges of the order, however large a group is."""
    return ordered.running(rows, by or [], list(order), cost).where(F.col("used") <= budget)


def capped(rows: DataFrame, order: Iterable[Column], cost: str, budget: int, cap: int) -> DataFrame:
    """The first ``cap`` rows, up to the first that doesn't fit: with ``used`` and ``nth``. What is summed is the distributed top ``cap``."""
    order = list(order)
    first = rows.orderBy(*order).limit(max(cap, 0)).withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    return first.withColumn("used", F.sum(cost).over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)


def skip_overflow(rows: DataFrame, key: str, order: list[tuple[str, bool]], cost: str, budget: int, chunk: int = CHUNK) -> DataFrame:
    """Rows in order, each taken if it still fits: with ``rank``, those taken.

    ``order``: names and whether they descend, ``key`` last to break ties. Whether a row fits depends on all
    before it, so the walk is sequential; but it need not see rows that cost more than is left, and what
    is taken can't number more than the budget. So the walk asks Spark for the next ``chunk`` rows that could fit
    (a distributed top-k of key and cost alone), takes what fits, and goes on behind the last.
    """
    spark = rows.sparkSession
    names = [n for n, _ in order]
    slim = rows.select(*(c for c in dict.fromkeys([*names, key]) if c != cost), F.greatest(F.coalesce(F.col(cost), F.lit(1)), F.lit(1)).alias(cost))
    sort = [F.desc(n) if down else F.asc(n) for n, down in order]
    taken: list[tuple] = []
    left, last = budget, None
    while left > 0:
        next_rows = slim.where(F.col(cost) <= left)
        if last is not None:
            next_rows = next_rows.where(_behind(order, last))
        got = next_rows.orderBy(*sort).limit(chunk).collect()
        for r in got:
            if r[cost] <= left:
                left -= r[cost]
                taken.append((r[key], len(taken) + 1))
        if len(got) < chunk:
            break
        last = got[-1]
    kind = rows.schema[key].dataType.simpleString()
    return rows.join(spark.createDataFrame(taken, f"{key} {kind}, rank int"), key)


def _behind(order: list[tuple[str, bool]], last) -> Column:
    test, same = F.lit(False), F.lit(True)
    for n, down in order:
        test = test | (same & ((F.col(n) < F.lit(last[n])) if down else (F.col(n) > F.lit(last[n]))))
        same = same & (F.col(n) == F.lit(last[n]))
    return test


def tier_budgets(budget: int) -> dict[int, int]:
    return {1: int(budget * 0.5), 2: int(budget * 0.4), 3: int(budget * 0.1)}


def by_tier(rows: DataFrame, key: str, budget: int, cost: str = "cost", rank: str = "score") -> DataFrame:
    """rows(key, tier, rank, cost) -> those taken within each tier's share of the budget."""
    parts = [skip_overflow(rows.where(F.col("tier") == t), key, [(rank, True), (key, False)], cost, b) for t, b in tier_budgets(budget).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hybrid_key(score: Column, cost: Column) -> Column:
    """Score with a share for score a token."""
    return 0.7 * score + 0.3 * F.least(score / F.greatest(cost, F.lit(1)) / 0.01, F.lit(1.0))


def batches(rows: DataFrame, group: str, order: str, size: str, most_rows: int = 32, most_size: int = 8_000) -> DataFrame:
    """rows -> group, order, size and ``batch``: next-fit batches by count and size within each group.

    Which batch a row opens depends on all before it, so a queue is walked in order; but the walk holds three
    numbers, not the queue: rows stream through it sorted, and no group is gathered.
    """
    slim = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    schema = slim.schema.add("batch", "integer")

    def walk(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, n, used = object(), 0, 0, 0
        for part in parts:
            out = []
            for g, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                s = s or 0
                if g != now:
                    now, batch, n, used = g, 0, 0, 0
                if n and (n >= most_rows or used + s > most_size):
                    batch, n, used = batch + 1, 0, 0
                n, used = n + 1, used + s
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int32())], names=["g", "o", "s", "batch"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slim.repartition(parts, "g").sortWithinPartitions("g", "o").mapInArrow(walk, schema).toDF(group, order, size, "batch")


def role_budgets(budget: int, present: set[str]) -> dict[str, int]:
    """Shares of source, tests, config and docs; what absent roles leave goes to source with the elastic tenth."""
    shares = {"source": 0.70, "test": 0.10, "config": 0.05, "docs": 0.05}
    out = {r: int(budget * s) for r, s in shares.items() if r in present or r == "source"}
    spare = int(budget * 0.10) + sum(int(budget * s) for r, s in shares.items() if r not in out)
    return out | {"source": out["source"] + spare}
