"""Places and running sums in an order, without a task that sorts or sums all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.plans.lineage import cut


def ranges(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` dealt into sorted ranges, kept as they are: with ``_part``, the range, and ``_nth``, the place in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return cut(dealt.withColumn("_part", F.shiftright("_id", 33)).withColumn("_nth", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their ``place`` in the order, from 0: sorted in ranges, and each range begins where those before it end."""
    dealt = ranges(rows, order)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a range, whatever the rows.
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def running(rows: DataFrame, by: list[str], order: list[Column], cost: str) -> DataFrame:
    """``rows`` with ``used``, the sum of costs up to a row in its group, and ``nth``, its place in it from 1.

    A group that lies in several ranges is summed in each of them; what ranges before add is a row a group and range.
    """
    dealt = ranges(rows, [*map(F.col, by), *order])
    within = Window.partitionBy("_part", *by).orderBy("_nth")
    sums = dealt.groupBy("_part", *by).agg(F.sum(cost).alias("_cost"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_by{i}" for i in range(len(by))]
    starts = sums.select(F.col("_part").alias("_at"), *(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.coalesce(F.sum("_cost").over(earlier), F.lit(0)).alias("_cost"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"))
    same = dealt["_part"] == starts["_at"]
    for b, n in zip(by, names, strict=True):
        same = same & dealt[b].eqNullSafe(starts[n])
    ran = dealt.withColumn("used", F.sum(cost).over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(within))
    met = ran.join(starts, same)
    return met.withColumn("used", F.col("used") + F.col("_cost")).withColumn("nth", F.col("nth") + F.col("_rows")).drop("_part", "_nth", "_at", "_cost", "_rows", *names)
