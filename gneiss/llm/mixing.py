"""Mixing sources to target weights by a low-discrepancy schedule, with Spark expressions only.

Targets. Sources in code-point order (null last) weigh 1, 2, 3, 1, ...; they share the words of all
documents by weight, a target stops at ``most`` times its source's size, and the excess goes to the
others. Sorted by (cap / weight) the level at which all fits has a closed form over running sums.

Schedule. Slot k of the mix has the golden-ratio point k * phi mod 1; the source whose stretch of
the cumulative weights holds the point gives the slot's block. Slots are ranked per source, and slot
r takes the r-th block of equal length from the source's stream: its documents in shuffled order,
again and again. A stream ends at its target, so a document is taken ``most`` times at the most.

The schedule is a fiftieth longer than the mix, so that a source's slots, of which a golden-ratio
schedule may give it a few too few, reach its target; slots beyond the target find no block.

Scale. Slots are spread by point and ranked in stretches of 65,536 slots; streams are laid out in
4,096 hash buckets a source and joined on (source, block), so no source is met in one task. Block
length is a 65,536th of all words, between 1 and ``block`` words.

Defined results: null text has size 0; a document of size 0 has taken 0; a null doc_id is a document;
repeated rows are documents of their own; an empty table gives no row. Shuffling goes by md5 of the
doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import cut, word_count

BUCKET_HEX = 3
STRETCH = 65_536
CELLS = 65_536
#: Fixed value: 2**32 over the golden ratio, the odd multiplier of Fibonacci hashing.
GOLDEN = 2_654_435_769


def source_targets(sized: DataFrame, most: int = 3) -> DataFrame:
    """(source, size) -> one row a source: key, source_size, target, quota (the target in whole words), before, total."""
    by = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % 3 + 1)
    every = Window.partitionBy()
    full = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    down = full.rowsBetween(0, Window.unboundedFollowing)
    up = full.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0))) / F.sum("weight").over(down))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .withColumn("quota", F.least(F.round("target").cast("long"), F.col("cap")))
    )
    before = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    return levels.select(
        "key", "source_size", "target", "quota", F.coalesce(F.sum("quota").over(before), F.lit(0)).alias("before"), F.sum("quota").over(every).alias("total")
    )


def golden_point(k: Column) -> Column:
    """Slot number -> its golden-ratio point in [0, 1), on a grid of 2**32 (which it visits evenly, period by period)."""
    low = k % (1 << 32)
    high = F.floor(low / 65_536)
    return ((high * GOLDEN % (1 << 32)) * 65_536 + (low % 65_536) * GOLDEN) % (1 << 32) / float(1 << 32)


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """Slots of the mix: key, block (the slot's rank among those of its source)."""
    spark = targets.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    low, high = F.col("before") / F.col("total"), (F.col("before") + F.col("quota")) / F.col("total")
    cells = (
        targets.where("quota > 0")
        .select("key", low.alias("low"), high.alias("high"))
        .select("key", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))).alias("cell"))
    )
    dealt = (
        points.withColumn("cell", F.floor(F.col("point") * CELLS))
        .join(cells, "cell")
        .where("point >= low and point < high")
        .select("key", "slot", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    )
    counts = dealt.groupBy("key", "stretch").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("key", "stretch").orderBy("slot")
    return (
        dealt.withColumn("rank", F.row_number().over(within) - 1)
        .join(starts, ["key", "stretch"])
        .select("key", (F.col("start") + F.col("rank")).alias("block"))
    )


def mix_sources(docs: DataFrame, most: int = 3, block: int = 128) -> DataFrame:
    """(doc_id, source, text) -> doc_id, size, source_size, target, taken, and source for joins. One row a document; those without an id are shuffled by their text."""
    spelled = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit(""))))
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("key"),
            word_count(F.col("text")).alias("size"),
            F.md5(spelled.cast("binary")).alias("order"),
        )
    )
    targets = cut(source_targets(sized.select("key", F.col("source").cast("string").alias("source"), "size"), most))
    told = targets.agg(F.max("total").alias("total"), F.count("*").alias("n")).first()
    total, n = told["total"] or 0, told["n"]
    step = max(1, min(block, total // 65_536))
    slots = schedule(targets, -(-total // step) + total // step // 50 + 4 * n)

    shuffled = sized.withColumn("bucket", F.substring("order", 1, BUCKET_HEX))
    sums = shuffled.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size")
    laid = (
        shuffled.withColumn("nth", F.row_number().over(within))
        .withColumn("start", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(bases, ["key", "bucket"])
        .withColumn("start", F.col("start") + F.col("base"))
        .join(targets.select("key", "source_size", "target", "quota"), "key")
    )
    rounds = F.when((F.col("size") > 0) & (F.col("start") < F.col("quota")), F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1 - F.col("start")) / F.greatest("source_size", F.lit(1)))))
    placed = (
        laid.withColumn("round", F.explode_outer(rounds))
        .withColumn("from", F.col("round") * F.col("source_size") + F.col("start"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
        .withColumn("block", F.explode_outer(F.when(F.col("to") > F.col("from"), F.sequence(F.floor(F.col("from") / step), F.floor((F.col("to") - 1) / step)))))
        .withColumn("words", F.least(F.col("to"), (F.col("block") + 1) * step) - F.greatest(F.col("from"), F.col("block") * step))
    )
    row = ["doc_id", "source", "size", "source_size", "target", "key", "bucket", "nth"]
    return (
        placed.join(slots.withColumn("taken", F.lit(True)), ["key", "block"], "left")
        .groupBy(*row)
        .agg(F.coalesce(F.sum(F.when(F.col("taken"), F.col("words"))), F.lit(0)).cast("long").alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
