"""Statistics of an index and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import text as T

TIERS = ["core", "secondary", "peripheral"]
#: Languages that tags may name, for an index without signatures.
TAG_LANGUAGES = "python javascript typescript go rust java ruby c cpp".split()


def module_distribution(modules: DataFrame, files: DataFrame) -> DataFrame:
    """modules(ord, module, tier), files(module, n_sigs) -> module, tier, file_count, sig_count. Files are summed before the join."""
    sums = files.groupBy("module").agg(F.count("*").alias("file_count"), F.sum("n_sigs").alias("sig_count"))
    zero = {"file_count": 0, "sig_count": 0}
    return modules.select("ord", "module", "tier").join(sums, "module", "left").fillna(zero).select("ord", "module", "tier", "file_count", "sig_count").orderBy(F.desc("file_count"), "ord")


def tag_frequency(files: DataFrame) -> DataFrame:
    """files(ord, tags) -> tag, n, first: most frequent first, then as first seen."""
    seen = files.select("ord", F.explode("tags").alias("tag"))
    return seen.groupBy("tag").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first", "tag")


def tier_histogram(modules: DataFrame) -> DataFrame:
    """modules(tier) -> one row for each known tier; other tiers don't count."""
    known = modules.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return known.join(modules.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").fillna({"n": 0})


def top_files(files: DataFrame, n: int = 5) -> DataFrame:
    return files.orderBy(F.desc("n_sigs"), "path").limit(n).select("path", F.col("n_sigs").alias("sig_count"), "module")


def totals(files: DataFrame) -> DataFrame:
    named = F.when(F.col("module") != "", F.col("module"))
    return files.agg(F.count("*").alias("total_files"), F.count_distinct(named).alias("total_modules"), F.coalesce(F.sum("n_sigs"), F.lit(0)).alias("total_signatures"))


def primary_language(files: DataFrame) -> DataFrame:
    """files(ord, lang) -> the most frequent language, the first seen of equals; unknown without any."""
    counts = files.where("lang is not null and lang <> ''").groupBy("lang").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.agg(F.coalesce(F.max_by("lang", F.struct("n", -F.col("first"))), F.lit("unknown")).alias("primary_lang"))


def primary_language_of_tags(files: DataFrame) -> DataFrame:
    """files(ord, tags) -> as ``primary_language`` from tags that name one of nine languages."""
    return primary_language(files.select("ord", F.explode("tags").alias("lang")).where(F.lower("lang").isin(TAG_LANGUAGES)))


def series(snapshots: DataFrame, value: str) -> DataFrame:
    """snapshots(snapshot_id, value) -> with low, high and the sparkline's cell of each snapshot, and first and last of the series."""
    every = Window.partitionBy()
    in_order = Window.orderBy("snapshot_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, high = F.min(value).over(every), F.max(value).over(every)
    return snapshots.select("snapshot_id", value, T.spark_cell(F.col(value), low, high).alias("cell"), F.first(value).over(in_order).alias("first"), F.last(value).over(in_order).alias("last"))


def sparkline(snapshots: DataFrame, value: str) -> DataFrame:
    """One row: the series' sparkline and its ends. Empty under two snapshots."""
    cells = series(snapshots, value)
    drawn = cells.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("snapshot_id", "cell"))), lambda s: s["cell"]), "").alias("line"), F.max("first").alias("first"), F.max("last").alias("last"))
    return drawn.select("n", F.when(F.col("n") >= 2, F.col("line")).otherwise("").alias("line"), "first", "last")


def bars(modules: DataFrame, width: int = 30) -> DataFrame:
    """modules(module, file_count) -> module, line: a bar as long as the share of the largest."""
    most = F.max("file_count").over(Window.partitionBy())
    line = F.concat(F.lit("  "), F.rpad("module", 20, " "), F.lit(" "), T.bar(F.col("file_count"), F.col("most"), width), F.lit(" "), F.col("file_count").cast("string"))
    return modules.withColumn("most", most).select("module", line.alias("line"))
