"""Module scores, roles and tiers: one shuffle, by module, with partial aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import roles as R

CODE, FILES, ROLE = 0.45, 0.10, 0.45


def majority(counts: list[tuple[Column, str]]) -> Column:
    """The name of the largest count; the first of equals. Counts must stand in order of priority."""
    most = F.greatest(*[c for c, _ in counts])
    return reduce(lambda out, cn: F.when(cn[0] == most, cn[1]).otherwise(out), reversed(counts), F.lit(counts[0][1]))


def module_scores(files: DataFrame) -> DataFrame:
    """files(path, module, tags, n_sigs) -> module, file_count, sig_count, core_score, tier, role, test_ratio.

    Files without a module count in the totals alone.
    """
    told = files.select("module", "n_sigs", R.role_bonus(F.col("tags")).alias("bonus"), R.file_role(F.col("path"), F.col("tags")).alias("role"))
    votes = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in R.ROLE_ORDER]
    by = told.groupBy("module").agg(F.count("*").alias("file_count"), F.sum("n_sigs").alias("sig_count"), F.avg("bonus").alias("bonus"), *votes)
    every = Window.partitionBy()  # over the modules, not over the files
    total_files, total_sigs = F.sum("file_count").over(every), F.sum("sig_count").over(every)
    share = F.coalesce(F.col("sig_count") / F.nullif(F.col("total_sigs"), F.lit(0)), F.lit(0.0))
    score = F.least(F.lit(1.0), CODE * share + FILES * F.col("file_count") / F.col("total_files") + ROLE * F.col("bonus"))
    scored = by.withColumn("total_files", total_files).withColumn("total_sigs", total_sigs).where("module <> ''").withColumn("score", score)
    ratio = F.col("n_test") / F.col("file_count")
    return scored.select(
        "module",
        "file_count",
        "sig_count",
        F.round("score", 4).alias("core_score"),
        R.tier(F.col("score"), ratio).alias("tier"),
        majority([(F.col(f"n_{r}"), r) for r in R.ROLE_ORDER]).alias("role"),
        F.round(ratio, 6).alias("test_ratio"),
    )


def file_priors(files: DataFrame, scores: DataFrame) -> DataFrame:
    """files(path, module), scores(module, core_score) -> path, prior; priors add up to 1, unknown modules weigh 1."""
    joined = files.select("path", "module").join(scores.select("module", "core_score"), "module", "left")
    weighed = joined.select("path", F.coalesce("core_score", F.lit(1.0)).alias("weight"))
    total = weighed.agg(F.sum("weight").alias("total"))
    return weighed.join(F.broadcast(total)).select("path", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(F.col("weight")).alias("prior"))
