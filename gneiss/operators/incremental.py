"""Recomputing what changed: content hashes against a cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import text as T

MOST_SHARE, MOST_FILES = 0.3, 100


def hashed(rows: DataFrame, parts: list[str], name: str = "hash") -> DataFrame:
    """rows with the hash of their parts, joined by ``|`` (arrays by commas, sorted)."""
    kinds = dict(rows.dtypes)
    told = [F.array_join(F.array_sort(p), ",") if kinds[p].startswith("array") else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    return rows.withColumn(name, T.content_hash(F.concat_ws("|", *told)))


def delta(now: DataFrame, cached: DataFrame, key: str = "path") -> DataFrame:
    """now(key, hash), cached(key, hash) -> key, change: added, changed, removed, same."""
    met = now.select(key, F.col("hash").alias("new")).join(cached.select(key, F.col("hash").alias("old")), key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return met.select(key, change.alias("change"))


def plan(changes: DataFrame) -> DataFrame:
    """One row: how many changed, and whether to reuse all, recompute in part, or in full."""
    n = changes.agg(F.count_if(F.col("change") != "removed").alias("files"), F.count_if(F.col("change").isin("added", "changed")).alias("delta"), F.count_if(F.col("change") == "removed").alias("removed"))
    share = F.col("delta") / F.greatest("files", F.lit(1))
    mode = F.when((F.col("delta") == 0) & (F.col("removed") == 0), "reuse").when((share < MOST_SHARE) & (F.col("delta") < MOST_FILES) & (F.col("removed") == 0), "partial").otherwise("full")
    return n.withColumn("mode", mode)


def reuse(now: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "path") -> DataFrame:
    """now(key, hash, ...), cache(key, hash, result) -> key, hash, result: cached where the hash holds, else computed.

    ``compute`` gets the rows that missed and returns key, hash, result.
    """
    hits = now.select(key, "hash").join(cache, [key, "hash"])
    misses = now.join(cache.select(key, "hash"), [key, "hash"], "left_anti")
    return hits.select(key, "hash", "result").unionByName(compute(misses).select(key, "hash", "result"))


def input_hash(rows: DataFrame, parts: list[str], by: list[str] | None = None) -> DataFrame:
    """One hash of a group's lines, whatever their order: a tree of hashes.

    Each line is hashed where it stands; digests are hashed together, sorted, by their first four digits, and those 65,536
    in turn. So what is gathered is a 65,536th of a group's digests, then a hash for each of these.
    """
    kinds = dict(rows.dtypes)
    told = [F.array_join(F.array_sort(p), ",") if kinds[p].startswith("array") else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]
    lines = rows.select(*(by or []), F.sha2(F.concat_ws("|", *told), 256).alias("_line"))

    def joined(column: str) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "\n"), 256)

    leaves = lines.groupBy(*(by or []), F.substring("_line", 1, 4).alias("_leaf")).agg(joined("_line").alias("_hash"))
    return leaves.withColumn("_hash", F.concat("_leaf", "_hash")).groupBy(*(by or [])).agg(joined("_hash").substr(1, 16).alias("hash"))


def chain(files: DataFrame) -> DataFrame:
    """files(path, module, hash) -> stage, key, hash: a file's hash, a module's over its files', the project's over its modules'.

    Whatever a stage computes depends on what is hashed below it, and on nothing else.
    """
    of_files = files.select(F.lit("file").alias("stage"), F.col("path").alias("key"), "hash", "module")
    modules = input_hash(files.where("module <> ''"), ["path", "hash"], ["module"])
    project = input_hash(modules, ["module", "hash"])
    return (
        of_files.select("stage", "key", "hash")
        .unionByName(modules.select(F.lit("module").alias("stage"), F.col("module").alias("key"), "hash"))
        .unionByName(project.select(F.lit("project").alias("stage"), F.lit("").alias("key"), "hash"))
    )


def stale(now: DataFrame, cached: DataFrame) -> DataFrame:
    """now(stage, key, hash), cached likewise -> stage, key, hash, verdict: reuse, recompute or drop."""
    met = now.join(cached.select("stage", "key", F.col("hash").alias("was")), ["stage", "key"], "full_outer")
    verdict = F.when(F.col("hash").isNull(), "drop").when(F.col("was") == F.col("hash"), "reuse").otherwise("recompute")
    return met.select("stage", "key", "hash", verdict.alias("verdict"))
