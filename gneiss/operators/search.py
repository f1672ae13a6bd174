"""Search by tags and pattern: scored files, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS, PATTERN = 0.6, 0.4


def tag_score(tags: Column, wanted: list[str]) -> Column:
    asked = sorted(set(wanted))
    return F.size(F.array_intersect(tags, F.array(*map(F.lit, asked)))) / F.lit(len(asked))


def scored(files: DataFrame, tags: list[str] | None = None, pattern: str | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """files(path, desc, tags, module), signatures(path, name) -> the files with ``score``, all of them.

    A pattern scores 1.0 in the path, 0.7 in the description, 0.5 in a signature's name. Names are
    filtered before they meet the files, so the join carries matching paths only.
    """
    pattern = pattern if pattern and pattern.strip() else None
    of_tags = tag_score(F.col("tags"), tags) if tags else F.lit(0.0)
    of_pattern = F.lit(0.0)
    if pattern:
        p = F.lit(pattern.lower())
        named = F.lit(False)
        if signatures is not None:
            hits = signatures.where(F.contains(F.lower("name"), p)).select("path").distinct().withColumn("_named", F.lit(True))
            files = files.join(hits, "path", "left")
            named = F.coalesce("_named", F.lit(False))
        of_pattern = F.when(F.contains(F.lower("path"), p), 1.0).when(F.contains(F.lower(F.coalesce("desc", F.lit(""))), p), 0.7).when(named, 0.5).otherwise(0.0)
    score = TAGS * of_tags + PATTERN * of_pattern if tags and pattern else of_tags if tags else of_pattern
    return files.withColumn("score", score).drop("_named")


def search(files: DataFrame, tags: list[str] | None = None, pattern: str | None = None, signatures: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The ``limit`` best with a score, ties by path: path, desc, score, tags, module. A top-k without a full sort."""
    best = scored(files, tags, pattern, signatures).where("score > 0").orderBy(F.desc("score"), "path").limit(limit)
    return best.select("path", "desc", "score", "tags", "module")
