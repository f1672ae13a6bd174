"""What changed between two versions of an index: full outer joins by key, and modules matched by shared files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.plans.lineage import cut

ALIKE = 0.3


def both(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, module, tags) twice -> path, old_module, new_module, old_tags, new_tags, in_old, in_new: one full outer join for all file changes."""
    a = old.select("path", F.col("module").alias("old_module"), F.col("tags").alias("old_tags"), F.lit(True).alias("in_old"))
    b = new.select("path", F.col("module").alias("new_module"), F.col("tags").alias("new_tags"), F.lit(True).alias("in_new"))
    return a.join(b, "path", "full_outer").fillna(False, ["in_old", "in_new"])


def file_changes(old: DataFrame, new: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """path, change (added, removed, moved), old_module, new_module. A file whose module was renamed hasn't moved."""
    met = both(old, new)
    if renames is not None:
        met = met.join(renames.select(F.col("old_id").alias("old_module"), F.col("new_id").alias("_renamed")), "old_module", "left")
        met = met.withColumn("_renamed", F.coalesce("_renamed", "old_module"))
    else:
        met = met.withColumn("_renamed", F.col("old_module"))
    change = F.when(~F.col("in_old"), "added").when(~F.col("in_new"), "removed").when(F.col("_renamed") != F.col("new_module"), "moved")
    return met.withColumn("change", change).where("change is not null").select("path", "change", "old_module", "new_module")


def tag_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, added, removed: sorted tags, of files in both that differ."""
    met = both(old, new).where("in_old and in_new")
    added, removed = F.array_sort(F.array_except("new_tags", "old_tags")), F.array_sort(F.array_except("old_tags", "new_tags"))
    return met.select("path", added.alias("added"), removed.alias("removed")).where((F.size("added") > 0) | (F.size("removed") > 0))


def module_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_module, new_module, in_old, in_new, n, tagged: all file changes by pair of modules, from one full outer join of the files."""
    met = both(old, new)
    differs = F.col("in_old") & F.col("in_new") & ((F.size(F.array_except("new_tags", "old_tags")) > 0) | (F.size(F.array_except("old_tags", "new_tags")) > 0))
    return met.groupBy("old_module", "new_module", "in_old", "in_new").agg(F.count("*").alias("n"), F.count_if(differs).alias("tagged"))


def pair_likeness(pairs: DataFrame) -> DataFrame:
    """``module_pairs`` -> old_id, new_id, shared, jaccard of modules that share a file."""
    named = lambda side: pairs.where(f"in_{side} and {side}_module <> ''").groupBy(F.col(f"{side}_module").alias(f"{side}_id")).agg(F.sum("n").alias(f"n_{side}"))
    shared = pairs.where("in_old and in_new and old_module <> '' and new_module <> ''").select(F.col("old_module").alias("old_id"), F.col("new_module").alias("new_id"), F.col("n").alias("shared"))
    return shared.join(named("old"), "old_id").join(named("new"), "new_id").select("old_id", "new_id", "shared", (F.col("shared") / (F.col("n_old") + F.col("n_new") - F.col("shared"))).alias("jaccard"))


def module_likeness(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id, shared, jaccard of modules that share a file. Files meet once, by path; all else is on pairs of modules."""
    return pair_likeness(module_pairs(old, new))


def module_matches(old_modules: DataFrame, new_modules: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """old_modules and new_modules(ord, module) -> old_id, new_id, jaccard.

    Old modules choose in order, each the likest new one that none has chosen, from ``ALIKE`` on. A module has
    at most three that alike, so the pairs that the choice folds over are few; it runs on one group.
    """
    return chosen_matches(module_likeness(old, new), old_modules, new_modules)


def chosen_matches(likeness: DataFrame, old_modules: DataFrame, new_modules: DataFrame) -> DataFrame:
    pairs = likeness.where(F.col("jaccard") >= ALIKE)
    pairs = pairs.join(old_modules.select(F.col("module").alias("old_id"), F.col("ord").alias("a")), "old_id").join(new_modules.select(F.col("module").alias("new_id"), F.col("ord").alias("b")), "new_id")
    listed = pairs.agg(F.array_sort(F.collect_list(F.struct("a", (-F.col("jaccard")).alias("unlike"), "b", "old_id", "new_id"))).alias("pairs"))
    none = F.lit(None).cast("array<struct<old_id: string, new_id: string, jaccard: double>>")

    def choose(done, p):
        free = ~F.exists(done, lambda d: (d["old_id"] == p["old_id"]) | (d["new_id"] == p["new_id"]))
        return F.when(free, F.concat(done, F.array(F.struct(p["old_id"].alias("old_id"), p["new_id"].alias("new_id"), (-p["unlike"]).alias("jaccard"))))).otherwise(done)

    chosen = listed.select(F.explode(F.aggregate("pairs", F.coalesce(none, F.array().cast("array<struct<old_id: string, new_id: string, jaccard: double>>")), choose)).alias("m"))
    return chosen.select("m.old_id", "m.new_id", F.round("m.jaccard", 3).alias("jaccard"))


def module_changes(old_modules: DataFrame, new_modules: DataFrame, matches: DataFrame) -> DataFrame:
    """module, change: added and removed modules; matched ones are neither."""
    removed = old_modules.select("module").join(matches.select(F.col("old_id").alias("module")), "module", "left_anti").withColumn("change", F.lit("removed"))
    added = new_modules.select("module").join(matches.select(F.col("new_id").alias("module")), "module", "left_anti").withColumn("change", F.lit("added"))
    return removed.unionByName(added)


def stats_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two frames of one row of totals -> new less old."""
    names = old.columns
    return old.select(*[F.col(c).alias(f"o_{c}") for c in names]).join(new).select(*[(F.col(c) - F.col(f"o_{c}")).alias(c) for c in names])


def magnitude(files: DataFrame, tags: DataFrame, modules: DataFrame) -> DataFrame:
    parts = files.select(F.lit(1).alias("one")).unionByName(tags.select(F.lit(1).alias("one"))).unionByName(modules.select(F.lit(1).alias("one")))
    return parts.agg(F.count("*").alias("change_magnitude"))


def change_magnitude(old: DataFrame, new: DataFrame, old_modules: DataFrame | None = None, new_modules: DataFrame | None = None) -> DataFrame:
    """One row, change_magnitude of two versions of files(path, module, tags): files added, removed and moved, files with other tags, modules added and removed.

    The files meet in one join; what is counted and matched afterwards is a row a pair of modules, kept once. Without their own order modules choose by name.
    """
    pairs = cut(module_pairs(old, new))
    named = lambda side: pairs.where(f"in_{side} and {side}_module <> ''").select(F.col(f"{side}_module").alias("module")).distinct()
    placed = lambda m: m.withColumn("ord", F.row_number().over(Window.orderBy("module")))
    om, nm = (placed(named("old")) if old_modules is None else old_modules), (placed(named("new")) if new_modules is None else new_modules)
    matches = cut(chosen_matches(pair_likeness(pairs), om, nm))
    renamed = matches.select(F.col("old_id").alias("old_module"), F.col("new_id").alias("renamed"))
    moved = F.when(~F.col("in_old") | ~F.col("in_new") | (F.coalesce("renamed", "old_module") != F.col("new_module")), F.col("n")).otherwise(0)
    files = pairs.join(renamed, "old_module", "left").agg(F.coalesce(F.sum(moved + F.col("tagged")), F.lit(0)).alias("n"))
    modules = module_changes(om, nm, matches).agg(F.count("*").alias("n"))
    return files.unionByName(modules).agg(F.sum("n").alias("change_magnitude"))
