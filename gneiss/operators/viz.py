"""Nodes, links, positions and frames for drawings. JSON is made at the sink."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P

# Colours, radii and arcs (degrees) by role and tier.
ROLE_COLOURS = {"core": "#6366F1", "infra": "#A855F7", "interface": "#14B8A6", "test": "#F59E0B", "docs": "#94A3B8"}
TIER_COLOURS = {"core": "#1D4ED8", "secondary": "#0F766E", "peripheral": "#64748B", "unknown": "#D97706"}
TIER_RADII = {"core": 80, "secondary": 180, "peripheral": 280, "unknown": 280}
ROLE_ARCS = {"infra": (0, 120), "interface": (120, 240), "test": (240, 300), "docs": (300, 360)}
CENTER = (400.0, 300.0)


def chosen(of: Column, known: dict[str, object], default: object) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), of), F.lit(default))


def module_nodes(modules: DataFrame) -> DataFrame:
    """modules(module, core_score, role, file_count) -> id, name, size, colour, large, file_count."""
    size = 28 + F.sqrt("core_score") * 36
    return modules.select(F.col("module").alias("id"), F.regexp_replace("module", "^mod:", "").alias("name"), F.round(size, 4).alias("size"), chosen(F.col("role"), ROLE_COLOURS, "#94A3B8").alias("colour"), (size >= 60).alias("large"), "file_count")


def module_links(deps: DataFrame) -> DataFrame:
    """deps(src, dst, weight) -> with line width and opacity."""
    return deps.select("src", "dst", "weight", F.round(F.least(1 + F.col("weight") / 5, F.lit(5.0)), 4).alias("width"), F.round(F.least(0.3 + F.col("weight") / 30, F.lit(0.8)), 4).alias("opacity"))


def file_nodes(files: DataFrame, tiers: DataFrame) -> DataFrame:
    """files(path, module, n_sigs), tiers(module, tier) -> id, size, colour."""
    met = files.join(tiers.select("module", "tier"), "module", "left")
    return met.select(F.col("path").alias("id"), (15 + F.least(2 * F.col("n_sigs"), F.lit(30))).alias("size"), chosen(F.col("tier"), TIER_COLOURS, "#D97706").alias("colour"))


def _at(angle: Column, radius: Column | float) -> list[Column]:
    return [F.round(CENTER[0] + radius * F.cos(angle), 2).alias("x"), F.round(CENTER[1] + radius * F.sin(angle), 2).alias("y")]


def ring(ids: DataFrame, order: str = "id", radius: float = 200.0) -> DataFrame:
    """ids(id) -> id, x, y: on a circle, in order, from the top."""
    place, n = F.row_number().over(Window.orderBy(order)) - 1, F.count("*").over(Window.partitionBy())
    return ids.withColumn("angle", 2 * math.pi * place / n - math.pi / 2).select("id", *_at(F.col("angle"), radius))


def by_role(modules: DataFrame) -> DataFrame:
    """modules(id, role, ord) -> id, x, y: core modules on an inner circle, others on their role's arc."""
    place, n = F.row_number().over(Window.partitionBy("role").orderBy("ord")) - 1, F.count("*").over(Window.partitionBy("role"))
    first = chosen(F.col("role"), {r: math.radians(a) - math.pi / 2 for r, (a, _) in ROLE_ARCS.items()}, None)
    width = chosen(F.col("role"), {r: math.radians(b - a) for r, (a, b) in ROLE_ARCS.items()}, None)
    told = modules.withColumn("i", place).withColumn("n", n).withColumn("first", first).withColumn("width", width)
    angle = F.when(F.col("role") == "core", 2 * math.pi * F.col("i") / F.col("n") - math.pi / 2).otherwise(F.col("first") + F.col("width") * (F.col("i") + 0.5) / F.col("n"))
    radius = F.when(F.col("role") == "core", 80.0).otherwise(220.0)
    return told.withColumn("angle", angle).where("angle is not null").select("id", *_at(F.col("angle"), radius))


def by_tier(modules: DataFrame) -> DataFrame:
    """modules(id, tier, ord) -> id, x, y: a circle for each tier; unknown ones lie outermost."""
    place, n = F.row_number().over(Window.partitionBy("tier").orderBy("ord")) - 1, F.count("*").over(Window.partitionBy("tier"))
    radius = chosen(F.col("tier"), TIER_RADII, 280).cast("double")
    return modules.withColumn("angle", 2 * math.pi * place / n - math.pi / 2).withColumn("radius", radius).select("id", *_at(F.col("angle"), F.col("radius")))


def extensions(files: DataFrame) -> DataFrame:
    ext = F.when(F.contains(P.name(F.col("path")), F.lit(".")), F.substring_index("path", ".", -1)).otherwise("none")
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n"))


def distributions(files: DataFrame) -> DataFrame:
    """files(path, role, tier) -> dimension (role, tier or extension), value, n: three histograms by grouping sets, in one pass over the files."""
    ext = F.when(F.contains(P.name(F.col("path")), F.lit(".")), F.substring_index("path", ".", -1)).otherwise("none")
    told = files.select(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("tier", F.lit("unknown")).alias("tier"), ext.alias("extension"))
    names = ["role", "tier", "extension"]
    sets = told.groupingSets([[F.col(n)] for n in names], *map(F.col, names)).agg(F.count("*").alias("n"))
    return sets.select(F.when(F.col("role").isNotNull(), "role").when(F.col("tier").isNotNull(), "tier").otherwise("extension").alias("dimension"), F.coalesce(*names).alias("value"), "n")


def frames(modules: DataFrame) -> DataFrame:
    """modules(snapshot_id, module, core_score, tier, role) -> frame, module, change against the frame before.

    Frames are numbered over the snapshots, not over rows; each meets the one before by a full outer join.
    """
    ids = modules.select("snapshot_id").distinct().withColumn("frame", F.row_number().over(Window.orderBy("snapshot_id")))
    now = modules.join(ids, "snapshot_id").drop("snapshot_id")
    last = ids.agg(F.max("frame").alias("last"))
    before = now.select((F.col("frame") + 1).alias("frame"), "module", *[F.col(c).alias(f"was_{c}") for c in ("core_score", "tier", "role")]).join(F.broadcast(last)).where("frame <= last").drop("last")
    met = now.where("frame > 1").join(before, ["frame", "module"], "full_outer")
    moved = (F.abs(F.col("core_score") - F.col("was_core_score")) > 0.01) | (F.col("tier") != F.col("was_tier")) | (F.col("role") != F.col("was_role"))
    change = F.when(F.col("was_tier").isNull(), "added").when(F.col("tier").isNull(), "removed").when(moved, "changed")
    return met.withColumn("change", change).where("change is not null").select("frame", "module", "change")


def frames_layout(modules: DataFrame) -> DataFrame:
    """modules(snapshot_id, module, core_score, tier, role, file_count) -> frame, snapshot_id, module, present, core_score, tier, role, file_count, x, y.

    All frames share one ring, laid over the modules of all snapshots, so a module never moves. A module that a frame lacks is carried over from the last that
    has it, not present; before its first frame it has no row. Frames are numbered over snapshots, and gaps are filled by a window over a module's frames alone.
    """
    ids = modules.select("snapshot_id").distinct().withColumn("frame", F.row_number().over(Window.orderBy("snapshot_id")))
    last = ids.agg(F.max("frame").alias("last"))
    told = modules.join(ids, "snapshot_id").drop("snapshot_id").join(F.broadcast(last))  # one row
    until = F.coalesce(F.lead("frame").over(Window.partitionBy("module").orderBy("frame")) - 1, F.col("last"))
    shown = told.withColumn("until", until).withColumn("at", F.explode(F.sequence("frame", "until")))
    shown = shown.withColumn("present", F.col("at") == F.col("frame")).drop("frame", "last", "until").withColumnRenamed("at", "frame")
    places = ring(modules.select(F.col("module").alias("id")).distinct()).withColumnRenamed("id", "module")
    return shown.join(places, "module").join(ids, "frame").select("frame", "snapshot_id", "module", "present", "core_score", "tier", "role", "file_count", "x", "y")


def frame_links(links: DataFrame, modules: DataFrame) -> DataFrame:
    """links(snapshot_id, src, dst, weight), modules(snapshot_id, module) -> those with both ends in their snapshot, with line width and opacity."""
    here = modules.select("snapshot_id", "module").distinct()
    kept = links.join(here.withColumnRenamed("module", "src"), ["snapshot_id", "src"], "left_semi").join(here.withColumnRenamed("module", "dst"), ["snapshot_id", "dst"], "left_semi")
    return kept.select("snapshot_id", "src", "dst", "weight", F.round(F.least(1 + F.col("weight") / 5, F.lit(5.0)), 4).alias("width"), F.round(F.least(0.3 + F.col("weight") / 30, F.lit(0.8)), 4).alias("opacity"))


def function_nodes(near: DataFrame, files: DataFrame, focus: str) -> DataFrame:
    """near(id, hop, ...), files(path, module) -> id, name, file, module, hop, size, border of functions."""
    of = near.withColumn("file", F.substring_index("id", ":", 1)).withColumn("name", F.expr("substring(id, instr(id, ':') + 1)"))
    met = of.join(files.select(F.col("path").alias("file"), "module"), "file", "left").fillna("unknown", ["module"])
    own = F.col("file") == focus
    return met.select("id", "name", "file", "module", "hop", F.when(own, 25).otherwise(15).alias("size"), F.when(own, 2).otherwise(0).alias("border"))


def function_links(edges: DataFrame, near: DataFrame) -> DataFrame:
    """edges(caller, callee, weight), near(id) -> calls among these functions, with line width and opacity."""
    ids = F.broadcast(near.select("id"))  # as many as a drawing takes
    kept = edges.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi")
    return kept.select("caller", "callee", "weight", F.round(F.least(1 + F.col("weight") / 2, F.lit(4.0)), 4).alias("width"), F.round(F.least(0.4 + F.col("weight") / 10, F.lit(0.8)), 4).alias("opacity"))
