"""The map of a project for a reader: what its top directories hold, where to begin, where its projects, tests and code lie. Lines by section; all are a few rows by their caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import archetype as A
from gneiss.operators import prompts, rank, tree

SECTIONS = ["Workspace Layout", "Entry Points", "Project Boundaries", "Fast Navigation Path", "Core Code Areas"]


def _numbered(rows: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows with their place ``nth``; only these meet in one task."""
    return rows.orderBy(*order).limit(cap).withColumn("nth", F.row_number().over(Window.orderBy(*order)))


def _section(k: int, lines: DataFrame) -> DataFrame:
    return lines.select(F.lit(k).alias("part"), F.lit(SECTIONS[k]).alias("section"), F.col("nth").cast("int").alias("nth"), "line")


def _more(rows: DataFrame, cap: int, what: str) -> DataFrame:
    """How many more rows there are than ``cap``, as a last line, if any."""
    n = rows.agg(F.count("*").alias("n")).where(F.col("n") > cap)
    return n.select(F.lit(cap + 1).alias("nth"), F.concat(F.lit("- `...`: +"), (F.col("n") - cap).cast("string"), F.lit(f" {what}")).alias("line"))


def _code(c: str | Column) -> Column:
    return F.concat(F.lit("`"), F.col(c) if isinstance(c, str) else c, F.lit("`"))


def project_map(files: DataFrame, kind: str, profile: dict) -> DataFrame:
    """files(path, role, score), the repository's archetype, a profile of ``prompts.profile`` -> part, section, nth, line."""
    small = profile["name"] == "small"
    dirs_cap, projects_cap, entry_cap = (6 if small else 10), (3 if small else 6), max(4, profile["llm_reading_items"] + 2)

    tops = tree.shown(tree.nodes(files.select("path"))).where("type = 'dir' and depth = 1").select("name")
    layout = _numbered(tops, [F.lower("name"), F.col("name")], dirs_cap).select("nth", F.concat(F.lit("- `"), "name", F.lit("/`: "), A.described(F.col("name"), kind)).alias("line"))

    found = rank.entry_files(files, kind)
    entries = _numbered(found, [F.desc("score"), F.desc("path")], entry_cap)
    starts = entries.select("nth", F.concat(F.lit("- "), _code("path"), F.lit(": "), "reason").alias("line"))

    projects = tree.boundaries(files, found.withColumn("rank", F.struct((-F.col("score")).alias("less"), F.col("path"))))
    order = [F.desc(F.col("entry") != ""), F.desc("source_files"), F.desc("test_files"), F.desc("project")]
    numbered = _numbered(projects, order, 8)
    none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "n/a").otherwise(c)
    said = F.concat(
        F.lit("- `"), "project", F.lit("/`: "), F.col("source_files").cast("string"), F.lit(" source files, "), F.col("test_files").cast("string"), F.lit(" tests; entry "),
        _code(none(F.col("entry"))), F.lit("; core "), _code(none(F.array_join("core_areas", ", "))),
    )
    bounds = numbered.where(F.col("nth") <= projects_cap).select("nth", said.alias("line"))

    areas = _numbered(tree.code_areas(files), [F.desc("n"), F.desc("area")], 8)
    steps = prompts.steps(numbered.select("nth", "project", "entry", F.get("core_areas", F.lit(0)).alias("area")), entries.select("nth", "path", "reason"), areas)
    path = steps.select("nth", F.concat(F.col("nth").cast("string"), F.lit(". "), "step").alias("line"))
    dense = areas.select("nth", F.concat(F.lit("- "), _code("area"), F.lit(": ~"), F.col("n").cast("string"), F.lit(" source files")).alias("line"))

    return (
        _section(0, layout.unionByName(_more(tops, dirs_cap, "additional workspace directories")))
        .unionByName(_section(1, starts.unionByName(_more(found, entry_cap, "more entry candidates"))))
        .unionByName(_section(2, bounds.unionByName(_more(projects, projects_cap, "additional project boundaries"))))
        .unionByName(_section(3, path))
        .unionByName(_section(4, dense))
    )


def text(lines: DataFrame, architecture: str = "") -> str:
    """The map as Markdown; a few dozen lines reach the driver."""
    out = ["## Project Map", ""] + (["### Runtime Architecture", "", architecture, ""] if architecture else [])
    now = None
    for r in lines.orderBy("part", "nth").collect():
        if r["section"] != now:
            out += ([""] if now else []) + [f"### {r['section']}", ""]
            now = r["section"]
        out.append(r["line"])
    return "\n".join([*out, ""])
