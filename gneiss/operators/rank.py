"""File ranking: by path, by role and signatures, by entry, by symbols."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P
from gneiss.operators import archetype, graph
from gneiss.operators.ordered import numbered

# File names and path marks and what they add.
CORE_NAMES = "cli.py main.py processor.py engine.py core.py trimmer.py runner.py indexer.py parser.py".split()
KEY_FILES = {"main.py": 8, "__main__.py": 8, "cli.py": 7, "server.py": 7, "http_proxy.py": 8, "project_router.py": 8, "config.py": 6, "dashboard.html": 6}
PATH_MARKS = "/gateway/ /router /server /nav/ /memory/ /mcp/".split()


def times(tests: list[tuple[Column, float]]) -> Column:
    return reduce(lambda a, t: a * F.when(t[0], t[1]).otherwise(1.0), tests, F.lit(1.0))


def heuristic_score(path: Column, focus: list[str] | None = None, mentioned: list[str] | None = None) -> Column:
    low = F.lower(path)
    prose = path.endswith(".md") | path.endswith(".txt")
    init = path.endswith("__init__.py")
    testish = F.contains(low, F.lit("test"))
    tests = [
        (path.isin(focus) if focus else F.lit(False), 50.0),
        (path.isin(mentioned) if mentioned else F.lit(False), 10.0),
        (prose, 0.3),
        (~prose & (path.startswith("src/") | path.startswith("lib/")), 2.0),
        (F.contains(path, F.lit("/tools/")) | path.startswith("tools/"), 2.5),
        (init, 0.5),
        (~init & path.endswith(".py") & ~testish, 1.5),
        (P.any_of([F.contains(path, F.lit(n)) for n in CORE_NAMES]), 3.0),
        (testish | F.contains(low, F.lit("spec")), 0.2),
        (path.startswith("plans/") | path.startswith("docs/"), 0.4),
    ]
    return times(tests)


def heuristic(files: DataFrame, focus: list[str] | None = None, mentioned: list[str] | None = None) -> DataFrame:
    """files(path) -> path, score; order by score descending, then path."""
    return files.select("path", heuristic_score(F.col("path"), focus, mentioned).alias("score"))


def source_score(path: Column, module_score: Column, desc: Column, n_sigs: Column) -> Column:
    low, n = F.lower(path), F.lower(P.name(path))
    key = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KEY_FILES.items() for x in kv]), n), F.lit(0))
    testish = F.contains(n, F.lit("test")) | F.exists(P.parts(path), lambda p: F.lower(p).isin("tests", "test", "__tests__"))
    return (
        F.when(F.contains(low, F.lit("/src/")) | low.startswith("src/"), 6.0).otherwise(0.0)
        + F.when(P.any_of([F.contains(low, F.lit(m)) for m in PATH_MARKS]), 3.0).otherwise(0.0)
        + key
        + F.when(F.contains(n, F.lit("config")), 2.0).otherwise(0.0)
        + F.coalesce(module_score, F.lit(0.0)) * 5.0
        + F.when(F.coalesce(desc, F.lit("")) != "", 1.5).otherwise(0.0)
        + F.least(n_sigs, F.lit(40)) * 0.25
        - F.when(testish, 12.0).otherwise(0.0)
    )


def source_files(files: DataFrame, scores: DataFrame) -> DataFrame:
    """files(path, role, module, desc, n_sigs), scores(module, core_score) -> path, score, n_sigs of source files above 0; order (score, n_sigs, path) descending."""
    own = files.where((F.col("role") == "source") & ~P.is_noise(F.col("path"))).join(scores.select("module", "core_score"), "module", "left")
    return own.select("path", source_score(F.col("path"), F.col("core_score"), F.col("desc"), F.col("n_sigs")).alias("score"), "n_sigs").where("score > 0")


def test_files(files: DataFrame) -> DataFrame:
    low = F.lower("path")
    vendored = F.contains(low, F.lit("/vendor/")) | low.startswith("vendor/")
    return files.where((F.col("role") == "test") & ~P.is_noise(F.col("path")) & ~vendored).select("path", "n_sigs")


def entry_reason(path: Column, known: Column | None = None) -> Column:
    """struct<reason, points> of a file that a reader would start from. ``known``: why the file's very name makes it one, or null."""
    n = P.name(path)
    low = F.lower(n)

    def of(reason: Column | str, points: int) -> Column:
        return F.struct((F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(points).alias("points"))

    out = F if known is None else F.when(known.isNotNull(), of(known, 5))
    return (
        out.when(low.rlike(r"^main\.(py|ts|js)$"), of("main application entry", 4))
        .when(low.rlike(r"^app\.(py|ts|js)$"), of("application bootstrap", 4))
        .when(low.rlike(r"^server\.(py|ts|js)$"), of("server bootstrap", 4))
        .when(low.rlike(r"^index\.(ts|js)$") & (F.size(P.parts(path)) <= 2), of("package entry surface", 3))
        .when(F.contains(low, F.lit("cli")), of("CLI entry point", 3))
        .otherwise(of("", 0))
    )


def entry_files(files: DataFrame, kinds: DataFrame | str | None = None, by: list[str] | None = None) -> DataFrame:
    """files(path, role, score) -> path, reason, score of entries; order (score, path) descending.

    ``kinds``: the repository's archetype, or a frame with one for each repository that the columns ``by`` tell apart. Names that an archetype's
    table holds come first; the table is a fixed one, so it is sent to all tasks.
    """
    by = by or []
    own = files.where("role <> 'test'")
    if kinds is None:
        told = own.withColumn("why", entry_reason(F.col("path")))
    else:
        known = F.broadcast(files.sparkSession.createDataFrame(archetype.reason_rows(), "archetype string, name string, known string"))
        own = own.withColumn("archetype", F.lit(archetype.normal(kinds))) if isinstance(kinds, str) else own.join(kinds, by, "left").fillna("generic", ["archetype"])
        told = own.withColumn("name", P.name(F.col("path"))).join(known, ["archetype", "name"], "left").withColumn("why", entry_reason(F.col("path"), F.col("known")))
    return told.where("why.points > 0").select(*by, "path", F.col("why.reason").alias("reason"), (F.col("why.points") * 10 + F.coalesce("score", F.lit(0.0))).alias("score"))


def module_order(modules: DataFrame) -> DataFrame:
    """modules(module, desc, tier, core_score) with ``nth``: core ones first, tests behind, then by score. A window over modules alone."""
    testish = F.contains(F.lower("module"), F.lit("test")) | F.lower(F.coalesce("desc", F.lit(""))).rlike("test|benchmark")
    order = Window.orderBy(F.when(F.lower("tier") == "core", 0).otherwise(1), testish.cast("int"), F.desc("core_score"), "module")
    return modules.withColumn("nth", F.row_number().over(order))


def ranked_tags(definitions: DataFrame, spread: DataFrame, ranks: DataFrame, digits: int = 12) -> DataFrame:
    """definitions(path, name, line), spread(path, name, rank) of ``graph.ranked_definitions``, ranks(id, rank) of files -> path, name, line, rank, of_file.

    Best first by ``tag_order``: the definitions that others refer to, by what these references give them; then, with an empty name and no line, the files that have none,
    by their own rank. Ranks are rounded, so sums in another order make no other places.
    """
    same = lambda c: c
    return keyed_tags(definitions, ranks.select(F.col("id").alias("path")), spread, ranks, (same, same), digits)


def tags_of_definitions(vertices: DataFrame, definitions: DataFrame, references: DataFrame, names: list[str] | None = None, focus: list[str] | None = None, start: DataFrame | None = None, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """vertices(id) of all files, definitions(path, name, line), references(path, name), start(id, p) -> ranked tags: files are ranked by who refers to them, then definitions by the ranks of who refers to them."""
    named = definitions.select("name").unionByName(references.select("name"))
    of_file, of_name = key = graph.keys_of(vertices.select("id").unionByName(definitions.select(F.col("path").alias("id"))).unionByName(references.select(F.col("path").alias("id")))), graph.keys_of(named)
    uses, made = graph.name_links(definitions, references, names, focus, key)
    begin = start.select(of_file(F.col("id")).alias("id"), "p") if start is not None else None
    ranks = graph.name_pagerank(vertices.select(of_file(F.col("id")).alias("id")), uses, made, begin, rounds, tolerance)
    return keyed_tags(definitions, vertices.select(F.col("id").alias("path")).distinct(), graph.name_definitions(uses, made, ranks), ranks, key)


def keyed_tags(definitions: DataFrame, paths: DataFrame, spread: DataFrame, ranks: DataFrame, key: tuple[Callable[[Column], Column], Callable[[Column], Column]], digits: int = 12) -> DataFrame:
    """``ranked_tags`` where ``spread`` and ``ranks`` know files and names by a key of theirs."""
    of_file, of_name = key
    files = ranks.select(F.col("id").alias("_file"), F.round("rank", digits).alias("of_file"))
    known = spread.select(F.col("path").alias("_file"), F.col("name").alias("_name"), F.round("rank", digits).alias("rank")).join(files, "_file", "left").fillna(0.0, ["of_file"])
    told = definitions.select("path", "name", "line", of_file(F.col("path")).alias("_file"), of_name(F.col("name")).alias("_name")).join(known, ["_file", "_name"])
    bare = files.join(spread.select(F.col("path").alias("_file")).distinct(), "_file", "left_anti")
    rest = paths.select("path", of_file(F.col("path")).alias("_file")).join(bare, "_file").select("path", F.lit("").alias("name"), F.lit(None).cast(definitions.schema["line"].dataType).alias("line"), F.lit(0.0).alias("rank"), "of_file")
    return told.select("path", "name", "line", "rank", "of_file").unionByName(rest)


def tag_order() -> list[Column]:
    return [F.desc("rank"), F.desc("of_file"), F.asc("path"), F.asc("name"), F.asc("line")]


def best_symbols(ranked: DataFrame, order: list[Column], rate: float = 0.95) -> DataFrame:
    """Ranked tags (path, ...) -> path, score: the sum of rate^position, of the files that get any: a double holds no power below 2^-1075, so from some place on all are 0."""
    last = math.ceil(-1075 * math.log(2) / math.log(rate)) if 0 < rate < 1 else None
    placed = numbered(ranked.orderBy(*order).limit(last) if last and last < 100_000 else ranked, order)
    return placed.groupBy("path").agg(F.sum(F.pow(F.lit(rate), F.col("place"))).alias("score"))


def symbol_scores(ranked: DataFrame, order: list[Column], rate: float = 0.95) -> DataFrame:
    """Ranked tags (path, ...) -> path, score: the sum of rate^position over all tags."""
    rest = ranked.select("path", F.lit(0.0).alias("score"))
    return best_symbols(ranked, order, rate).unionByName(rest).groupBy("path").agg(F.sum("score").alias("score"))


def symbol_blend(files: DataFrame, symbols: DataFrame, priors: DataFrame) -> DataFrame:
    """files(path), symbols(path, score), priors(path, score) -> path, score: 0.6 of the symbols' and 0.4 of the prior score, each scaled by its largest."""
    top = symbols.agg(F.max("score").alias("a")).join(priors.agg(F.max("score").alias("b")))
    met = files.select("path").join(symbols.select("path", F.col("score").alias("s")), "path", "left").join(priors.select("path", F.col("score").alias("p")), "path", "left").join(F.broadcast(top))
    part = [F.coalesce(F.col(x) / F.nullif(F.coalesce(F.col(m), F.lit(1.0)), F.lit(0.0)), F.lit(0.0)) for x, m in (("s", "a"), ("p", "b"))]
    return met.select("path", (0.6 * part[0] + 0.4 * part[1]).alias("score"))


def snippet_tags(tags: DataFrame, mentioned: list[str], most: int = 2) -> DataFrame:
    """tags(path, name, line): the ``most`` best of each file: mentioned, then public, then first."""
    said = F.col("name").isin(mentioned) if mentioned else F.lit(False)
    order = Window.partitionBy("path").orderBy((~said).cast("int"), F.col("name").startswith("_").cast("int"), "line", "name")
    return tags.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def navigation_tier(score: Column) -> Column:
    return F.when(score > 0.5, 1).when(score > 0.2, 2).otherwise(3)


def cascade(coarse: DataFrame, fine: DataFrame, focus: DataFrame, wide: int = 50, most: int = 20) -> DataFrame:
    """coarse(path, score), fine(path, score), focus(path) -> path, score, tier: the best ``wide`` and the focus, ranked finely."""
    first = coarse.orderBy(F.desc("score"), "path").limit(wide).select("path").unionByName(focus.select("path")).distinct()
    best = fine.join(first, "path", "left_semi").orderBy(F.desc("score"), "path").limit(most)
    return best.select("path", "score", navigation_tier(F.col("score")).alias("tier"))
