"""Imports, calls and parents: range and suffix joins written as equi joins or bounded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P


def import_lines(contents: DataFrame) -> DataFrame:
    """contents(path, content) -> path, target: the module that each import line names first."""
    lines = contents.select("path", F.explode(F.split("content", "\n")).alias("line"))
    return lines.where(F.col("line").rlike(r"^(import|from) ")).select("path", F.get(F.split("line", r"\s+"), F.lit(1)).alias("target")).where("target <> ''")


def import_candidates(imports: DataFrame) -> DataFrame:
    """imports(path, target) -> path, candidate: the files that may be meant, four for an absolute module.

    A relative one (leading dots) starts in the importing file's directory, a dot up for each dot but the first.
    """
    dots = F.length(F.regexp_extract("target", r"^\.*", 0))
    rest = F.replace(F.regexp_replace("target", r"^\.+", ""), F.lit("."), F.lit("/"))
    here = P.dirs(F.col("path"))
    up = F.slice(here, F.lit(1), F.greatest(F.size(here) - (dots - 1), F.lit(0)))
    base = F.concat_ws("/", F.filter(F.concat(up, F.array(rest)), lambda x: x != ""))
    relative = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    absolute = F.array(*[F.concat(F.lit(b), rest, F.lit(e)) for e in (".py", "/__init__.py") for b in ("", "src/")])
    return imports.select("path", "target", F.explode(F.when(dots > 0, relative).otherwise(absolute)).alias("candidate")).where("candidate <> ''")


def resolved_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """imports(path, target, ...), paths(path) of the corpus -> with ``candidate``, the other files that are meant.

    What a module may mean is looked up once for all files that import it (of a directory, if it is relative), not once for each.
    """
    relative = F.when(F.col("target").startswith("."), F.array_join(P.dirs(F.col("path")), "/")).otherwise("")
    asked = imports.withColumn("_from", relative)
    wanted = asked.groupBy("target", "_from").agg(F.min("path").alias("path"))
    found = import_candidates(wanted.select("path", "target")).join(paths.select(F.col("path").alias("candidate")), "candidate")
    return asked.join(found.select("target", relative.alias("_from"), "candidate"), ["target", "_from"]).where("path <> candidate").drop("_from")


def file_dependencies(contents: DataFrame) -> DataFrame:
    """contents(path, content) -> src, dst, weight: imports that name a file of the corpus. An equi join on candidates."""
    counted = import_lines(contents).groupBy("path", "target").agg(F.count("*").alias("n"))
    met = resolved_imports(counted, contents)
    return met.groupBy(F.col("path").alias("src"), F.col("candidate").alias("dst")).agg(F.sum("n").cast("double").alias("weight"))


def path_suffixes(files: DataFrame) -> DataFrame:
    """files(path) -> path, suffix: every tail of a path that begins at a part."""
    p = P.parts(F.col("path"))
    tails = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/"))
    return files.select("path", F.explode(tails).alias("suffix"))


def suffix_join(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(suffix) with the paths that end in it: an equi join, as every path states its tails."""
    return wanted.join(path_suffixes(files), "suffix")


def enclosing(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """points(path, line, ...), spans(path, name, start, end) -> the point and the outermost span around it.

    The first by start, then by end (longest), wins. Spans are told in each stretch of ``width`` lines that they touch, by where they end in it: of those that end at
    a line there, one can win. Of the spans that end at a point or behind it the first to start is the one around it, if it has started by then: a running
    minimum over a stretch's points and ends, from its last line to its first. So no point meets all the spans around it.
    """
    touched = spans.where("start <= end").select("path", F.col("name").alias("enclosing"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("stretch"))
    here = F.least(F.col("end"), (F.col("stretch") + 1) * width - 1)
    outer = F.struct("start", (-F.col("end")).alias("shorter"), "enclosing")
    ends = touched.groupBy("path", "stretch", here.alias("_at")).agg(F.min(outer).alias("_outer"))
    placed = points.where("path is not null and line is not null").withColumn("stretch", F.floor(F.col("line") / width)).withColumn("_at", F.col("line")).withColumn("_point", F.lit(True))
    both = placed.unionByName(ends, allowMissingColumns=True)
    behind = Window.partitionBy("path", "stretch").orderBy(F.desc("_at"))  # with what ends at the line itself
    met = both.withColumn("_outer", F.min("_outer").over(behind)).where("_point and _outer.start <= line")
    return met.groupBy("stretch", *points.columns).agg(F.first("_outer.enclosing").alias("enclosing")).select(*points.columns, "enclosing")


def parent_of(tags: DataFrame) -> DataFrame:
    """tags(path, ord, name, kind, line) -> with ``parent``: the class on the nearest line before, the first of equals.

    As-of by one window a file: the frame ends a line before.
    """
    before = Window.partitionBy("path").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    near = F.max_by("name", F.when(F.col("kind") == "class", F.struct("line", (-F.col("ord")).alias("first")))).over(before)
    found = F.max(F.when(F.col("kind") == "class", 1)).over(before).isNotNull()
    return tags.withColumn("parent", F.when(found & F.col("kind").isin("method", "function"), near))


def calls_by_name(references: DataFrame, spans: DataFrame) -> DataFrame:
    """references(path, name, line), spans -> caller ("file:function"), name, line: what functions call, before names meet definitions."""
    return enclosing(references, spans).select(F.concat_ws(":", "path", "enclosing").alias("caller"), "name", "line")


def callees(definitions: DataFrame) -> DataFrame:
    """definitions(path, name) -> name, callee ("file:function")."""
    return definitions.select("name", F.concat_ws(":", "path", "name").alias("callee"))


def call_edges(references: DataFrame, definitions: DataFrame, spans: DataFrame) -> DataFrame:
    """references(path, name, line), definitions(path, name), spans -> caller, callee ("file:function"), line."""
    return calls_by_name(references, spans).join(callees(definitions), "name").select("caller", "callee", "line")


def symbol_graph(tags: DataFrame) -> DataFrame:
    """tags(path, name, tag) -> name, definitions, references: files by name, for maps of symbols."""
    return tags.groupBy("name").agg(F.array_sort(F.collect_set(F.when(F.col("tag") == "def", F.col("path")))).alias("definitions"), F.count_if(F.col("tag") == "ref").alias("references"))


def cross_module(edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges(src, dst), files(path, module) -> with both modules and whether they differ."""
    a = files.select(F.col("path").alias("src"), F.col("module").alias("src_module"))
    b = files.select(F.col("path").alias("dst"), F.col("module").alias("dst_module"))
    return edges.join(a, "src").join(b, "dst").withColumn("crosses", F.col("src_module") != F.col("dst_module"))


def known(paths: Column, raw: DataFrame, files: DataFrame) -> DataFrame:
    """raw candidates -> those that name an indexed file, whatever their case, as the file is written."""
    safe = raw.withColumn("wanted", F.lower(P.safe_path(paths))).where("wanted is not null")
    return safe.join(files.select(F.lower("path").alias("wanted"), F.col("path").alias("found")), "wanted").drop("wanted")
