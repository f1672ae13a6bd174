"""Directory trees as node tables: id, type, name, parent_id, depth. Spark has no recursive types, and needs none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P
from gneiss.operators.ordered import ranges
from gneiss.plans.lineage import cut


def _prefix(parts: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(0))), "/")


def nodes(paths: DataFrame) -> DataFrame:
    """paths(path) -> every file and every directory above one; the root is ``dir:.``.

    Files are made distinct by their paths alone, before their columns are told, and directories apart from them: of these a task passes on each of its own once.
    """
    split = paths.select(P.parts(F.col("path")).alias("parts")).where(F.size("parts") > 0)
    files = split.select(F.array_join("parts", "/").alias("here"), F.size("parts").alias("depth")).distinct()
    above = split.select("parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("depth"))
    dirs = above.select(F.when(F.col("depth") == 0, ".").otherwise(_prefix(F.col("parts"), F.col("depth"))).alias("here"), "depth").distinct()

    def told(n: DataFrame, type: str) -> DataFrame:
        name = F.substring_index("here", "/", -1)
        up = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == 1, "dir:.").otherwise(F.concat(F.lit("dir:"), F.left("here", F.length("here") - F.length(name) - 1)))
        return n.select(F.concat(F.lit(f"{type}:"), "here").alias("id"), F.lit(type).alias("type"), name.alias("name"), up.alias("parent_id"), "depth")

    return told(files, "file").unionByName(told(dirs, "dir"))


def from_listing(lines: DataFrame) -> DataFrame:
    """lines(ord, line), a listing indented by two spaces with a slash behind directories -> ord, path, type.

    A line's parent at each depth is the last line of that depth above it. Lines are dealt into sorted ranges; what a range doesn't
    hold comes from the ends of those before, a row a range, so no task reads the whole listing.
    """
    level = F.floor((F.length("line") - F.length(F.ltrim("line"))) / 2).cast("int")
    told = lines.where(F.trim("line") != "").select("ord", level.alias("depth"), F.regexp_replace(F.trim("line"), "/$", "").alias("name"), F.trim("line").endswith("/").alias("is_dir"))
    dealt = ranges(told, [F.asc("ord")])
    deepest = dealt.agg(F.max("depth")).first()[0] or 0
    here = Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("_part").agg(*[F.max_by("name", F.when(F.col("depth") == d, F.col("_nth"))).alias(f"_end{d}") for d in range(deepest + 1)])
    carried = ends.select("_part", *[F.last(f"_end{d}", ignorenulls=True).over(before).alias(f"_old{d}") for d in range(deepest + 1)])
    met = dealt.join(F.broadcast(carried), "_part")  # a row a range
    for d in range(deepest + 1):
        met = met.withColumn(f"_{d}", F.coalesce(F.last(F.when(F.col("depth") == d, F.col("name")), ignorenulls=True).over(here), F.col(f"_old{d}")))
    path = F.concat_ws("/", *[F.when(F.col("depth") >= d, F.col(f"_{d}")) for d in range(deepest + 1)])
    return met.select("ord", path.alias("path"), F.when(F.col("is_dir"), "dir").otherwise("file").alias("type"))


def tree_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Node tables -> id, type, name, change: removed, added, and modified (in both, but with other children).

    Children are compared pair by pair: a directory that has a child in one tree alone is another one. No
    directory's children are gathered.
    """

    def pairs(n: DataFrame, tag: str) -> DataFrame:
        return n.where("parent_id is not null").select("parent_id", "id").distinct().withColumn(tag, F.lit(True))

    other = pairs(old, "was").join(pairs(new, "is"), ["parent_id", "id"], "full_outer").where("was is null or is is null")
    other = other.select(F.col("parent_id").alias("id")).distinct().withColumn("other", F.lit(True))
    a = old.select("id", F.col("type").alias("old_type"), F.col("name").alias("old_name"))
    b = new.select("id", F.col("type").alias("new_type"), F.col("name").alias("new_name"))
    met = a.join(b, "id", "full_outer").join(other, "id", "left")
    change = F.when(F.col("new_type").isNull(), "removed").when(F.col("old_type").isNull(), "added").when(F.col("other"), "modified")
    return met.withColumn("change", change).where("change is not null").select("id", F.coalesce("new_type", "old_type").alias("type"), F.coalesce("new_name", "old_name").alias("name"), "change")


def treemap(files: DataFrame) -> DataFrame:
    """files(path, size) -> id, value: sizes (at least 1, 1 if unknown) summed up to every directory."""
    sized = files.select(P.parts(F.col("path")).alias("parts"), F.greatest(F.coalesce("size", F.lit(1)), F.lit(1)).alias("value"))
    steps = sized.select("parts", "value", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    id = F.when(F.col("depth") == F.size("parts"), F.concat(F.lit("file:"), _prefix(F.col("parts"), F.col("depth")))).when(F.col("depth") == 0, "dir:.").otherwise(F.concat(F.lit("dir:"), _prefix(F.col("parts"), F.col("depth"))))
    return steps.groupBy(id.alias("id")).agg(F.sum("value").alias("value"))


def visible(n: DataFrame, per_dir: int, deepest: int) -> DataFrame:
    """A tree cut to ``per_dir`` files and ``per_dir`` directories in a directory and to a depth, with how many are left out."""
    order = Window.partitionBy("parent_id", "type").orderBy(F.lower("name"), "name")
    count = F.count("*").over(Window.partitionBy("parent_id", "type"))
    ranked = n.where((F.col("depth") <= deepest) & F.col("parent_id").isNotNull()).withColumn("nth", F.row_number().over(order)).withColumn("hidden", F.greatest(count - per_dir, F.lit(0)))
    return ranked.where(F.col("nth") <= per_dir).select("id", "type", "name", "parent_id", "depth", "nth", "hidden")


# Directories and files that a tree's text leaves out, beside hidden ones.
SKIPPED_DIRS = P.NOISE_SEGMENTS
SHOWN_HIDDEN = {"dir": [".github", ".devcontainer"], "file": [".gitignore", ".env.example"]}


def shown(n: DataFrame) -> DataFrame:
    """The nodes that a tree's text may name; what lies below a directory that is left out is left out by its parent."""
    low = F.lower("name")
    noise = low.isin("history", "snapshots")
    dirs = low.isin(SKIPPED_DIRS) | low.endswith(".egg-info") | (low.startswith(".") & ~low.isin(SHOWN_HIDDEN["dir"]))
    files = low.isin(P.NOISE_NAMES) | P.any_of([low.endswith(s) for s in P.NOISE_SUFFIXES]) | (low.startswith(".") & ~low.isin(SHOWN_HIDDEN["file"]))
    return n.where(F.col("parent_id").isNotNull() & ~(noise | F.when(F.col("type") == "dir", dirs).otherwise(files)))


def _placed(n: DataFrame, files: int, dirs: int) -> DataFrame:
    """Per directory its first files and directories, each kind in order of name, with places from 1."""
    order = Window.partitionBy("parent_id", "type").orderBy(F.lower("name"), "name")
    first = n.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(files, dirs))  # a number, so that tasks pass on no more
    return first.where(F.col("nth") <= F.when(F.col("type") == "file", files).otherwise(dirs))


def _line(key: Column, depth: int, *said: Column | str) -> list[Column]:
    return [key.alias("key"), F.concat(F.lit("  " * depth), *(F.lit(x) if isinstance(x, str) else x for x in said)).alias("line")]


def tree_lines(n: DataFrame, files_per_dir: int = 10, dirs_per_dir: int = 12, deepest: int = 4) -> DataFrame:
    """A node table as indented text, a row a line: key (a path of places: its order is the lines') and line.

    A directory's files come first, then its directories, as many of each as the caps allow and then how many more there are; at ``deepest`` its children
    are only counted. Walked from the root, a join a level with directories that are shown, of which there are dirs_per_dir ^ level at the most. Each
    task passes on a directory's first children alone (a window's group limit), so no directory is sorted in one.
    """
    kids = shown(n)
    counts = kids.groupBy(F.col("parent_id").alias("id")).agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "dir").alias("dirs"))
    counts = cut(counts)  # a row a directory, read at each level
    placed = cut(_placed(kids, files_per_dir, dirs_per_dir))
    level = n.where("parent_id is null").select("id", F.lit("").alias("key"), "name")
    out = None
    for depth in range(deepest + 1):
        level = cut(level.join(counts, "id", "left").fillna(0, ["files", "dirs"]))
        key = F.col("key")
        parts = [level.select(*_line(key, depth, F.col("name"), "/"))]
        if depth == deepest:
            parts.append(level.select(*_line(F.concat(key, F.lit("0")), depth, "  ... (", F.col("files").cast("string"), " files, ", F.col("dirs").cast("string"), " dirs)")))
        else:
            below = placed.join(level.select(F.col("id").alias("parent_id"), "key"), "parent_id")
            place = F.concat(key, F.when(F.col("type") == "file", "0").otherwise("1"), F.lpad(F.col("nth").cast("string"), 6, "0"))
            parts.append(below.where("type = 'file'").select(*_line(place, depth, "  ", F.col("name"))))
            for kind, cap, mark in (("files", files_per_dir, "0~"), ("dirs", dirs_per_dir, "1~")):
                more = level.where(F.col(kind) > cap)
                parts.append(more.select(*_line(F.concat(key, F.lit(mark)), depth, "  ... (+", (F.col(kind) - cap).cast("string"), f" more {kind})")))
            level = below.where("type = 'dir'").select("id", place.alias("key"), "name")
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


def tree_summary(n: DataFrame, files: int = 10, dirs: int = 18) -> DataFrame:
    """The root's first files, and its first directories with what each holds: key, line."""
    kids = shown(n)
    root = n.where("parent_id is null").select("id", "name")
    top = kids.join(root.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    counts = kids.groupBy(F.col("parent_id").alias("id")).agg(F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "dir").alias("dirs"))
    said = _placed(top, files, dirs).join(counts, "id", "left").fillna(0, ["files", "dirs"])
    place = F.concat(F.when(F.col("type") == "file", "0").otherwise("1"), F.lpad(F.col("nth").cast("string"), 6, "0"))
    held = F.when(F.col("type") == "dir", F.concat(F.lit("/ ("), F.col("files").cast("string"), F.lit(" files, "), F.col("dirs").cast("string"), F.lit(" dirs)"))).otherwise("")
    more = top.agg(F.count_if(F.col("type") == "dir").alias("n")).where(F.col("n") > dirs)
    return (
        root.select(*_line(F.lit(""), 0, F.col("name"), "/"))
        .unionByName(said.select(*_line(place, 1, F.col("name"), held)))
        .unionByName(more.select(*_line(F.lit("1~"), 1, "... (+", (F.col("n") - dirs).cast("string"), " more top-level dirs)")))
    )


def tree_text(n: DataFrame, most_chars: int, files_per_dir: int = 10, dirs_per_dir: int = 12, deepest: int = 4, top_dirs: int = 18) -> DataFrame:
    """The lines of a tree's text in order, nth and line: whole if they have ``most_chars`` characters at the most, else the summary.

    The lines' lengths are summed where they lie; one number reaches the driver.
    """
    whole = cut(tree_lines(n, files_per_dir, dirs_per_dir, deepest))
    long = (whole.agg(F.sum(F.length("line") + 1).alias("n")).first()["n"] or 0) > most_chars
    lines = tree_summary(n, files_per_dir, top_dirs) if long else whole
    return lines.select((F.row_number().over(Window.orderBy("key"))).alias("nth"), "line")  # lines are bounded by the caps


def nested(values: DataFrame, most: int = 10_000) -> DataFrame:
    """values(id, name, parent_id, depth, value) -> one row, json: nodes folded into their parents from the deepest level up.

    Children are sorted by falling value, then name. More than ``most`` nodes are an error: a drawing has no use for them, and one value can't hold any number.
    """
    if values.limit(most + 1).count() > most:
        raise ValueError(f"a nested document takes {most} nodes at the most; cut the tree first")
    rows = cut(values.select("id", "name", "parent_id", "depth", "value"))
    deepest = rows.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = rows.where(F.col("depth") == depth)
        own = F.to_json(F.struct("name", "value"))
        if below is None:
            said = own
        else:
            kids = below.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("less"), "name", "json"))), lambda k: k["json"]), ",").alias("kids"))
            level = level.join(kids.withColumnRenamed("parent_id", "_of"), F.col("id") == F.col("_of"), "left")
            said = F.when(F.col("kids").isNull(), own).otherwise(F.concat(F.expr("left(to_json(struct(name, value)), length(to_json(struct(name, value))) - 1)"), F.lit(',"children":['), "kids", F.lit("]}")))
        below = level.select("parent_id", "name", "value", said.alias("json"))
        if depth % 4 == 0:
            below = cut(below)
    return below.select("json") if below is not None else rows.select(F.lit("").alias("json"))


def code_areas(files: DataFrame, most: int = 8) -> DataFrame:
    """files(path, role) -> area, n: source files by first and by first two parts of the path."""
    p = P.parts(F.col("path"))
    own = files.where("role = 'source'").select(p.alias("p")).where(F.size("p") >= 2)
    areas = own.select(F.explode(F.array(F.get("p", F.lit(0)), F.array_join(F.slice("p", 1, 2), "/"))).alias("area"))
    return areas.groupBy("area").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), F.desc("area")).limit(most)


def boundaries(files: DataFrame, entries: DataFrame, most: int = 8) -> DataFrame:
    """files(path, role), entries(path, rank) -> project, source_files, test_files, entry, core_areas."""
    p = P.parts(F.col("path"))
    rooted = files.select(F.get(p, F.lit(0)).alias("project"), "role", F.when((F.col("role") == "source") & (F.size(p) >= 2), F.array_join(F.slice(p, 1, 2), "/")).alias("area"))
    by = rooted.groupBy("project").agg(F.count_if(F.col("role") == "source").alias("source_files"), F.count_if(F.col("role") == "test").alias("test_files"))
    # the two smallest areas of each project: a task passes on two a project
    areas = rooted.where("area is not null").select("project", "area").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("project").orderBy("area"))).where("nth <= 2")
    by = by.join(areas.groupBy("project").agg(F.array_sort(F.collect_list("area")).alias("core_areas")), "project", "left").withColumn("core_areas", F.coalesce("core_areas", F.array().cast("array<string>")))
    first = entries.groupBy(F.get(P.parts(F.col("path")), F.lit(0)).alias("project")).agg(F.min_by("path", "rank").alias("entry"))
    met = by.where("source_files > 0").join(first, "project", "left").fillna("", ["entry"])
    return met.orderBy(F.desc(F.col("entry") != ""), F.desc("source_files"), F.desc("test_files"), F.desc("project")).limit(most)
