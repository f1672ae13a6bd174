"""The parts of a structure prompt: which files, signatures, changes, steps and snippets are said, by profile and budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P
from gneiss.functions import text as T
from gneiss.operators import budget as B
from gneiss.operators.ordered import numbered

# By tokens (up to), a profile's name and what it shows.
SIZES = "files_per_dir dirs_per_dir top_summary_dirs tree_depth module_lines key_files test_files signature_files sigs_per_file llm_reading_items llm_axes_items llm_hotspots_items".split()
PROFILES = [
    (2500, "small", (6, 8, 10, 3, 7, 12, 4, 3, 4, 4, 3, 2), 0.75, 0.65),
    (6000, "medium", (10, 12, 18, 4, 10, 18, 8, 14, 10, 6, 5, 4), 0.55, 0.50),
    (9000, "large", (14, 18, 26, 5, 14, 28, 12, 24, 14, 8, 6, 6), 0.45, 0.40),
    (None, "xlarge", (20, 26, 36, 6, 16, 56, 16, 40, 18, 10, 8, 8), 0.40, 0.35),
]
# Bounds of a map's and of a deep prompt's sizes.
MAP_AT_MOST = {"tree_depth": 4, "files_per_dir": 10, "dirs_per_dir": 14, "module_lines": 10, "key_files": 22, "test_files": 6, "signature_files": 16, "sigs_per_file": 10, "llm_reading_items": 6, "llm_axes_items": 5, "llm_hotspots_items": 4}
MAP_AT_LEAST = {"key_files": 14, "signature_files": 8, "sigs_per_file": 6}
DEEP_AT_LEAST = {"tree_depth": 5, "files_per_dir": 14, "dirs_per_dir": 18, "module_lines": 16, "key_files": 40, "test_files": 12, "signature_files": 34, "sigs_per_file": 16, "llm_reading_items": 10, "llm_axes_items": 8, "llm_hotspots_items": 8}
SHARES = {"map": (0.62, 0.52), "deep": (0.36, 0.30)}


def profile(tokens: int, mode: str | None = "auto") -> dict:
    """What a prompt of so many tokens shows. ``mode``: auto, map or deep; anything else is auto."""
    _, name, sizes, files_share, tree_share = next(p for p in PROFILES if p[0] is None or tokens <= p[0])
    out = dict(zip(SIZES, sizes, strict=True))
    brief = name != "small"
    mode = (mode or "").strip().lower()
    if mode == "map":
        out |= {k: max(MAP_AT_LEAST.get(k, 0), min(out[k], v)) for k, v in MAP_AT_MOST.items()}
        brief = tokens >= 3000
    elif mode == "deep":
        out |= {k: max(out[k], v) for k, v in DEEP_AT_LEAST.items()}
        brief = True
    if mode in SHARES:
        name, (files_share, tree_share) = f"{name}-{mode}", SHARES[mode]
    return {"name": name, **out, "include_llm_brief": brief, "include_signatures": True, "prefer_l2_ratio": files_share, "tree_reserve_ratio": tree_share}


def tree_budget(left: int, has_files: bool, reserve: float) -> int:
    """Tokens for the tree, at least 120: what files and signatures aren't to have."""
    return max(120, left - (int(left * reserve) if has_files else 0))


# Files and signatures


def file_line() -> Column:
    desc = F.when(F.coalesce("desc", F.lit("")) != "", F.concat(F.lit(": "), "desc")).otherwise("")
    count = F.when(F.col("n_sigs") > 0, F.concat(F.lit(" ("), F.col("n_sigs").cast("string"), F.lit(" symbols)"))).otherwise("")
    return F.concat(F.lit("- `"), "path", F.lit("`"), desc, count)


def key_file_lines(ranked: DataFrame, order: list[Column], budget: int, cap: int) -> DataFrame:
    """ranked(path, desc, n_sigs, ...) in ``order`` -> nth, path, line, cost, used: up to ``cap`` files and the first that doesn't fit."""
    told = ranked.withColumn("line", file_line()).withColumn("cost", T.tokens(F.concat("line", F.lit("\n"))))
    return B.capped(told, order, "cost", budget, cap).select("nth", "path", "line", "cost", "used")


def signature_lines(ranked: DataFrame, order: list[Column], signatures: DataFrame, budget: int, cap: int, per_file: int) -> DataFrame:
    """As ``key_file_lines`` for signatures(path, ord, kind, name) of the files that have any: kinds and names of the first ``per_file``."""
    own = Window.partitionBy("path").orderBy("ord", "name")
    few = signatures.withColumn("_nth", F.row_number().over(own)).where(F.col("_nth") <= per_file)
    named = few.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", F.concat_ws(" ", "kind", "name").alias("said")))), lambda x: x["said"]), ", ").alias("said"))
    told = ranked.join(named, "path").withColumn("line", F.concat(F.lit("- `"), "path", F.lit("`: "), "said"))
    return B.capped(told.withColumn("cost", T.tokens(F.concat("line", F.lit("\n")))), order, "cost", budget, cap).select("nth", "path", "line", "cost", "used")


def key_files(files: DataFrame, most: int = 24) -> DataFrame:
    """files(ord, path, role, desc, score) -> the source files of largest score, the first of equals: nth, path, desc."""
    w = Window.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "ord")
    return files.where("role = 'source'").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("nth", "path", F.coalesce("desc", F.lit("")).alias("desc"))


def by_directory(files: DataFrame, budget: int) -> DataFrame:
    """files(ord, path, cost, lines) -> those taken, directory after directory (most lines first, the first of equals), skipping what doesn't fit."""
    top = F.when(F.size(P.parts(F.col("path"))) > 1, F.get(P.parts(F.col("path")), F.lit(0))).otherwise(".")
    own = files.withColumn("dir", top)
    sizes = own.groupBy("dir").agg(F.sum("lines").alias("dir_lines"), F.min("ord").alias("dir_first"))
    return B.skip_overflow(own.join(sizes, "dir"), "path", [("dir_lines", True), ("dir_first", False), ("ord", False), ("path", False)], "cost", budget)


# Changes and reports


def said_changes(changes: DataFrame) -> DataFrame:
    """changes(ord, id, name, change) but for noise."""
    path = F.regexp_replace("id", "^[^:]*:", "")
    return changes.where(~F.coalesce((path != "") & P.is_noise(path), F.lit(False)))


def change_counts(changes: DataFrame) -> DataFrame:
    return said_changes(changes).groupBy(F.coalesce("change", F.lit("unknown")).alias("change")).agg(F.count("*").alias("n"))


def change_lines(changes: DataFrame, most: int = 40) -> DataFrame:
    """nth, line: the first ``most`` changes that aren't noise."""
    w = Window.orderBy("ord", "id")
    first = said_changes(changes).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    return first.select("nth", F.concat(F.lit("- ["), F.coalesce("change", F.lit("?")), F.lit("] "), F.coalesce("name", "id", F.lit("?"))).alias("line"))


def tag_report(tags: DataFrame, order: list[Column], most: int) -> DataFrame:
    """tags(path, line, name, kind) -> rank, said: the first ``most`` as a table's lines."""
    ranked = tags.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("rank", F.format_string("%-6d %-40s %-6d %-30s %-10s", "rank", "path", "line", "name", "kind").alias("said"))


def steps(boundaries: DataFrame, entries: DataFrame, areas: DataFrame, most: int = 5) -> DataFrame:
    """boundaries(nth, project, entry, area), entries(nth, path, reason), areas(nth, area, n) -> nth, target, step.

    Where to begin reading: the first two projects' entries, then their areas; without any of these the first two
    entries; then the first two areas. A target is named once, by what comes first. All are a few rows.
    """
    first = boundaries.where("nth <= 2")
    read = first.select(F.lit(1).alias("kind"), "nth", F.col("entry").alias("target"), F.concat(F.lit("Read `"), "entry", F.lit("` to understand `"), "project", F.lit("` runtime entry.")).alias("step"))
    core = first.select(F.lit(2).alias("kind"), "nth", F.col("area").alias("target"), F.concat(F.lit("Expand `"), "area", F.lit("` for core implementation details.")).alias("step"))
    start = entries.where("nth <= 2").select(F.lit(3).alias("kind"), "nth", F.col("path").alias("target"), F.concat(F.lit("Read `"), "path", F.lit("` ("), "reason", F.lit(") for initial orientation.")).alias("step"))
    dense = areas.where("nth <= 2").select(F.lit(4).alias("kind"), "nth", F.col("area").alias("target"), F.concat(F.lit("Expand `"), "area", F.lit("` for dense implementation coverage (~"), F.col("n").cast("string"), F.lit(" source files).")).alias("step"))
    every = read.unionByName(core).unionByName(start).unionByName(dense).where(F.coalesce("target", F.lit("")) != "")
    known = F.max(F.when(F.col("kind") <= 2, 1).otherwise(0)).over(Window.partitionBy())
    every = every.withColumn("known", known).where((F.col("kind") != 3) | (F.col("known") == 0))
    once = every.withColumn("again", F.row_number().over(Window.partitionBy("target").orderBy("kind", "nth"))).where("again = 1")
    return once.withColumn("nth", F.row_number().over(Window.orderBy("kind", "nth"))).where(F.col("nth") <= most).select("nth", "target", "step")


# Path sets


def candidate_paths(*sources: DataFrame) -> DataFrame:
    """Frames of one column of paths -> path: all of them once, but the empty one."""
    out = None
    for s in sources:
        named = s.toDF("path")
        out = named if out is None else out.unionByName(named)
    return out.where("path <> ''").distinct()


def merged(*sources: DataFrame) -> DataFrame:
    """Frames (nth, path) -> place, path: in the order of sources, each path where it comes first. Places are counted in sorted ranges."""
    every = None
    for k, s in enumerate(sources):
        part = s.select(F.lit(k).alias("source"), "nth", "path")
        every = part if every is None else every.unionByName(part)
    once = every.groupBy("path").agg(F.min(F.struct("source", "nth")).alias("at")).select("at.source", "at.nth", "path")
    return numbered(once, [F.asc("source"), F.asc("nth"), F.asc("path")]).select((F.col("place") + 1).alias("place"), "path")


def local_results(compressed: DataFrame, signatures: DataFrame, **rules) -> DataFrame:
    """compressed(path), signatures(path) -> path, desc, tags: results without a model, for the architecture's files of either."""
    every = compressed.select("path").unionByName(signatures.select("path")).distinct()
    kept = every.where(P.classify(F.col("path"), **rules)["in_architecture"])
    return kept.select("path", F.lit("").alias("desc"), F.array().cast("array<string>").alias("tags"))


# Snippets


def snippets(ranked: DataFrame, tags: DataFrame, contents: DataFrame, mentioned: list[str] | None = None, per_file: int = 2, cap: int = 500) -> DataFrame:
    """ranked(path, score), tags(path, name, line), contents(path, content) -> path, score, nth, name, line, content, cost.

    A file's first tags (mentioned ones, then public ones, by line) with the lines around them, cut to ``cap`` tokens.
    """
    said = F.lower("name").isin([m.lower() for m in mentioned]) if mentioned else F.lit(False)
    order = Window.partitionBy("path").orderBy((~said).cast("int"), F.col("name").startswith("_").cast("int"), "line", "name")
    few = tags.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_file)
    lines = F.split("content", "\n")
    begin = F.greatest(F.col("line") - 2, F.lit(1)).cast("int")
    window = F.array_join(F.slice(lines, begin, (F.col("line") + 10).cast("int") - begin), "\n")
    shown = few.join(ranked.select("path", "score"), "path").join(contents.select("path", "content"), "path").where(F.size(lines) >= begin).withColumn("shown", window)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def step(a, x):
        full = a["full"] | (a["used"] + T.tokens(x) > cap)
        return F.struct(F.when(full, a["used"]).otherwise(a["used"] + T.tokens(x)).alias("used"), F.when(full, a["kept"]).otherwise(a["kept"] + 1).alias("kept"), full.alias("full"))

    cut = F.aggregate(F.split("shown", "\n"), start, step)
    whole = T.tokens(F.col("shown")) <= cap
    told = shown.where(F.trim(F.regexp_replace("shown", r"\s", " ")) != "").withColumn("cut", cut)
    content = F.when(whole, F.col("shown")).otherwise(F.array_join(F.slice(F.split("shown", "\n"), F.lit(1), F.col("cut.kept")), "\n"))
    return told.select("path", "score", "nth", "name", "line", content.alias("content"), F.when(whole, T.tokens(F.col("shown"))).otherwise(F.col("cut.used")).alias("cost"))


def pack_snippets(found: DataFrame, budget: int = 2500, chunk: int = 1_000) -> DataFrame:
    """snippets -> those that a prompt has room for: files by score, then path; a file ends at its first snippet that doesn't fit.

    A file is taken up if its first snippet still fits, so the walk asks Spark for the next files of which it does:
    a distributed top-k of keys and costs; what it takes can't number more than the budget.
    """
    rows = found.groupBy("path", "score").agg(F.array_sort(F.collect_list(F.struct("nth", F.greatest("cost", F.lit(1)).alias("cost")))).alias("items"))
    taken, left, last = [], budget, None
    while left > 0:
        able = rows.where(F.get("items", F.lit(0))["cost"] <= left)
        if last is not None:
            able = able.where((F.col("score") < F.lit(last["score"])) | ((F.col("score") == F.lit(last["score"])) & (F.col("path") > F.lit(last["path"]))))
        got = able.orderBy(F.desc("score"), "path").limit(chunk).collect()
        for r in got:
            for item in r["items"]:
                if left <= 0 or item["cost"] > left:
                    break
                left -= item["cost"]
                taken.append((r["path"], item["nth"], len(taken) + 1))
        if len(got) < chunk:
            break
        last = got[-1]
    return found.join(found.sparkSession.createDataFrame(taken, "path string, nth int, place int"), ["path", "nth"])


def without_headers(lines: DataFrame, shown: list[str]) -> DataFrame:
    """lines(ord, line) of Markdown but for headers that name a file of ``shown``: as all they say, or behind a space or slash."""
    if not shown:
        return lines
    head = F.trim("line").startswith("#")
    said = F.trim(F.regexp_replace("line", "^#+", ""))
    named = F.exists(F.array(*map(F.lit, shown)), lambda f: (said == f) | F.contains("line", F.concat(F.lit(" "), f)) | F.contains("line", F.concat(F.lit("/"), f)))
    return lines.where(~(head & named))


# Summaries


def context_lines(modules: DataFrame, tier: str = "B") -> DataFrame:
    """modules(ord, module, tier, role, file_count, desc) -> ord, line: what a context of tier A, B or C says of modules."""
    desc = F.substring(F.coalesce("desc", F.lit("")), 1, 60 if tier.upper() == "A" else 120)
    line = F.concat(F.lit("- "), "module", F.lit(" ["), F.coalesce("tier", F.lit("?")), F.lit("/"), F.coalesce("role", F.lit("?")), F.lit("] files="), F.coalesce("file_count", F.lit(0)).cast("string"), F.when(desc != "", F.concat(F.lit(" — "), desc)).otherwise(""))
    return modules.select("ord", line.alias("line"))


def dependency_lines(module_deps: DataFrame, most: int = 5) -> DataFrame:
    """module_deps(src, dst, rank) -> src, line: a module's first targets."""
    few = module_deps.where(F.col("rank") <= most).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("to"))
    return few.select("src", F.concat(F.lit("  "), "src", F.lit(" → "), F.array_join("to", ", ")).alias("line"))


def detail_lines(files: DataFrame, signatures: DataFrame, most: int = 50) -> DataFrame:
    """files(ord, path, desc, tags), signatures(path, ord, name) -> ord, line of the first ``most`` files: description, four tags, five names."""
    first = files.withColumn("_nth", F.row_number().over(Window.orderBy("ord"))).where(F.col("_nth") <= most)
    own = signatures.join(first.select("path"), "path", "left_semi")
    few = own.withColumn("_nth", F.row_number().over(Window.partitionBy("path").orderBy("ord", "name"))).where("_nth <= 5")
    named = few.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "name"))), lambda x: x["name"]), ", ").alias("names"))
    desc = F.when(F.coalesce("desc", F.lit("")) != "", F.concat(F.lit(": "), F.substring("desc", 1, 80))).otherwise("")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join(F.slice("tags", 1, 4), ", "), F.lit("]"))).otherwise("")
    sigs = F.when(F.col("names").isNotNull(), F.concat(F.lit(" sigs: "), "names")).otherwise("")
    return first.join(named, "path", "left").select("ord", F.concat(F.lit("- "), "path", desc, tags, sigs).alias("line"))


def language_hint(text: Column) -> Column:
    """The language to describe in: Chinese where over 0.3 of a read-me's first 500 characters are, else English."""
    head = F.substring(text, 1, 500)
    share = F.length(F.regexp_replace(head, "[^\\x{4e00}-\\x{9fff}]", "")) / F.greatest(F.length(head), F.lit(1))
    return F.when(share > 0.3, "zh").otherwise("en")


def vocabulary_lines(vocabulary: DataFrame) -> DataFrame:
    """vocabulary(dimension, tag) -> dimension, line: its tags in order. A vocabulary is small by its nature."""
    return vocabulary.groupBy("dimension").agg(F.concat(F.lit("  "), F.col("dimension"), F.lit(": "), F.array_join(F.array_sort(F.collect_set("tag")), ", ")).alias("line"))


def vocabulary_snapshot(vocabulary: DataFrame) -> DataFrame:
    """vocabulary(dimension, tag, ord) -> one row, snapshot: a map of each dimension's tags in their order, new ones last. A vocabulary is small by its nature."""
    listed = vocabulary.groupBy("dimension").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag"))), lambda x: x["tag"]).alias("tags"))
    return listed.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "tags")))).alias("snapshot"))


def vocabulary_hash(vocabulary: DataFrame) -> DataFrame:
    """One row, hash: of the canonical JSON of sorted dimensions, each with all its tags sorted, repeats included. The same in any order of rows."""
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    listed = vocabulary.groupBy("dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list("tag")), text), ", ").alias("tags"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("dimension", "tags"))), lambda x: F.concat(text(x["dimension"]), F.lit(": ["), x["tags"], F.lit("]")))
    said = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return listed.agg(F.sha2(escaped(said), 256).substr(1, 16).alias("hash"))


def escaped(json: Column) -> Column:
    """JSON text with all but ASCII as \\u escapes, in UTF-16 units as JSON has them."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    parts = F.regexp_extract_all(json, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^[\x00-\x7F]"), p).otherwise(units(p))), "")
