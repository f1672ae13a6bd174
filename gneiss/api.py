"""From a source tree to an index and answers: what a user calls.

    index = build(spark, "/path/to/tree")
    search(index, pattern="parser"); overview(index); diff(old, index); rank(index, focus=["a.py"])
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import paths as P
from gneiss.functions import roles as R
from gneiss.functions import text as T_
from gneiss.operators import archetype, budget, project_map as PM, prompts as R_, diff as D, graph as G, mentions as M, overview as V, rank as K, rules as U, scoring, search as S, stats, tree, viz
from gneiss.plans.lineage import cut
from gneiss.sources import code, settings
from gneiss.sources.cache_store import CacheStore
from gneiss.sources.tree_source import changed_since, read_tree

Index = dict[str, DataFrame]


def build(spark: SparkSession, root: str, enricher: settings.Enricher = settings.first_comment) -> Index:
    """contents, files, signatures, modules, file_deps, module_deps of the tree's source and test files. A module is a top directory.

    What is read is kept in memory, as all tables are made of it, until ``release``.
    """
    raw = read_tree(spark, root).cache()
    kind = P.classify(F.col("path"), **settings.ignore_rules(root))
    kept = raw.withColumn("kind", kind["kind"]).where(F.col("kind").isin("source", "test", "infra", "generated")).select("path", "content", "kind")
    signatures = code.signatures(kept)
    counts = signatures.groupBy("path").agg(F.count("*").alias("n_sigs"))
    lang = F.coalesce(P.language(F.col("path")), F.lit("unknown"))
    module = F.when(F.size(P.parts(F.col("path"))) > 1, F.concat(F.lit("mod:"), F.get(P.parts(F.col("path")), F.lit(0)))).otherwise("")
    files = (
        kept.join(settings.enrich(kept, enricher), "path", "left")
        .join(counts, "path", "left")
        .select("path", "content", F.xxhash64("path").alias("ord"), lang.alias("lang"), module.alias("module"), F.array(lang, F.col("kind")).alias("tags"), F.coalesce("desc", F.lit("")).alias("desc"), F.coalesce("n_sigs", F.lit(0)).alias("n_sigs"))
        .withColumn("role", R.prompt_role(F.col("path"), F.col("tags")))
    )
    modules = scoring.module_scores(files).withColumn("desc", F.lit("")).withColumn("ord", F.xxhash64("module"))
    deps = code.import_dependencies(kept)
    owner = files.select("path", "module")
    across = deps.join(owner.select(F.col("path").alias("src"), F.col("module").alias("a")), "src").join(owner.select(F.col("path").alias("dst"), F.col("module").alias("b")), "dst")
    module_deps = G.module_dependencies(across.where("a <> '' and b <> ''").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("src").alias("src_file"), F.col("dst").alias("dst_file")))
    return {"contents": raw, "files": files, "signatures": signatures, "modules": modules, "file_deps": deps, "module_deps": module_deps}


def release(index: Index) -> None:
    """Let go of what ``build`` keeps; the index can still be used, and reads the tree again."""
    index["contents"].unpersist()


def search(index: Index, tags: list[str] | None = None, pattern: str | None = None, limit: int = 10) -> DataFrame:
    return S.search(index["files"], tags, pattern, index["signatures"], limit)


def overview(index: Index, tokens: int = 4000, project: dict | None = None) -> dict:
    return V.overview(project or {}, index["modules"], index["files"], tokens)


def expand(index: Index, target: str, level: int = 2, tokens: int = 2000) -> dict:
    return V.expand(index["files"], index["signatures"], target, level, tokens)


def statistics(index: Index) -> dict[str, DataFrame]:
    return {"modules": stats.module_distribution(index["modules"], index["files"]), "tags": stats.tag_frequency(index["files"]), "tiers": stats.tier_histogram(index["modules"]), "top": stats.top_files(index["files"]), "totals": stats.totals(index["files"])}


def diff(old: Index, new: Index) -> dict[str, DataFrame]:
    matched = D.module_matches(old["modules"], new["modules"], old["files"], new["files"])
    files, tags, modules = D.file_changes(old["files"], new["files"], matched), D.tag_changes(old["files"], new["files"]), D.module_changes(old["modules"], new["modules"], matched)
    return {"matched": matched, "files": files, "tags": tags, "modules": modules, "stats": D.stats_delta(stats.totals(old["files"]), stats.totals(new["files"])), "magnitude": D.magnitude(files, tags, modules)}


def findings(index: Index) -> DataFrame:
    return U.worst_first(U.run(index))


def rank(index: Index, focus: list[str] | None = None, mentioned: list[str] | None = None, method: str = "graph") -> DataFrame:
    """path, score, best first. By ``method``: path alone (heuristic), imports and path (graph), symbols and path (symbol).

    Where imports are too few the graph's ranking is that by path, and where there are no symbols theirs is the graph's.
    """
    files = index["files"].select("path")
    by_path = K.heuristic(files, focus, mentioned)
    if method == "heuristic":
        return by_path.orderBy(F.desc("score"), "path")
    if method == "symbol" and not index["signatures"].isEmpty():
        symbols = K.best_symbols(ranked_tags(index, focus, mentioned), K.tag_order())
        return K.symbol_blend(files, symbols, by_path).orderBy(F.desc("score"), "path")
    vertices = files.select(F.col("path").alias("id"))
    if G.density(vertices, index["file_deps"]).first()["too_sparse"]:
        return by_path.orderBy(F.desc("score"), "path")
    ranks = G.pagerank(vertices, index["file_deps"], G.focus_start(vertices, focus or [], mentioned or []), rounds=100, tolerance=1e-6)
    return G.blended(ranks, by_path.withColumnRenamed("path", "id")).withColumnRenamed("id", "path").orderBy(F.desc("score"), "path")


def ranked_tags(index: Index, focus: list[str] | None = None, mentioned: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """path, name, line, rank, of_file of the definitions: each by what the ranks of files that refer to it give it. In the order of ``rank.tag_order``.

    ``names`` are identifiers that a request mentions.
    """
    definitions = index["signatures"].select("path", "name", "line")
    references = code.tags(index["files"].select("path", "content")).where("tag = 'ref'").select("path", "name")
    vertices = index["files"].select(F.col("path").alias("id"))
    return K.tags_of_definitions(vertices, definitions, references, names, focus, G.focus_start(vertices, focus or [], mentioned or []), rounds=100, tolerance=1e-6)


def navigate(index: Index, text: str, focus: list[str] | None = None, tokens: int = 5000) -> DataFrame:
    """The files that a request is about, ranked, tiered and cut to a budget: path, tier, cost, rank."""
    spark = index["files"].sparkSession
    said = spark.createDataFrame([(0, text)], "id long, text string")
    named = [r["path"] for r in M.stems(said, index["files"]).unionByName(M.file_mentions(said, index["files"])).select("path").distinct().limit(50).collect()]
    coarse = K.heuristic(index["files"].select("path"), focus, named)
    fine = rank(index, focus, named)
    best = K.cascade(coarse, fine, spark.createDataFrame([(p,) for p in {*(focus or []), *named}], "path string"))
    costs = index["files"].select("path", T_.file_tokens(F.col("content")).alias("cost"))
    return budget.by_tier(best.join(costs, "path"), "path", tokens).select("path", "tier", "cost", "score", "rank")


def structure(index: Index, per_dir: int = 20, deepest: int = 4) -> DataFrame:
    return tree.visible(tree.nodes(index["files"].where(P.in_tree(F.col("path")))), per_dir, deepest)


def prompt(index: Index, tokens: int = 6000, mode: str = "auto") -> str:
    """Modules, key files, tests, signatures and the tree, as many of each as the profile shows and the budget has room for."""
    p = R_.profile(tokens, mode)
    files = index["files"].join(index["modules"].select("module", "core_score"), "module", "left").withColumn("desc", F.coalesce("desc", F.lit("")))
    best = K.source_files(index["files"], index["modules"]).join(files.select("path", "desc"), "path")
    tests = K.test_files(index["files"]).join(files.select("path", "desc"), "path")
    left = tokens - R_.tree_budget(tokens, True, p["tree_reserve_ratio"])
    share = budget.role_budgets(int(left * p["prefer_l2_ratio"]), {r["role"] for r in index["files"].select("role").distinct().collect()})
    order = [F.desc("score"), F.desc("n_sigs"), F.desc("path")]
    modules = V.module_lines(index["modules"], tokens).where(F.col("nth") <= p["module_lines"]).orderBy("nth")
    key = R_.key_file_lines(best, order, share["source"], p["key_files"]).orderBy("nth")
    test = R_.key_file_lines(tests, [F.desc("n_sigs"), F.desc("path")], share.get("test", 0), p["test_files"]).orderBy("nth")
    room = max(0, left - share["source"])
    said = R_.signature_lines(best, order, index["signatures"], room, p["signature_files"], p["sigs_per_file"]).orderBy("nth")
    room_of_tree = R_.tree_budget(tokens, True, p["tree_reserve_ratio"]) * T_.CHARS_PER_TOKEN
    nodes = tree.nodes(index["files"].select("path"))
    shape = tree.tree_text(nodes, room_of_tree, p["files_per_dir"], p["dirs_per_dir"], p["tree_depth"], p["top_summary_dirs"]).orderBy("nth")
    parts = [("## Modules", modules), ("## Key Files", key), ("### Test Files", test), ("## Signatures", said), ("## Directory Tree", shape)]
    told = [(head, [r["line"] for r in rows.collect()]) for head, rows in parts]
    return "\n".join(line for head, lines in told if lines for line in [head, "", *lines, ""])


def calls(index: Index, focus: str, hops: int = 1, most: int = 200) -> dict[str, DataFrame]:
    """nodes and links of the functions of a file and those within some calls of them."""
    made = code.call_dependencies(index["files"].select("path", "content"))
    edges = made.where("caller <> callee").groupBy("caller", "callee").agg(F.count("*").alias("weight"))
    near = G.function_neighbourhood(edges, focus, hops, most)
    return {"nodes": viz.function_nodes(near, index["files"], focus), "links": viz.function_links(edges, near)}


def changed(spark: SparkSession, root: str, listing: str) -> DataFrame:
    """What changed in a tree since its listing was kept at ``listing``, which is brought up to date: path, change, was. Only files that look changed are read."""
    store = CacheStore(spark, listing)
    before = store.load("listing")
    old = spark.createDataFrame([], "path string, size long, changed long, hash string") if before is None else before.select(F.col("key").alias("path"), "size", "changed", "hash")
    found = cut(changed_since(spark, root, old).select("path", "size", "changed", "hash", "change", "was"))
    gone = found.where("change = 'removed'").select(F.col("path").alias("key")).unionByName(found.where("change = 'renamed'").select(F.col("was").alias("key")))
    kept = found.where("change <> 'removed'").join(old.select("path", F.col("changed").alias("old_changed")), "path", "left").where("change <> 'same' or changed <> old_changed")
    store.commit({"listing": kept.select(F.col("path").alias("key"), "size", "changed", "hash")}, {"listing": gone})
    return found.where("change <> 'same'").select("path", "change", "was")


def project_map(index: Index, root: str = "", tokens: int = 6000) -> str:
    """The project's map: layout, entries, projects, a reading path and code areas, as the repository's kind has them."""
    kind = archetype.detect(index["files"].select("path"), index["modules"].select("ord", "desc"), root).first()["archetype"]
    files = index["files"].withColumn("score", F.lit(0.0))
    return PM.text(PM.project_map(files, kind, R_.profile(tokens)))


def context(index: Index, tier: str = "B", tokens: int = 0) -> str:
    """A summary of tier A (modules), B (with dependencies) or C (with files), cut to its tokens."""
    tier = tier.upper()
    room = (tokens or {"A": 500, "B": 2000, "C": 4000}.get(tier, 2000)) * T_.CHARS_PER_TOKEN
    totals = stats.totals(index["files"]).first()
    lines = ["# Project Context", "", f"Scale: {totals['total_files']} files, {totals['total_modules']} modules, {totals['total_signatures']} signatures", "", "## Modules"]
    # A line has a character at least, so no more of them can fit.
    lines += [r["line"] for r in R_.context_lines(index["modules"], tier).orderBy("ord").limit(room).collect()]
    if tier != "A":
        lines += ["", "## Module Dependencies", *(r["line"] for r in R_.dependency_lines(index["module_deps"]).orderBy("src").limit(room).collect())]
    if tier == "C":
        lines += ["", "## File Details", *(r["line"] for r in R_.detail_lines(index["files"], index["signatures"]).orderBy("ord").collect())]
    text = "\n".join(lines)
    return text if len(text) <= room else text[: room - 20] + "\n... (truncated)"


def snippets(index: Index, text: str, tokens: int = 2500) -> DataFrame:
    """Lines around the symbols of the files that a request is about, as many as the budget has room for."""
    ranked = navigate(index, text, tokens=4 * tokens).select("path", "score")
    said = M.identifiers(index["files"].sparkSession.createDataFrame([(0, text)], "id long, text string"), index["signatures"].select("name"))
    named = [r["ident"] for r in said.select("ident").distinct().limit(200).collect()]
    return R_.pack_snippets(R_.snippets(ranked, index["signatures"].select("path", "name", "line"), index["files"].select("path", "content"), named), tokens)
