"""The engine's operators as queries on the driver's tables. Arrays are shown as text, so results compare plainly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P
from gneiss.functions import roles as R
from gneiss.functions import text as T
from gneiss.operators import archetype, budget, deps, diff, graph, incremental, mentions, overview, prompts, quality, rank, rules, scoring, search, stats, tree, viz
from gneiss.sources import corpus as C
from gneiss.sources import probe, snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shown(array: str) -> Column:
    return F.concat_ws(",", array).alias(array)


# Scores, roles, statistics


@query
def module_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.module_scores(C.counted_files(spark, sf))


@query
def file_roles(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).select(R.file_role(F.col("path"), F.col("tags")).alias("role"), R.prompt_role(F.col("path"), F.col("tags")).alias("prompt_role"), R.role_bonus(F.col("tags")).alias("bonus"))
    return f.groupBy("role", "prompt_role", "bonus").agg(F.count("*").alias("n"))


@query
def file_priors(spark: SparkSession, sf: str) -> DataFrame:
    f = C.counted_files(spark, sf)
    return scoring.file_priors(f, scoring.module_scores(f)).select("path", F.round("prior", 9).alias("prior"))


@query
def module_distribution(spark: SparkSession, sf: str) -> DataFrame:
    f = C.counted_files(spark, sf)
    m = scoring.module_scores(f).select("module", "tier", F.row_number().over(Window.orderBy("module")).alias("ord"))
    return stats.module_distribution(m, f)


@query
def module_bars(spark: SparkSession, sf: str) -> DataFrame:
    return stats.bars(C.files(spark, sf).where("module <> ''").groupBy("module").agg(F.count("*").alias("file_count")))


@query
def tag_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tag_frequency(C.files(spark, sf))


@query
def tier_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tier_histogram(scoring.module_scores(C.counted_files(spark, sf)))


@query
def top_files(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_files(C.counted_files(spark, sf))


@query
def index_totals(spark: SparkSession, sf: str) -> DataFrame:
    return stats.totals(C.counted_files(spark, sf))


@query
def primary_language(spark: SparkSession, sf: str) -> DataFrame:
    return stats.primary_language(C.files(spark, sf).select("ord", P.language(F.col("path")).alias("lang")))


@query
def stats_history(spark: SparkSession, sf: str) -> DataFrame:
    months = C.files(spark, sf).groupBy(F.date_format("day", "yyyy-MM").alias("snapshot_id")).agg(F.count("*").alias("total_files"))
    return stats.series(months, "total_files")


@query
def sparkline(spark: SparkSession, sf: str) -> DataFrame:
    months = C.files(spark, sf).groupBy(F.date_format("day", "yyyy-MM").alias("snapshot_id")).agg(F.count("*").alias("total_files"))
    return stats.sparkline(months, "total_files")


# Search


@query
def search_tags(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(C.files(spark, sf), ["api", "urgent", "missing"], limit=25).select("path", "score", "module", shown("tags"))


@query
def search_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(C.files(spark, sf), pattern="Fn_1", signatures=C.signatures(spark, sf), limit=40).select("path", "score", "module", shown("tags"))


@query
def search_combined(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(C.files(spark, sf), ["core-lib", "high"], "routes_1", C.signatures(spark, sf), limit=30).select("path", F.round("score", 6).alias("score"), "module")


# Paths


@query
def classify_paths(spark: SparkSession, sf: str) -> DataFrame:
    c = P.classify(F.col("path"), paths=("web/generated",), globs=("*.toml",), extensions=(".xyz",))
    return C.files(spark, sf).select(c.alias("c")).groupBy("c.kind", "c.reason", "c.in_architecture", "c.in_test_support").agg(F.count("*").alias("n"))


@query
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    kept = C.files(spark, sf).select("path", P.language(F.col("path")).alias("language"), P.classify(F.col("path")).alias("c"))
    return kept.where(~F.col("c.kind").isin("ignored", "hidden", "runtime_artifact", "excluded", "doc", "fixture")).select("path", F.coalesce("language", F.lit("")).alias("language"), F.col("c.kind").alias("kind"))


@query
def visible_paths(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).select(P.in_tree(F.col("path")).alias("in_tree"), P.is_noise(F.col("path")).alias("noise"), F.col("ord") % 12 == 4)
    return f.groupBy("in_tree", "noise").agg(F.count("*").alias("n"))


@query
def languages(spark: SparkSession, sf: str) -> DataFrame:
    return C.files(spark, sf).groupBy(F.coalesce(P.language(F.col("path")), F.lit("")).alias("language")).agg(F.count("*").alias("n"))


@query
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*/?", ""), r"[?#].*$", "")
    return C.table(spark, sf, "pages").select("page_id", path.alias("path")).select("page_id", P.name(F.col("path")).alias("name"), P.suffix(F.col("path")).alias("suffix"), F.size(P.parts(F.col("path"))).alias("depth"))


@query
def known_paths(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).select("ord", "path")
    raw = f.select("ord", F.when(F.col("ord") % 3 == 0, F.upper("path")).when(F.col("ord") % 3 == 1, F.concat(F.lit("/"), F.replace("path", F.lit("/"), F.lit("\\")))).otherwise(F.concat(F.lit("../"), "path")).alias("raw"))
    return deps.known(F.col("raw"), raw, f.select("path")).select("ord", "found")


# Text


@query
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"), T.file_tokens(F.col("text")).alias("file_tokens"), T.line_count(F.col("text")).alias("lines"), T.meaningful(F.col("text")).alias("meaningful"))


@query
def truncate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "documents").select("doc_id", F.sha2(T.truncated_lines(F.col("text"), 100), 256).alias("cut"))


@query
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


# Differences: orders with keys not divisible by 10 against those that aren't 1 modulo 10


def old_files(spark: SparkSession, sf: str, counted: bool = False) -> DataFrame:
    return (C.counted_files if counted else C.files)(spark, sf).where("ord % 10 <> 0")


def new_files(spark: SparkSession, sf: str, counted: bool = False) -> DataFrame:
    f = (C.counted_files if counted else C.files)(spark, sf).where("ord % 10 <> 1")
    module = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("split-"), "module")).otherwise(F.concat(F.lit("new-"), "module"))
    return f.withColumn("module", module).withColumn("tags", F.when(F.col("ord") % 3 == 0, F.array(F.get("tags", F.lit(0)), F.lit("changed"))).otherwise(F.col("tags")))


def modules_of(files: DataFrame) -> DataFrame:
    return files.where("module <> ''").select("module").distinct().withColumn("ord", F.row_number().over(Window.orderBy("module")))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    old, new = old_files(spark, sf), new_files(spark, sf)
    return diff.module_matches(modules_of(old), modules_of(new), old, new)


@query
def diff_files(spark: SparkSession, sf: str) -> DataFrame:
    changes = diff.file_changes(old_files(spark, sf), new_files(spark, sf), matches(spark, sf))
    return changes.select("path", "change", *[F.coalesce(c, F.lit("")).alias(c) for c in ("old_module", "new_module")])


@query
def diff_tags(spark: SparkSession, sf: str) -> DataFrame:
    return diff.tag_changes(old_files(spark, sf), new_files(spark, sf)).select("path", shown("added"), shown("removed"))


@query
def module_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return diff.module_likeness(old_files(spark, sf), new_files(spark, sf)).select("old_id", "new_id", "shared", F.round("jaccard", 6).alias("jaccard"))


@query
def module_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf)


@query
def module_changes(spark: SparkSession, sf: str) -> DataFrame:
    return diff.module_changes(modules_of(old_files(spark, sf)), modules_of(new_files(spark, sf)), matches(spark, sf))


@query
def stats_delta(spark: SparkSession, sf: str) -> DataFrame:
    return diff.stats_delta(stats.totals(old_files(spark, sf, True)), stats.totals(new_files(spark, sf, True)))


@query
def change_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    return diff.change_magnitude(old_files(spark, sf), new_files(spark, sf))


# Trees


@query
def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.nodes(C.files(spark, sf)).fillna("", ["parent_id"])


@query
def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    return tree.tree_changes(tree.nodes(old_files(spark, sf)), tree.nodes(new_files(spark, sf)))


@query
def tree_topn(spark: SparkSession, sf: str) -> DataFrame:
    return tree.visible(tree.nodes(C.files(spark, sf)), 5, 2)


@query
def treemap(spark: SparkSession, sf: str) -> DataFrame:
    return tree.treemap(C.counted_files(spark, sf).select("path", F.col("n_sigs").alias("size")))


def with_roles(files: DataFrame) -> DataFrame:
    return files.withColumn("role", R.prompt_role(F.col("path"), F.col("tags")))


@query
def code_areas(spark: SparkSession, sf: str) -> DataFrame:
    return tree.code_areas(with_roles(C.files(spark, sf)))


@query
def project_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    f = with_roles(C.files(spark, sf))
    entries = rank.entry_files(f.withColumn("score", F.lit(0.0))).withColumn("rank", F.struct(-F.col("score"), "path"))
    return tree.boundaries(f, entries).select("project", "source_files", "test_files", "entry", shown("core_areas"))


# Budgets


def costed(spark: SparkSession, sf: str) -> DataFrame:
    d = C.table(spark, sf, "documents").select("doc_id", "lang", "source", T.tokens(F.col("text")).cast("long").alias("cost"))
    return d.withColumn("score", F.round(1 / (1 + F.col("doc_id") % 97), 6)).withColumn("tier", (F.col("doc_id") % 3 + 1).cast("int"))


@query
def overview_budget(spark: SparkSession, sf: str) -> DataFrame:
    kept = budget.stop_at_overflow(costed(spark, sf), [F.desc("score"), F.asc("doc_id")], "cost", 20_000, ["lang"])
    return kept.select("lang", "doc_id", "cost", "used", "nth")


@query
def trim_greedy(spark: SparkSession, sf: str) -> DataFrame:
    d = costed(spark, sf).withColumn("key", F.round(budget.hybrid_key(F.col("score"), F.col("cost")), 9))
    return budget.skip_overflow(d, "doc_id", [("key", True), ("doc_id", False)], "cost", 10_000).select("doc_id", "cost", "key", "rank")


@query
def tier_budget_select(spark: SparkSession, sf: str) -> DataFrame:
    return budget.by_tier(costed(spark, sf), "doc_id", 10_000).select("doc_id", "tier", "cost", "rank")


@query
def batch_pack(spark: SparkSession, sf: str) -> DataFrame:
    packed = budget.batches(costed(spark, sf).withColumn("queue", F.col("doc_id") % 40), "queue", "doc_id", "cost")
    return packed.select("queue", "doc_id", "cost", "batch")


# Ranking


@query
def heuristic_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rank.heuristic(C.files(spark, sf), ["src/core/engine_8.py"], ["cli/cli_2.py"]).withColumn("score", F.round("score", 6))


@query
def source_rank(spark: SparkSession, sf: str) -> DataFrame:
    f = with_roles(C.counted_files(spark, sf))
    return rank.source_files(f, scoring.module_scores(f)).withColumn("score", F.round("score", 6))


@query
def test_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rank.test_files(with_roles(C.counted_files(spark, sf)))


def repository_kinds_of(spark: SparkSession, sf: str) -> DataFrame:
    return archetype.detect(C.repositories(spark, sf), C.repository_modules(spark, sf), F.col("repo"), ["repo"])


@query
def repository_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return repository_kinds_of(spark, sf)


@query
def entry_rank(spark: SparkSession, sf: str) -> DataFrame:
    f = C.repositories(spark, sf).withColumn("tags", F.array().cast("array<string>"))
    scored = with_roles(f).withColumn("score", F.col("ord") % 7 / 10)
    return rank.entry_files(scored, repository_kinds_of(spark, sf), ["repo"]).withColumn("score", F.round("score", 6))


@query
def snippet_tags(spark: SparkSession, sf: str) -> DataFrame:
    return rank.snippet_tags(C.signatures(spark, sf).select("path", "name", "line"), ["fn_1", "fn_10"]).select("path", "name", "line", "nth")


@query
def symbol_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rank.symbol_scores(C.signatures(spark, sf), [F.desc("name"), F.asc("path"), F.asc("line")]).withColumn("score", F.round("score", 9))


@query
def rank_cascade(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).select("path", "ord")
    coarse = rank.heuristic(f)
    fine = f.select("path", F.round(1 / (1 + F.col("ord") % 89), 6).alias("score"))
    return rank.cascade(coarse, fine, f.where("ord in (1, 2, 3)").select("path"))


# Dependencies


def contents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("ord")
    near = (k - k % 12 + 8).cast("string")
    lines = F.concat(F.lit("import os\nimport core.engine_"), near, F.lit("\nfrom core.engine_"), near, F.lit(" import run\nx = 1"))
    return C.files(spark, sf).select("path", lines.alias("content"))


@query
def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    return deps.file_dependencies(contents(spark, sf))


@query
def module_deps_top10(spark: SparkSession, sf: str) -> DataFrame:
    return graph.module_dependencies(C.module_edges(spark, sf)).select("src", "dst", "weight", "rank", shown("files"))


def named_spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, definitions and spans of functions: events that aren't, and that are, a fifth one."""
    e = event_spans(spark, sf).withColumn("called", F.concat(F.lit("f"), (F.floor(F.col("event_id") / 7) % 40).cast("string")))
    spans = e.where("event_id % 5 = 0").select("path", F.col("event_id").cast("string").alias("name"), F.col("line").alias("start"), (F.col("line") + 60 + F.col("event_id") % 1000).alias("end"))
    return e.where("event_id % 5 <> 0").select("path", "event_id", F.col("called").alias("name"), "line"), e.where("event_id % 5 = 0").select(F.col("called").alias("name"), "path").distinct(), spans


def calls_and_callees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Calls counted by caller and name, and the functions of each name."""
    references, definitions, spans = named_spans(spark, sf)
    return graph.counted_calls(deps.calls_by_name(references, spans), ["caller", "name"]), deps.callees(definitions)


@query
def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    calls, callees = calls_and_callees(spark, sf)
    return graph.call_pairs(calls, callees).select("caller", "callee", "weight", shown("lines"))


@query
def module_calls(spark: SparkSession, sf: str) -> DataFrame:
    e = C.module_edges(spark, sf).select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "line")
    return graph.call_dependencies(e).select("caller", "callee", "weight", shown("lines"))


@query
def symbol_tables(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("kind") == "A", "def").when(F.col("kind") == "N", "ref").otherwise("none")
    return deps.symbol_graph(C.signatures(spark, sf).select("path", "name", tag.alias("tag"))).select("name", shown("definitions"), "references")


@query
def fan_in(spark: SparkSession, sf: str) -> DataFrame:
    return graph.fan_in(deps.file_dependencies(contents(spark, sf)))


@query
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.high_fan_out({"module_deps": graph.module_dependencies(C.module_edges(spark, sf))})
    return found.select("subject", "severity", F.get_json_object("detail", "$.out_degree").cast("long").alias("n"))


def event_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as spans: from an event's second in its day, as long as its value says, nested at will."""
    second = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")
    return C.table(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("path"), "event_id", second.alias("line"))


@query
def enclosing_interval(spark: SparkSession, sf: str) -> DataFrame:
    e = event_spans(spark, sf)
    spans = e.where("event_id % 5 = 0").select("path", F.col("event_id").cast("string").alias("name"), F.col("line").alias("start"), (F.col("line") + 60 + F.col("event_id") % 1000).alias("end"))
    return deps.enclosing(e.where("event_id % 5 <> 0"), spans, 256)


@query
def asof_parent(spark: SparkSession, sf: str) -> DataFrame:
    e = event_spans(spark, sf)
    tags = e.select("path", F.col("event_id").alias("ord"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"), F.when(F.col("event_id") % 7 == 0, "class").otherwise("function").alias("kind"), "line")
    return deps.parent_of(tags).select("ord", F.coalesce("parent", F.lit("")).alias("parent"))


@query
def suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    wanted = C.files(spark, sf).select(P.name(F.col("path")).alias("suffix")).unionByName(spark.createDataFrame([("core/engine_20.py",)], "suffix string"))
    return deps.suffix_join(wanted.distinct(), C.files(spark, sf).select("path"))


@query
def cross_module_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = deps.file_dependencies(contents(spark, sf)).select("src", "dst")
    return deps.cross_module(edges, C.files(spark, sf)).groupBy("src_module", "dst_module", "crosses").agg(F.count("*").alias("n"))


@query
def reference_edges(spark: SparkSession, sf: str) -> DataFrame:
    s = C.signatures(spark, sf)
    definitions, references = s.where("kind = 'A'").select("name", "path"), s.where("kind = 'N'").select("name", "path")
    return graph.reference_edges(definitions, references, ["fn_7"], ["src/core/engine_8.py"]).withColumn("weight", F.round("weight", 6))


# Graphs


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "events").select(F.col("user_id").alias("id")).where("id is not null").distinct()


@query
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    ranks = graph.pagerank(vertices(spark, sf), C.user_edges(spark, sf), rounds=10)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


@query
def pagerank_personalized(spark: SparkSession, sf: str) -> DataFrame:
    start = graph.focus_start(vertices(spark, sf), [3, 5], [7])
    ranks = graph.pagerank(vertices(spark, sf), C.user_edges(spark, sf), start, rounds=10)
    return ranks.select("id", F.round("rank", 9).alias("rank"))


def scores_of_users(spark: SparkSession, sf: str) -> DataFrame:
    return vertices(spark, sf).select("id", (1 / (1 + F.col("id") % 17)).alias("score"))


@query
def graph_rank_blend(spark: SparkSession, sf: str) -> DataFrame:
    ranks = graph.pagerank(vertices(spark, sf), C.user_edges(spark, sf), rounds=10)
    return graph.blended(ranks, scores_of_users(spark, sf)).withColumn("score", F.round("score", 7))


@query
def tiered_rank(spark: SparkSession, sf: str) -> DataFrame:
    start = graph.focus_start(vertices(spark, sf), [3, 5], [7])
    ranks = graph.pagerank(vertices(spark, sf), C.user_edges(spark, sf), start, rounds=10)
    priors = scores_of_users(spark, sf).select("id", F.col("score").alias("prior"))
    tiers = graph.tiered(ranks, start.select("id"), priors, 0.004)
    return tiers.select("id", F.round("rank", 7).alias("rank"), "tier")


@query
def graph_density(spark: SparkSession, sf: str) -> DataFrame:
    return graph.density(vertices(spark, sf), C.user_edges(spark, sf)).withColumn("density", F.round("density", 6))


@query
def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(C.user_edges(spark, sf), 3, vertices(spark, sf).select("id", (F.col("id") * 7 % 31).alias("weight")))


@query
def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.subgraph(C.user_edges(spark, sf), vertices(spark, sf).where("id % 5 = 0"))


def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Few enough edges to have few cycles: a nation and its fifth and seventh neighbour by key."""
    n = C.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("src"))
    other = n.select(F.col("k").alias("to"), F.col("src").alias("dst"))
    steps = n.select("src", F.explode(F.array((F.col("k") * 2 + 1) % 25, (F.col("k") + 5) % 25)).alias("to"))
    return steps.join(other, "to").where("src <> dst").select("src", "dst")


@query
def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.back_edge_cycles(nation_edges(spark, sf)).select(F.array_join("cycle", ">").alias("cycle"))


@query
def cycles_within_three(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cycles_within(nation_edges(spark, sf), 3).select(F.array_join("cycle", ">").alias("cycle"))


# Rules


def rule_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    f = C.files(spark, sf)
    nations = C.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("module"))
    m = nations.select(
        "module",
        F.element_at(F.array(*map(F.lit, stats.TIERS)), F.col("n_nationkey") % 3 + 1).alias("tier"),
        F.when(F.col("n_nationkey") % 4 == 0, "interface").otherwise("core").alias("role"),
        (F.col("n_nationkey") % 5 / 10).alias("core_score"),
        (F.col("n_nationkey") * F.col("n_nationkey")).alias("file_count"),
    )
    names = nations.select((F.col("n_nationkey") + 0).alias("k"), "module")
    files = f.select("path", (F.col("ord") % 26).cast("int").alias("k")).join(names, "k", "left").select("path", F.coalesce("module", F.lit("")).alias("module"))
    return {"files": files, "modules": m, "module_deps": nation_edges(spark, sf), "file_deps": deps.file_dependencies(contents(spark, sf)).select("src", "dst")}


@query
def rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    return rules.run(rule_tables(spark, sf), [r for r in rules.RULES if r != "circular-dependency"]).select("rule_id", "severity", "subject")


@query
def rule_circular(spark: SparkSession, sf: str) -> DataFrame:
    return rules.run(rule_tables(spark, sf), ["circular-dependency"]).select("rule_id", "severity", "subject")


@query
def architecture_score(spark: SparkSession, sf: str) -> DataFrame:
    return rules.score(rules.run(rule_tables(spark, sf), ["layer-violation", "size-imbalance"]))


# Conversations


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def word_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in ("src/thing.py", "src/er.py", "lib/er.py", "lib/reth.py", "docs/anly.md", "edti", "src/in_at.py", "onre.go")], "path string")


@query
def mentioned_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    symbols = spark.createDataFrame([("Er",), ("ondst",), ("that",)], "name string")
    return mentions.identifiers(messages(spark, sf), symbols).groupBy("ident").agg(F.count("*").alias("n"))


@query
def mentioned_stems(spark: SparkSession, sf: str) -> DataFrame:
    return mentions.stems(messages(spark, sf), word_files(spark))


@query
def mentioned_files(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.createDataFrame([(p,) for p in ("er", "src/er-or", "a_b", "thing")], "path string")
    return mentions.file_mentions(messages(spark, sf), files)


def memories(spark: SparkSession, sf: str) -> DataFrame:
    said = mentions.stems(messages(spark, sf), word_files(spark)).join(messages(spark, sf).select("id", "conv_id", "turn"), "id")
    return mentions.memory(said, messages(spark, sf).select("conv_id", "turn"))


@query
def working_memory(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf)


@query
def active_files(spark: SparkSession, sf: str) -> DataFrame:
    return mentions.active(memories(spark, sf), 0.5)


@query
def context_text(spark: SparkSession, sf: str) -> DataFrame:
    return mentions.context_text(messages(spark, sf), 3).select("conv_id", F.sha2("text", 256).alias("text"))


# Recomputation


def hashes(spark: SparkSession, sf: str, salt: int) -> DataFrame:
    d = C.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "lang", "source")
    return incremental.hashed(d.withColumn("salt", F.when(F.col("path") % salt == 0, "x").otherwise("")), ["lang", "source", "salt"])


@query
def phase_delta(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.delta(hashes(spark, sf, 50).where("path % 13 <> 0"), hashes(spark, sf, 70).where("path % 11 <> 0"))


@query
def recompute_plan(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.plan(incremental.delta(hashes(spark, sf, 500), hashes(spark, sf, 10_000_000)))


@query
def cache_reuse(spark: SparkSession, sf: str) -> DataFrame:
    cache = hashes(spark, sf, 70).where("path % 11 <> 0").select("path", "hash", F.lit("cached").alias("result"))
    return incremental.reuse(hashes(spark, sf, 50), cache, lambda rows: rows.withColumn("result", F.lit("new"))).select("path", "result")


@query
def input_hashes(spark: SparkSession, sf: str) -> DataFrame:
    d = C.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return incremental.input_hash(d, ["doc_id", "lang"], ["source"]).fillna("", ["source"])


# Snapshots and drawings


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    by = C.counted_files(spark, sf).where("module <> ''").groupBy(F.date_format("day", "yyyy").alias("snapshot_id"), "module").agg(F.count("*").alias("n"), F.sum("n_sigs").alias("sigs"))
    score = F.round(F.col("n") % 50 / 50, 4)
    kept = by.where("(n + sigs) % 7 <> 0")
    return kept.select("snapshot_id", "module", score.alias("core_score"), R.tier(score, F.lit(0.0)).alias("tier"), F.when(F.col("sigs") % 2 == 0, "core").otherwise("infra").alias("role"), F.col("n").alias("file_count"))


@query
def frame_diff(spark: SparkSession, sf: str) -> DataFrame:
    return viz.frames(yearly(spark, sf))


@query
def snapshot_refs(spark: SparkSession, sf: str) -> DataFrame:
    ids = C.files(spark, sf).select(F.date_format("day", "yyyy-MM").alias("id")).distinct()
    return snapshots.references(ids).select(F.col("id").alias("snapshot_id"), "ref")


def nation_modules(spark: SparkSession, sf: str) -> DataFrame:
    t = rule_tables(spark, sf)["modules"]
    role = F.element_at(F.array(*map(F.lit, R.ROLE_ORDER)), F.length("module") % 5 + 1)
    return t.select(F.col("module").alias("id"), "module", "tier", role.alias("role"), F.col("module").alias("ord"), "core_score", "file_count")


@query
def viz_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return viz.module_nodes(nation_modules(spark, sf))


@query
def viz_links(spark: SparkSession, sf: str) -> DataFrame:
    d = graph.module_dependencies(C.module_edges(spark, sf)).select("src", "dst", (F.col("weight") % 40).alias("weight"))
    return viz.module_links(d)


@query
def viz_file_nodes(spark: SparkSession, sf: str) -> DataFrame:
    f = C.counted_files(spark, sf)
    return viz.file_nodes(f, scoring.module_scores(f))


@query
def ring_positions(spark: SparkSession, sf: str) -> DataFrame:
    return viz.ring(nation_modules(spark, sf).select("id"))


@query
def role_positions(spark: SparkSession, sf: str) -> DataFrame:
    return viz.by_role(nation_modules(spark, sf))


@query
def tier_positions(spark: SparkSession, sf: str) -> DataFrame:
    return viz.by_tier(nation_modules(spark, sf))


@query
def extension_pie(spark: SparkSession, sf: str) -> DataFrame:
    return viz.extensions(C.files(spark, sf))


# Model outputs


@query
def vocabulary_check(spark: SparkSession, sf: str) -> DataFrame:
    tags = C.table(spark, sf, "part").select(F.lower(F.split("p_name", " ")[0]).alias("tag")).unionByName(C.table(spark, sf, "part").select(F.col("p_brand").alias("tag"))).distinct()
    return quality.vocabulary_check(tags, spark.createDataFrame([("red",), ("small",)], "tag string"))


@query
def output_faults(spark: SparkSession, sf: str) -> DataFrame:
    e = C.table(spark, sf, "events").select("event_id", "props")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), F.lit('{"desc": "d", "tags": ["ok"]}'), F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.lit('{"desc": "d", "tags": ["Not OK"]}')).when(F.col("event_id") % 4 == 2, F.lit('{"desc": "d"}')).otherwise(F.col("props"))
    return quality.file_outputs(e.select("event_id", text.alias("text"))).select("event_id", F.coalesce("fault", F.lit("")).alias("fault"))


# Prompts


def ranked_sources(spark: SparkSession, sf: str) -> DataFrame:
    f = with_roles(C.counted_files(spark, sf))
    best = rank.source_files(f, scoring.module_scores(f)).withColumn("score", F.round("score", 6))
    return best.join(f.select("path", "desc"), "path")


def best_first() -> list[Column]:
    return [F.desc("score"), F.desc("n_sigs"), F.desc("path")]


@query
def key_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.key_file_lines(ranked_sources(spark, sf), best_first(), 800, 56)


@query
def signature_lines(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.signature_lines(ranked_sources(spark, sf), best_first(), C.signatures(spark, sf), 400, 40, 3)


@query
def key_files(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.key_files(with_roles(C.files(spark, sf)).withColumn("score", F.col("ord") % 7 / 10))


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return C.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), path.alias("path"), F.col("text").alias("content"))


@query
def directory_trim(spark: SparkSession, sf: str) -> DataFrame:
    f = document_files(spark, sf).select("ord", "path", T.tokens(F.col("content")).alias("cost"), T.line_count(F.col("content")).alias("lines"))
    return prompts.by_directory(f, 20_000).select("path", "dir", "cost", "rank")


def tree_changes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.tree_changes(tree.nodes(old_files(spark, sf)), tree.nodes(new_files(spark, sf))).withColumn("ord", F.lit(0))


@query
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.change_counts(tree_changes(spark, sf))


@query
def change_lines(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.change_lines(tree_changes(spark, sf))


@query
def tag_report(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.tag_report(C.signatures(spark, sf), [F.asc("name"), F.asc("path"), F.asc("line")], 30)


@query
def reading_steps(spark: SparkSession, sf: str) -> DataFrame:
    r = C.table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("nth"), F.col("r_name").alias("project"))
    boundaries = r.select("nth", "project", F.concat(F.lower("project"), F.lit("/main.py")).alias("entry"), F.when(F.col("nth") != 2, F.concat(F.lower("project"), F.lit("/core"))).alias("area"))
    entries = r.select("nth", F.concat(F.lower("project"), F.lit("/cli.py")).alias("path"), F.lit("CLI entry point").alias("reason"))
    areas = r.select("nth", F.concat(F.lower("project"), F.lit("/core")).alias("area"), (F.col("nth") * 3).alias("n"))
    return prompts.steps(boundaries, entries, areas)


@query
def candidate_paths(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf)
    return prompts.candidate_paths(f.where("ord % 4 = 0").select("path"), f.where("ord % 6 = 0").select("path"), f.select("module").distinct())


@query
def merged_focus(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf).select(F.col("ord").alias("nth"), "path")
    return prompts.merged(f.where("nth % 2 = 0"), f.where("nth % 3 = 0"))


@query
def local_results(spark: SparkSession, sf: str) -> DataFrame:
    found = prompts.local_results(C.files(spark, sf).where("ord % 3 = 0"), C.signatures(spark, sf))
    return found.groupBy(P.name(F.col("path")).startswith("cli").alias("cli"), "desc", shown("tags")).agg(F.count("*").alias("n"), F.min("path").alias("first"))


def document_snippets(spark: SparkSession, sf: str) -> DataFrame:
    f = document_files(spark, sf)
    ranked = f.select("path", F.round(1 / (1 + F.col("ord") % 97), 6).alias("score"))
    tags = f.select("path", "ord", F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("line"))
    tags = tags.select("path", F.concat(F.when(F.col("line") == 1, "_").otherwise(""), F.lit("fn"), F.col("line").cast("string")).alias("name"), "line")
    return prompts.snippets(ranked, tags, f, ["FN9"], cap=60)


@query
def ranked_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return document_snippets(spark, sf).select("path", "nth", "name", "line", F.sha2("content", 256).alias("content"), "cost")


@query
def packed_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.pack_snippets(document_snippets(spark, sf)).select("path", "nth", "name", "cost", "place")


@query
def headers_left(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("ord") % 2 == 0, "## ").when(F.col("ord") % 3 == 0, "# see ").otherwise("- ")
    lines = C.files(spark, sf).select("ord", F.concat(mark, "path").alias("line"))
    kept = prompts.without_headers(lines, ["src/core/engine_8.py", "cli/cli_2.py", "engine_20.py"])
    return kept.groupBy(F.substring("line", 1, 4).alias("mark")).agg(F.count("*").alias("n"), F.sum("ord").alias("ords"))


@query
def context_lines(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.context_lines(nation_modules(spark, sf).withColumn("desc", F.repeat("module", 20)))


@query
def dependency_lines(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.dependency_lines(graph.module_dependencies(C.module_edges(spark, sf)))


@query
def detail_lines(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.detail_lines(C.files(spark, sf), C.signatures(spark, sf))


@query
def language_hints(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.repeat(F.lit("中"), (F.col("doc_id") % 400).cast("int")), F.coalesce("text", F.lit("")))
    return C.table(spark, sf, "documents").groupBy(prompts.language_hint(text).alias("hint")).agg(F.count("*").alias("n"))


def part_words(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "part").select(F.col("p_brand").alias("dimension"), F.col("p_type").alias("tag")).distinct()


@query
def vocabulary_lines(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.vocabulary_lines(part_words(spark, sf))


@query
def vocabulary_hash(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.vocabulary_hash(part_words(spark, sf))


@query
def repository_kind(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf)
    return archetype.counts(f).join(archetype.detect(f))


@query
def directory_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    tops = C.files(spark, sf).select(F.get(P.parts(F.col("path")), F.lit(0)).alias("directory")).where("directory not like '%.md'").distinct()
    extra = spark.createDataFrame([("DataLoader",), ("my_plots",), ("whatever",)], "directory string")
    return tops.unionByName(extra).select("directory", archetype.described(F.col("directory"), " Service").alias("desc"))


@query
def modules_in_order(spark: SparkSession, sf: str) -> DataFrame:
    m = rule_tables(spark, sf)["modules"].withColumn("desc", F.when(F.length("module") % 3 == 0, "Benchmarks of it").otherwise(""))
    return rank.module_order(m).select("nth", "module", "tier", "core_score")


@query
def expanded_target(spark: SparkSession, sf: str) -> DataFrame:
    f = C.files(spark, sf)
    both = overview.target_files(f, "mod:BUILDING").withColumn("target", F.lit("module")).unionByName(overview.target_files(f, "src/core").withColumn("target", F.lit("path")))
    return both.select("target", "path", "module")


@query
def module_report(spark: SparkSession, sf: str) -> DataFrame:
    m = nation_modules(spark, sf).select("module", "tier", "core_score", "file_count", F.concat(F.lit("about "), "module").alias("desc"), "ord")
    return overview.module_lines(m, 150)


@query
def probed_languages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 8
    heads = ["#!/usr/bin/env -S python3\nprint(1)", "#!/bin/bash\necho", "<?php echo 1;", "import os\ndef f():\n  pass\nclass A:\n  pass", "", "plain words only", "#!/usr/bin/ruby\nputs 1", "x"]
    paths = ["bin/tool", "bin/run", "web/page", "lib/module", "bin/empty", "NOTES", "bin/gem", "lib/a.rs"]
    head = F.element_at(F.array(*map(F.lit, heads)), (k + 1).cast("int")).cast("binary")
    path = F.element_at(F.array(*map(F.lit, paths)), (k + 1).cast("int"))
    return C.table(spark, sf, "documents").select(k.alias("k"), probe.probe(path, head).alias("p")).groupBy("k", F.coalesce("p.language", F.lit("")).alias("language"), "p.is_code").agg(F.count("*").alias("n"))
