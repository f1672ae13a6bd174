"""Dependency graphs: edges from imports and references, PageRank, tiers, cycles, neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.plans.lineage import cut, forget

DAMPING = 0.85


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("fan_in"))


def module_dependencies(edges: DataFrame, top: int = 10, samples: int = 5) -> DataFrame:
    """edges(src, dst, src_file, dst_file) -> src, dst, weight, files: the ``top`` targets of each source.

    Weight counts distinct pairs of files. Pairs are made distinct first, so counting is by partial sums;
    samples are the smallest pairs: each task passes on the first of an edge alone (a window's group limit).
    """
    pairs = edges.where("src <> dst").select("src", "dst", "src_file", "dst_file").distinct()
    few = Window.partitionBy("src", "dst").orderBy("src_file", "dst_file")
    weights = pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    shown = pairs.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= samples)
    shown = shown.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "src_file", "dst_file"))), lambda s: F.concat_ws(">", s["src_file"], s["dst_file"])).alias("files"))
    rank = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    ranked = weights.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    return ranked.join(shown, ["src", "dst"]).select("src", "dst", "weight", "rank", "files")


def counted_calls(calls: DataFrame, by: list[str], samples: int = 5) -> DataFrame:
    """calls(*by, line) -> by, weight, lines: the first lines of the calls.

    Calls are counted by partial sums; each task passes on the first lines of a pair alone (a window's group limit).
    """
    weights = calls.groupBy(*by).agg(F.count("*").alias("weight"))
    few = calls.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("line"))).where(F.col("nth") <= samples)
    lines = few.groupBy(*by).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return weights.join(lines, by, "left").withColumn("lines", F.coalesce("lines", F.array().cast(f"array<{calls.schema['line'].dataType.simpleString()}>")))


def call_dependencies(edges: DataFrame, samples: int = 5) -> DataFrame:
    """edges(caller, callee, line) -> caller, callee, weight, lines: the first lines of the calls."""
    return counted_calls(edges.where("caller <> callee"), ["caller", "callee"], samples)


def call_pairs(calls: DataFrame, callees: DataFrame) -> DataFrame:
    """calls(caller, name, ...) counted by name, distinct callees(name, callee) -> caller, callee, ...: a row for each function of the name but the caller itself. Nothing is grouped or shuffled after they meet, if callees are few."""
    return calls.join(callees, "name").where("caller <> callee").drop("name")


def callers(edges: DataFrame, most: int = 10) -> DataFrame:
    """edges(caller, callee, weight) -> callee, n_callers, calls, callers: who calls a function, most calls first, ``most`` by name (a window's group limit)."""
    pairs = edges.groupBy("callee", "caller").agg(F.sum("weight").alias("weight"))
    counts = pairs.groupBy("callee").agg(F.count("*").alias("n_callers"), F.sum("weight").alias("calls"))
    first = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("callee").orderBy(F.desc("weight"), "caller"))).where(F.col("nth") <= most)
    named = first.groupBy("callee").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "caller"))), lambda x: x["caller"]).alias("callers"))
    return counts.join(named, "callee").select("callee", "n_callers", "calls", "callers")


def callers_by_name(calls: DataFrame, callees: DataFrame, most: int = 10) -> DataFrame:
    """``callers`` of distinct callees(name, callee) from calls(caller, name, weight): a name's callers are ranked once for all its functions, then each is without itself."""
    pairs = calls.groupBy("name", "caller").agg(F.sum("weight").alias("weight"))
    counts = pairs.groupBy("name").agg(F.count("*").alias("n"), F.sum("weight").alias("all"))
    first = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("weight"), "caller"))).where(F.col("nth") <= most + 1)
    named = first.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "caller"))), lambda x: x["caller"]).alias("first"))
    own = pairs.join(callees, "name").where("caller = callee").select("name", "callee", F.col("weight").alias("own"))
    met = callees.join(counts, "name").join(named, "name").join(own, ["name", "callee"], "left")
    n_callers = F.col("n") - F.when(F.col("own").isNull(), 0).otherwise(1)
    told = met.select("callee", n_callers.alias("n_callers"), (F.col("all") - F.coalesce("own", F.lit(0))).alias("calls"), F.slice(F.filter("first", lambda c: c != F.col("callee")), 1, most).alias("callers"))
    return told.where("n_callers > 0")


def name_weight(name: Column, mentioned: list[str], chat: Column) -> Column:
    """The part of a reference edge's weight that its identifier and its file decide."""
    private = F.substring(name, 1, 1) == "_"
    w = F.when(name.isin(mentioned), 10.0).otherwise(1.0) if mentioned else F.lit(1.0)
    return w * F.when((F.length(name) >= 8) & ~private, 10.0).otherwise(1.0) * F.when(private, 0.1).otherwise(1.0) * F.when(chat, 50.0).otherwise(1.0)


def edge_weight(name: Column, references: Column, definitions: Column, mentioned: list[str], chat: Column) -> Column:
    """Weight of a reference edge by what its identifier is like."""
    return name_weight(name, mentioned, chat) * F.when(definitions > 5, 0.1).otherwise(1.0) * F.sqrt(references)


def definition_edges(definitions: DataFrame, references: DataFrame, mentioned: list[str] | None = None, chat_files: list[str] | None = None) -> DataFrame:
    """definitions(name, path), references(name, path) -> src, dst, name, weight: a file uses a name that another defines; a row for each definition of it.

    References are counted by name and file before they meet definitions, so a hot name is one row a file.
    """
    counted = references.groupBy("name", F.col("path").alias("src")).agg(F.count("*").alias("n"))
    spread = definitions.groupBy("name").agg(F.count("*").alias("defs"))
    met = counted.join(spread, "name").join(definitions.select("name", F.col("path").alias("dst")), "name").where("src <> dst")
    chat = F.col("src").isin(chat_files) if chat_files else F.lit(False)
    weight = edge_weight(F.col("name"), F.col("n"), F.col("defs"), mentioned or [], chat)
    return met.select("src", "dst", "name", weight.alias("weight"))


def reference_edges(definitions: DataFrame, references: DataFrame, mentioned: list[str] | None = None, chat_files: list[str] | None = None, rows_a_task: int = 2_000_000) -> DataFrame:
    """definitions(name, path), references(name, path) -> src, dst, weight of files that use names others define.

    Nearly each edge of a name is a pair of its own, so a task holds all it is dealt: there are as many tasks as the edges need, counted by name before they are made.
    """
    edges = definition_edges(definitions, references, mentioned, chat_files)
    uses, made = (x.groupBy("name").agg(F.count("*").alias(n)) for x, n in ((references, "uses"), (definitions, "made")))
    most = uses.join(made, "name").agg(F.sum(F.col("uses") * F.col("made"))).first()[0] or 0
    parts = -(-most // rows_a_task)
    if parts > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        edges = edges.repartition(int(parts), "src", "dst")
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def ranked_definitions(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """edges(src, dst, name, weight), ranks(id, rank) -> path, name, rank: a file's rank goes to the definitions it refers to, by weight.

    Edges are weighed against their file's total, and summed by (file, name) with partial sums: a hot name costs a row a task.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    given = ranks.select(F.col("id").alias("src"), "rank").join(total, "src").select("src", (F.col("rank") / F.col("total")).alias("each"))
    got = edges.join(given, "src").select("dst", "name", (F.col("weight") * F.col("each")).alias("part"))
    return got.groupBy(F.col("dst").alias("path"), "name").agg(F.sum("part").alias("rank"))


def keys_of(values: DataFrame) -> Callable[[Column], Column]:
    """What to know the distinct values of a column of strings by: a hash of 64 bits, or themselves, if two of these have the same hash (told by a second one)."""
    v = F.col(values.columns[0])
    sides = values.groupBy(F.xxhash64(v).alias("key")).agg(F.min(F.xxhash64(F.lit("check"), v)).alias("least"), F.max(F.xxhash64(F.lit("check"), v)).alias("most"))
    return (lambda c: F.when(c.isNotNull(), F.xxhash64(c))) if sides.where("least <> most").isEmpty() else (lambda c: c)


def name_links(definitions: DataFrame, references: DataFrame, mentioned: list[str] | None = None, chat_files: list[str] | None = None, key: tuple[Callable[[Column], Column], Callable[[Column], Column]] = (lambda c: c, lambda c: c)) -> tuple[DataFrame, DataFrame]:
    """definitions(name, path), references(name, path) -> uses(src, name, share, own), made(name, path, times): ``definition_edges`` before uses meet definitions.

    A name with u uses and d definitions is u + d rows here and u * d edges there. ``share`` is what part of its file's weight an edge to one definition has, ``own`` how many
    of the definitions lie in the file itself, to which there is no edge. ``key`` says what files and names are known by. Both are kept dealt, uses by file and definitions by name.
    """
    of_file, of_name = key
    chat = F.col("path").isin(chat_files) if chat_files else F.lit(False)
    made = definitions.groupBy(of_name(F.col("name")).alias("name"), of_file(F.col("path")).alias("path")).agg(F.count("*").alias("times")).where("name is not null")
    counted = references.select(of_name(F.col("name")).alias("name"), of_file(F.col("path")).alias("src"), name_weight(F.col("name"), mentioned or [], chat).alias("weight"))
    counted = counted.where("name is not null and src is not null").groupBy("name", "src", "weight").agg(F.count("*").alias("n"))
    made = cut(made.repartition("name"), dealt=True)
    met = counted.join(made.groupBy("name").agg(F.sum("times").alias("defs"), F.sum(F.when(F.col("path").isNotNull(), F.col("times"))).alias("placed")), "name").join(made.withColumnRenamed("path", "src"), ["name", "src"], "left").fillna(0, ["times"])
    met = met.where("placed > times").select("src", "name", (F.col("weight") * F.when(F.col("defs") > 5, 0.1).otherwise(1.0) * F.sqrt("n")).alias("weight"), F.col("times").alias("own"), (F.col("placed") - F.col("times")).alias("others"))
    met = cut(met.repartition("src"), dealt=True)
    total = met.groupBy("src").agg(F.sum(F.col("weight") * F.col("others")).alias("total"))
    uses = cut(met.join(total, "src").select("src", "name", (F.col("weight") / F.col("total")).alias("share"), "own"), dealt=True)
    forget(met)
    return uses, made


def name_pagerank(vertices: DataFrame, uses: DataFrame, made: DataFrame, start: DataFrame | None = None, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """``pagerank`` of files over the links of ``name_links``: vertices(id), start(id, p) -> id, rank. What a name's users give it goes to each of its definitions, less what a file would give itself.

    A round shuffles a row a use and a row a definition, not one an edge; uses, definitions and ranks stay where they are dealt.
    """
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    base = vertices.select("id").distinct()
    p = F.lit(1.0 / n)
    total = start.agg(F.sum("p")).first()[0] or 0.0 if start is not None else 0.0
    if total > 0:
        base = base.join(start.groupBy("id").agg((F.sum("p") / total).alias("p")), "id", "left").fillna(0.0, ["p"])
        p = F.col("p")
    own = uses.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("own") * F.col("share")).alias("own"))  # null: no links
    kept = ["id", "own", *(["p"] if total > 0 else [])]
    state = cut(base.join(own, "id", "left").select(*kept, p.alias("rank")), dealt=True)
    for _ in range(rounds):
        given = uses.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy("name").agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        got = made.join(given, "name").groupBy(F.col("path").alias("id")).agg(F.sum(F.col("times") * F.col("given")).alias("got"))
        loose = F.lit(state.where("own is null").agg(F.sum("rank")).first()[0] or 0.0)
        others = F.greatest(F.coalesce("got", F.lit(0.0)) - F.coalesce("own", F.lit(0.0)) * F.col("rank"), F.lit(0.0))
        rank = DAMPING * (others + loose * p) + (1 - DAMPING) * p
        before = state
        state = cut(before.join(got, "id", "left").select(*kept, rank.alias("rank"), *([F.col("rank").alias("was")] if tolerance is not None else [])), dealt=True)
        forget(before)
        if tolerance is not None and (state.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < n * tolerance:
            break
    return state.select("id", "rank")


def name_definitions(uses: DataFrame, made: DataFrame, ranks: DataFrame) -> DataFrame:
    """``ranked_definitions`` over the links of ``name_links``: ranks(id, rank) -> path, name, rank of definitions that other files refer to."""
    parts = uses.join(ranks.select(F.col("id").alias("src"), "rank"), "src").select("src", "name", (F.col("rank") * F.col("share")).alias("part"), "own")
    given = parts.groupBy("name").agg(F.sum("part").alias("given"), F.count("*").alias("users"))
    mine = parts.where("own > 0").select(F.col("src").alias("path"), "name", F.col("part").alias("mine"))
    met = made.join(given, "name").join(mine, ["name", "path"], "left")
    return met.where(F.col("users") > F.when(F.col("mine").isNull(), 0).otherwise(1)).select("path", "name", (F.col("times") * (F.col("given") - F.coalesce("mine", F.lit(0.0)))).alias("rank"))


def density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """edges per vertex and whether that is too few to rank by."""
    n = vertices.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))
    return n.select("nodes", "edges", (F.col("edges") / F.greatest("nodes", F.lit(1))).alias("density")).withColumn("too_sparse", F.col("density") < 0.05)


def pagerank(vertices: DataFrame, edges: DataFrame, start: DataFrame | None = None, rounds: int = 20, tolerance: float | None = None) -> DataFrame:
    """vertices(id), edges(src, dst, weight), start(id, p) -> id, rank.

    Personalised, weighted; dangling mass goes where the start distribution says. Each round is one join and one aggregation on
    ``src``, and its lineage is cut: the next one reads the ranks three times. The ranks before are deleted then, so two rounds' are on disk at once. With a
    ``tolerance`` (a round's total change per vertex) the walk ends when it is reached, for one number a round sent to the driver.
    """
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    base = vertices.select("id").distinct()
    if start is not None:
        total = start.agg(F.sum("p")).first()[0] or 0.0
        p = F.coalesce("p", F.lit(0.0)) / total if total > 0 else F.lit(1.0 / n)
        base = base.join(start.groupBy("id").agg(F.sum("p").alias("p")), "id", "left").select("id", p.alias("p"))
    else:
        base = base.select("id", F.lit(1.0 / n).alias("p"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    state = cut(base.join(out.select(F.col("src").alias("id"), F.lit(True).alias("links")), "id", "left").select("id", "p", F.col("p").alias("rank"), F.coalesce("links", F.lit(False)).alias("links")))
    for _ in range(rounds):
        got = links.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = state.agg(F.coalesce(F.sum(F.when(~F.col("links"), F.col("rank"))), F.lit(0.0)).alias("loose"))
        rank = DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("p")) + (1 - DAMPING) * F.col("p")
        before = state
        state = cut(before.select("id", "p", F.col("rank").alias("was"), "links").join(got, "id", "left").join(F.broadcast(loose)).select("id", "p", rank.alias("rank"), "links", "was"))
        forget(before)
        if tolerance is not None and (state.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < n * tolerance:
            break
    forget(links)
    return state.select("id", "rank")


def focus_start(vertices: DataFrame, focus: list[str], mentioned: list[str]) -> DataFrame | None:
    """Where a personalised ranking starts: focus files five times as likely as mentioned ones; none of either, nowhere in particular."""
    if not focus and not mentioned:
        return None
    weight = F.when(F.col("id").isin(focus), 500.0).otherwise(0.0) if focus else F.lit(0.0)
    weight = weight + (F.when(F.col("id").isin(mentioned), 100.0).otherwise(0.0) if mentioned else F.lit(0.0))
    return vertices.select("id", weight.alias("p")).where("p > 0")


def blended(ranks: DataFrame, scores: DataFrame, of_rank: float = 0.4) -> DataFrame:
    """ranks(id, rank), scores(id, score) -> id, score: both scaled by their largest, and weighed."""
    top_rank, top_score = ranks.agg(F.max("rank").alias("top_rank")), scores.agg(F.max("score").alias("top_score"))
    met = scores.join(ranks, "id", "left").join(F.broadcast(top_rank)).join(F.broadcast(top_score))
    part = F.coalesce(F.col("rank") / F.nullif(F.col("top_rank"), F.lit(0.0)), F.lit(0.0))
    whole = F.coalesce(F.col("score") / F.nullif(F.col("top_score"), F.lit(0.0)), F.lit(0.0))
    return met.select("id", (of_rank * part + (1 - of_rank) * whole).alias("score"))


def tiered(ranks: DataFrame, focus: DataFrame, priors: DataFrame | None = None, least: float = 0.001) -> DataFrame:
    """ranks(id, rank), focus(id), priors(id, prior) -> id, rank, tier: focus files, then what is near them, then what matters anyway."""
    first = focus.select("id").distinct().select("id", F.lit(1.0).alias("rank"), F.lit(1).alias("tier"))
    rest = ranks.join(focus.select("id"), "id", "left_anti")
    second = rest.where(F.col("rank") > least).select("id", "rank", F.lit(2).alias("tier"))
    out = first.unionByName(second)
    if priors is not None:
        third = rest.where(F.col("rank") <= least).select("id").join(priors, "id", "left").select("id", F.coalesce("prior", F.lit(0.0)).alias("rank"), F.lit(3).alias("tier"))
        out = out.unionByName(third)
    return out


def neighbourhood(edges: DataFrame, center: str, weights: DataFrame, most: int = 20) -> DataFrame:
    """The files one edge from ``center``, and which way; the ``most`` - 1 of largest weight(id, weight)."""
    out = edges.where(F.col("src") == center).select(F.col("dst").alias("id"), F.lit(1).alias("way"))
    into = edges.where(F.col("dst") == center).select(F.col("src").alias("id"), F.lit(2).alias("way"))
    ways = out.unionByName(into).where(F.col("id") != center).groupBy("id").agg(F.bit_or("way").alias("way"))
    named = F.element_at(F.array(F.lit("out"), F.lit("in"), F.lit("both")), F.col("way"))
    return ways.join(weights, "id", "left").fillna(0, ["weight"]).orderBy(F.desc("weight"), "id").limit(most - 1).select("id", named.alias("direction"), "weight")


def function_neighbourhood(edges: DataFrame, focus: str, hops: int = 1, most: int = 200) -> DataFrame:
    """edges(caller, callee, weight) of functions, ``path:name`` -> id, hop, weight: functions of the file ``focus`` that call or are called, and those within ``hops`` calls of them.

    Breadth first, ``most`` functions at the most: of a hop that doesn't fit, those with most calls from and to the hop before stay,
    the first by name of equals. What is reached is a frame of ``most`` rows, so each hop is a join with a small side.
    """
    ends = edges.select(F.col("caller").alias("id"), "weight").unionByName(edges.select(F.col("callee").alias("id"), "weight"))
    own = ends.where(F.substring_index("id", ":", 1) == focus).groupBy("id").agg(F.sum("weight").alias("weight"))
    seen = cut(own.orderBy(F.desc("weight"), "id").limit(most).select("id", F.lit(0).alias("hop"), "weight"))
    for hop in range(1, hops + 1):
        room = most - seen.count()
        if room <= 0:
            break
        last = F.broadcast(seen.where(F.col("hop") == hop - 1).select("id"))  # ``most`` rows
        # Semi joins, so they reach what the edges are made of.
        out = edges.join(last.withColumnRenamed("id", "caller"), "caller", "left_semi").select(F.col("callee").alias("to"), "weight")
        into = edges.join(last.withColumnRenamed("id", "callee"), "callee", "left_semi").select(F.col("caller").alias("to"), "weight")
        near = out.unionByName(into).groupBy(F.col("to").alias("id")).agg(F.sum("weight").alias("weight"))
        new = near.join(F.broadcast(seen.select("id")), "id", "left_anti").orderBy(F.desc("weight"), "id").limit(room)
        seen = cut(seen.unionByName(new.select("id", F.lit(hop).alias("hop"), "weight")))
    return seen


def subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members(id)``."""
    return edges.join(members.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("dst")), "dst", "left_semi")


def back_edge_cycles(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """cycle array<string> of a depth-first walk's back edges, each from its smallest member, distinct.

    For graphs of modules, in one group: more than ``most`` edges are an error. Which cycles are found depends on the walk's order
    (vertices and edges ascending); ``cycles_within`` finds all of bounded length on graphs of any size.
    """
    pairs = edges.select("src", "dst").distinct()
    if pairs.limit(most + 1).count() > most:
        raise ValueError(f"a depth-first walk takes {most} edges at the most; cycles_within takes any graph")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        for s, d in sorted(zip(rows["src"], rows["dst"], strict=True)):
            if s != d:
                out.setdefault(s, []).append(d)
        seen: set[str] = set()
        found: set[tuple[str, ...]] = set()
        for root in sorted({*rows["src"], *rows["dst"]}):
            path: list[str] = []
            on_path: dict[str, int] = {}
            stack = [(root, iter(out.get(root, ())))] if root not in seen else []
            if stack:
                seen.add(root)
                on_path[root] = 0
                path.append(root)
            while stack:
                step = next(stack[-1][1], None)
                if step is None:
                    stack.pop()
                    del on_path[path.pop()]
                elif step in on_path:
                    ring = path[on_path[step] :]
                    low = ring.index(min(ring))
                    found.add((*ring[low:], *ring[:low]))
                elif step not in seen:
                    seen.add(step)
                    on_path[step] = len(path)
                    path.append(step)
                    stack.append((step, iter(out.get(step, ()))))
        return pd.DataFrame({"cycle": pd.Series([list(c) for c in sorted(found)], dtype=object)})

    return pairs.withColumn("graph", F.lit("all")).groupBy("graph").applyInPandas(walk, "cycle array<string>")


def cycles_within(edges: DataFrame, longest: int = 3) -> DataFrame:
    """All simple cycles of up to ``longest`` edges, each from its smallest member: one self-join a step, from smaller starts only."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    paths = e.where("src < dst").select(F.array("src", "dst").alias("path"))
    out = None
    for _ in range(longest - 1):
        ends = paths.withColumn("src", F.element_at("path", -1)).join(e, "src")
        closed = ends.where(F.col("dst") == F.get("path", F.lit(0))).select(F.col("path").alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
        paths = ends.where((F.col("dst") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return out
