"""Running sums, batches, tree differences and prompts against plain Python, on rows that lie in many partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gneiss.operators import budget, graph, incremental, ordered, prompts, tree


def test_running_sums_cross_ranges(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", None, "b"]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, cost long").repartition(7)
    got = {x["i"]: (x["used"], x["nth"]) for x in ordered.running(df, ["g"], [F.desc("i")], "cost").collect()}
    want, sums = {}, {}
    for g, i, cost in sorted(rows, key=lambda x: -x[1]):
        used, nth = sums.get(g, (0, 0))
        sums[g] = want[i] = (used + cost, nth + 1)
    assert got == want
    assert ordered.running(df.limit(0), ["g"], [F.desc("i")], "cost").collect() == []
    kept = budget.stop_at_overflow(df, [F.asc("i")], "cost", 40).collect()
    assert sorted(x["i"] for x in kept) == list(range(len(kept))) and sum(x["cost"] for x in kept) <= 40
    assert {x["i"] for x in budget.capped(df, [F.asc("i")], "cost", 10_000, 7).collect()} == set(range(7))


def test_batches_stream(spark):
    r = random.Random(2)
    rows = [(r.randrange(5) or None, i, r.choice([1, 10, 4000, 9000])) for i in range(400)]
    got = {x["i"]: x["batch"] for x in budget.batches(spark.createDataFrame(rows, "q long, i long, s long").repartition(5), "q", "i", "s").collect()}
    want, state = {}, {}
    for q, i, s in rows:
        batch, n, used = state.get(q, (0, 0, 0))
        if n and (n >= 32 or used + s > 8000):
            batch, n, used = batch + 1, 0, 0
        state[q] = (batch, n + 1, used + s)
        want[i] = batch
    assert got == want


def test_rows_that_cost_nothing_count_one(spark):
    df = spark.createDataFrame([(i, 0 if i % 2 else None, 0.5) for i in range(50)], "i long, cost long, score double")
    assert budget.skip_overflow(df, "i", [("score", True), ("i", False)], "cost", 12, chunk=5).count() == 12


def test_modified_directories_have_other_children(spark):
    old = tree.nodes(spark.createDataFrame([("a/x.py",), ("a/y.py",), ("b/z.py",), ("c/q/r.py",)], "path string"))
    new = tree.nodes(spark.createDataFrame([("a/x.py",), ("b/z.py",), ("b/n.py",), ("c/q/r.py",)], "path string"))
    got = {(x["id"], x["change"]) for x in tree.tree_changes(old, new).collect()}
    assert got == {("file:a/y.py", "removed"), ("dir:a", "modified"), ("file:b/n.py", "added"), ("dir:b", "modified")}


def test_input_hash_has_no_order(spark):
    rows = [(i % 3, f"line {i}") for i in range(200)]
    a, b = (spark.createDataFrame(x, "g long, line string").repartition(n) for x, n in ((rows, 2), (rows[::-1], 7)))
    one, two = ({r["g"]: r["hash"] for r in incremental.input_hash(x, ["line"], ["g"]).collect()} for x in (a, b))
    assert one == two and len(set(one.values())) == 3
    assert incremental.input_hash(a.where("line <> 'line 7'"), ["line"], ["g"]).where("g = 1").first()["hash"] != one[1]


def test_walks_refuse_large_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")], "src string, dst string")
    assert {tuple(r["cycle"]) for r in graph.back_edge_cycles(edges).collect()} == {("a", "b"), ("a", "b", "c")}
    with pytest.raises(ValueError, match="cycles_within"):
        graph.back_edge_cycles(edges, most=3)


def test_profiles():
    assert [prompts.profile(n)["name"] for n in (80, 2500, 2501, 6000, 9000, 9001)] == ["small", "small", "medium", "medium", "large", "xlarge"]
    assert not prompts.profile(2500)["include_llm_brief"] and prompts.profile(2600)["include_llm_brief"]
    m, d = prompts.profile(10_000, " MAP "), prompts.profile(2000, "deep")
    assert (m["name"], m["key_files"], m["tree_depth"], m["prefer_l2_ratio"], m["include_llm_brief"]) == ("xlarge-map", 22, 4, 0.62, True)
    assert prompts.profile(2000, "map")["key_files"] == 14 and not prompts.profile(2000, "map")["include_llm_brief"]
    assert (d["name"], d["key_files"], d["tree_reserve_ratio"], d["include_llm_brief"]) == ("small-deep", 40, 0.30, True)
    assert prompts.profile(2000, "?")["name"] == prompts.profile(2000, None)["name"] == "small"
    assert (prompts.tree_budget(1000, True, 0.65), prompts.tree_budget(100, True, 0.9), prompts.tree_budget(1000, False, 0.65)) == (350, 120, 1000)


def test_steps_without_projects_begin_at_entries(spark):
    none = spark.createDataFrame([], "nth int, project string, entry string, area string")
    entries = spark.createDataFrame([(1, "cli.py", "CLI entry point"), (2, "app.py", "bootstrap"), (3, "x.py", "late")], "nth int, path string, reason string")
    areas = spark.createDataFrame([(1, "src", 9), (2, "cli.py", 3)], "nth int, area string, n int")
    got = [r["target"] for r in prompts.steps(none, entries, areas).orderBy("nth").collect()]
    assert got == ["cli.py", "app.py", "src"]


def test_snippets_end_a_file_at_the_first_that_does_not_fit(spark):
    kind = "path string, score double, nth int, cost long"
    rows = [("a", 3.0, 1, 60), ("a", 3.0, 2, 50), ("b", 2.0, 1, 200), ("b", 2.0, 2, 1), ("c", 1.0, 2, 30), ("d", 0.5, 1, 0), ("d", 0.5, 2, 20)]
    got = prompts.pack_snippets(spark.createDataFrame(rows, kind), 100, chunk=2).orderBy("place").collect()
    assert [(r["path"], r["nth"]) for r in got] == [("a", 1), ("c", 2), ("d", 1)]
