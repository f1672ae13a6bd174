"""The engine's operators on small hand-made indexes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gneiss import api
from gneiss.functions import paths as P
from gneiss.functions import text as T
from gneiss.operators import archetype, budget, deps, diff, graph, incremental, mentions, overview, quality, rank, rules, scoring, search, stats, tree
from gneiss.sources import code, index_json, probe, settings, snapshots
from gneiss.streaming import memory

FILES = [
    (0, "src/main.py", "mod-core", ["entrypoint", "python"], 2),
    (1, "src/engine.py", "mod-core", ["core", "python"], 3),
    (2, "src/utils.py", "mod-core", ["util", "python"], 1),
    (3, "src/api/routes.py", "mod-api", ["api", "python"], 2),
    (4, "src/api/middleware.py", "mod-api", ["api", "python"], 0),
    (5, "tests/test_engine.py", "mod-test", ["test", "python"], 1),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(*f, f"about {f[1]}") for f in FILES], "ord int, path string, module string, tags array<string>, n_sigs int, desc string")


def test_scores_by_hand(files):
    got = {r["module"]: (r["core_score"], r["tier"], r["role"]) for r in scoring.module_scores(files).collect()}
    assert got == {"mod-core": (0.71, "core", "core"), "mod-api": (0.4933, "core", "core"), "mod-test": (0.1567, "secondary", "test")}


def test_search_scores(spark, files):
    names = spark.createDataFrame([("src/engine.py", "Route"), ("src/utils.py", "x")], "path string, name string")
    got = [(r["path"], round(r["score"], 3)) for r in search.search(files, ["api", "python"], "ROUTE", names).collect()]
    assert got[0] == ("src/api/routes.py", 1.0) and got[1] == ("src/api/middleware.py", 0.6) and got[2] == ("src/engine.py", 0.5)
    assert search.search(files, pattern="   ").count() == 0 and search.search(files, pattern="zzz").count() == 0
    assert "No matching" in overview.search_report(files, None, "zzz")


def test_statistics(spark, files):
    modules = scoring.module_scores(files).withColumn("ord", F.lit(0))
    assert stats.module_distribution(modules, files).first()["file_count"] == 3
    assert tuple(stats.tag_frequency(files).first())[:2] == ("python", 6)
    assert [r["n"] for r in stats.tier_histogram(modules).orderBy("tier").collect()] == [2, 0, 1]
    assert tuple(stats.totals(files).first()) == (6, 3, 9)
    s = spark.createDataFrame([("a", 10), ("b", 15), ("c", 20)], "snapshot_id string, v int")
    assert tuple(stats.sparkline(s, "v").first()) == (3, "▁▄█", 10, 20)
    assert stats.sparkline(s.limit(1), "v").first()["line"] == ""


def test_diff_by_hand(spark):
    kind = "path string, module string, tags array<string>, n_sigs int"
    old = spark.createDataFrame([("src/main.py", "mod-core", ["python", "entrypoint"], 1), ("src/engine.py", "mod-core", ["python", "core"], 2), ("src/api.py", "mod-api", ["python"], 1)], kind)
    new = spark.createDataFrame([("src/main.py", "core-engine", ["python", "entrypoint", "cli"], 1), ("src/engine.py", "core-engine", ["python", "core"], 3), ("src/web.py", "mod-web", ["python"], 1)], kind)
    om, nm = (spark.createDataFrame(m, "ord int, module string") for m in ([(0, "mod-core"), (1, "mod-api")], [(0, "core-engine"), (1, "mod-web")]))
    matched = diff.module_matches(om, nm, old, new)
    assert [tuple(r) for r in matched.collect()] == [("mod-core", "core-engine", 1.0)]
    changes = diff.file_changes(old, new, matched)
    assert sorted((r["path"], r["change"]) for r in changes.collect()) == [("src/api.py", "removed"), ("src/web.py", "added")]
    tags = diff.tag_changes(old, new)
    assert [(r["path"], r["added"], r["removed"]) for r in tags.collect()] == [("src/main.py", ["cli"], [])]
    assert diff.magnitude(changes, tags, diff.module_changes(om, nm, matched)).first()[0] == 5
    assert diff.file_changes(old, old).count() == 0


def test_trees(spark):
    paths = spark.createDataFrame([(p,) for p in ("src/main.py", "src/utils.py", "tests/test_main.py", "README.md")], "path string")
    n = tree.nodes(paths)
    assert {r["id"] for r in n.collect()} == {"dir:.", "dir:src", "file:src/main.py", "file:src/utils.py", "dir:tests", "file:tests/test_main.py", "file:README.md"}
    after = tree.nodes(paths.where("path <> 'src/utils.py'").union(spark.createDataFrame([("new.py",)], "path string")))
    assert {(r["id"], r["change"]) for r in tree.tree_changes(n, after).collect()} == {("file:src/utils.py", "removed"), ("file:new.py", "added"), ("dir:src", "modified"), ("dir:.", "modified")}
    listing = spark.createDataFrame(list(enumerate(["a/", "  b/", "    c.py", "  d.py", "e.py"])), "ord int, line string")
    assert [r["path"] for r in tree.from_listing(listing).where("type = 'file'").orderBy("ord").collect()] == ["a/b/c.py", "a/d.py", "e.py"]


def test_budgets(spark):
    rows = spark.createDataFrame([("a", 50, 6.0), ("b", 40, 5.0), ("c", 30, 4.0), ("d", 20, 3.0), ("e", 15, 2.0), ("f", 10, 1.0)], "path string, cost long, score double")
    for chunk in (1, 2, 100):
        got = budget.skip_overflow(rows, "path", [("score", True), ("path", False)], "cost", 100, chunk).orderBy("rank")
        assert [r["path"] for r in got.collect()] == ["a", "b", "f"]
    assert [r["path"] for r in budget.stop_at_overflow(rows, [F.desc("score")], "cost", 100).orderBy("nth").collect()] == ["a", "b"]
    assert budget.role_budgets(1000, {"source"}) == {"source": 1000} and budget.role_budgets(1000, {"source", "test"})["test"] == 100


KINDS = {
    "src/service/engine.py": "source", "tests/test_engine.py": "test", "src/service/user_pb2.py": "generated", "terraform/main.tf": "infra", "LICENSE": "doc", "a/.hidden/x.py": "hidden",
    "node_modules/x.js": "excluded", "venv/x.py": "excluded", "x/fixtures/a.py": "fixture", "data.bin": "ignored", "plans/a.md": "doc", "x/IntegrationTests/a.py": "test", "Makefile": "source", "build/x.py": "runtime_artifact",
}


def test_classification(spark):
    df = spark.createDataFrame([(p,) for p in KINDS], "path string")
    assert {r["path"]: r["kind"] for r in df.select("path", P.classify(F.col("path"))["kind"].alias("kind")).collect()} == KINDS
    ignored = df.where(P.is_ignored(F.col("path"), ("src/service",), ("*.tf",), (".bin",)))
    assert {r["path"] for r in ignored.collect()} == {"src/service/engine.py", "src/service/user_pb2.py", "terraform/main.tf", "data.bin"}


def test_probe(spark):
    heads = {"ccb": b"#!/usr/bin/env -S python3\nx", "run": b"#!/bin/sh\n", "LICENSE": b"import os\n", "tool": b"import os\nfrom x import y\n", "page": b"<?php echo 1;", "nul": b"a\0b", "bad": b"\xff\xfe", "note": b"hello", "a.py": b""}
    want = {"ccb": ("python", True), "run": (None, True), "LICENSE": (None, False), "tool": ("python", True), "page": ("php", True), "nul": (None, False), "bad": (None, False), "note": (None, False), "a.py": ("python", True)}
    df = spark.createDataFrame([(p, bytearray(h)) for p, h in heads.items()], "path string, head binary")
    assert {r["path"]: tuple(r["p"]) for r in df.select("path", probe.probe(F.col("path"), F.col("head")).alias("p")).collect()} == want


def test_text(spark):
    df = spark.createDataFrame([("abcdefgh\nij\n" + "k" * 50,)], "t string")
    got = df.select(T.truncated_lines(F.col("t"), 4).alias("a"), T.tokens(F.lit("")).alias("b"), T.identifiers(F.lit("a bc d_e bc")).alias("c"), T.path_words(F.lit("see `a/b.py`, and (x).")).alias("d")).first()
    assert got["a"] == "abcdefgh\nij\n... (truncated, 1 lines omitted)" and got["b"] == 1 and got["c"] == ["bc", "d_e"] and "a/b.py" in got["d"]


def test_joins(spark):
    tags = spark.createDataFrame([("a", 0, "f0", "function", 0), ("a", 1, "A", "class", 1), ("a", 2, "f1", "method", 5), ("a", 3, "B", "class", 5), ("a", 4, "f2", "function", 9), ("b", 0, "g", "function", 3)], "path string, ord int, name string, kind string, line int")
    assert {r["name"]: r["parent"] for r in deps.parent_of(tags).collect()} == {"f0": None, "A": None, "f1": "A", "B": None, "f2": "B", "g": None}
    spans = spark.createDataFrame([("a", "outer", 1, 500), ("a", "inner", 10, 20), ("a", "next", 501, 502)], "path string, name string, start long, end long")
    points = spark.createDataFrame([("a", 15), ("a", 501), ("a", 600), ("b", 15)], "path string, line long")
    assert sorted((r["line"], r["enclosing"]) for r in deps.enclosing(points, spans).collect()) == [(15, "outer"), (501, "next")]
    contents = spark.createDataFrame([("pkg/a.py", "import pkg.b\nfrom .c import x\nfrom ..d import y\nimport os"), ("pkg/b.py", ""), ("pkg/c/__init__.py", ""), ("d.py", "import util"), ("src/util.py", "")], "path string, content string")
    assert {(r["src"], r["dst"]) for r in deps.file_dependencies(contents).collect()} == {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c/__init__.py"), ("pkg/a.py", "d.py"), ("d.py", "src/util.py")}
    raw = spark.createDataFrame([("\\PKG\\a.py",), ("/pkg/b.py",), ("../d.py",), ("none.py",)], "raw string")
    assert {r["found"] for r in deps.known(F.col("raw"), raw, contents).collect()} == {"pkg/a.py", "pkg/b.py"}


def power(edges, n, rounds, start=None):
    p = [x / sum(start) for x in start] if start else [1 / n] * n
    out = [sum(w for s, _, w in edges if s == i) for i in range(n)]
    r = p[:]
    for _ in range(rounds):
        loose = sum(r[i] for i in range(n) if not out[i])
        r = [0.85 * (sum(r[s] * w / out[s] for s, d, w in edges if d == i) + loose * p[i]) + 0.15 * p[i] for i in range(n)]
    return r


def test_pagerank(spark):
    edges = [(0, 1, 2.0), (0, 2, 1.0), (0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 0, 1.0), (1, 4, 0.5)]
    v = spark.range(6)
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {r["id"]: r["rank"] for r in graph.pagerank(v, e, rounds=100, tolerance=1e-9).collect()}
    assert all(abs(got[i] - x) < 1e-6 for i, x in enumerate(power(edges, 6, 200)))
    start = spark.createDataFrame([(4, 5.0), (5, 1.0)], "id long, p double")
    got = {r["id"]: r["rank"] for r in graph.pagerank(v, e, start, rounds=7).collect()}
    assert all(abs(got[i] - x) < 1e-9 for i, x in enumerate(power(edges, 6, 7, [0, 0, 0, 0, 5, 1])))
    assert graph.pagerank(v.limit(0), e.limit(0)).collect() == []


def test_cycles_and_rules(spark):
    e = spark.createDataFrame([("c", "a"), ("a", "b"), ("b", "c"), ("b", "a"), ("d", "d")], "src string, dst string")
    assert {tuple(r["cycle"]) for r in graph.back_edge_cycles(e).collect()} == {("a", "b"), ("a", "b", "c")} == {tuple(r["cycle"]) for r in graph.cycles_within(e, 3).collect()}
    modules = spark.createDataFrame([("m", "core", "core", 0.9, 40), ("p", "peripheral", "core", 0.05, 1), ("q", "peripheral", "core", 0.0, 1)], "module string, tier string, role string, core_score double, file_count int")
    files = spark.createDataFrame([("x.py", "p"), ("y.py", ""), ("test_z.py", "p"), ("u.py", "m")], "path string, module string")
    file_deps = spark.createDataFrame([(f"s{i}.py", "x.py") for i in range(5)], "src string, dst string")
    found = rules.run({"files": files, "modules": modules, "module_deps": spark.createDataFrame([("m", "p")], "src string, dst string"), "file_deps": file_deps})
    assert {r["rule_id"] for r in found.collect()} == {"layer-violation", "core-score-anomaly", "orphan-files", "size-imbalance", "zombie-code"}
    assert rules.score(found).first()[0] == 100 - 20 - 5 - 5


def test_memory_in_closed_form_and_by_message(spark):
    said = [["a"], [], ["b"], [], ["a", "c"], *[[]] * 25, ["d"]]
    weights = {}
    for m in said:
        weights = memory.after_message(weights, m)
    turns = spark.createDataFrame([(1, t) for t in range(len(said))], "conv_id long, turn long")
    mentioned = spark.createDataFrame([(1, t, p) for t, m in enumerate(said) for p in m], "conv_id long, turn long, path string")
    assert {r["path"]: r["weight"] for r in mentions.memory(mentioned, turns).collect()} == {p: round(w, 6) for p, w in weights.items()}


def test_memory_as_a_stream(spark, tmp_path):
    kind = "conv_id long, turn long, text string, mentioned array<string>"
    batches = [[(1, 0, "x", ["a"]), (2, 0, "y", None)], [(1, 1, "x", ["b"]), (1, 2, "z", [])]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    stream = memory.follow(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))
    q = stream.writeStream.format("memory").queryName("remembered").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {(r["conv_id"], r["path"]): r["weight"] for r in spark.sql("select * from remembered where turn = 2").collect()}
    assert last == {(1, "a"): 0.64, (1, "b"): 0.8}


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "fix bug add to in on 12 ok"), (2, "Look at Engine and `src/main.py`, parse_tokens; utils.py"), (3, None)], "id long, text string")
    symbols = spark.createDataFrame([("run",)], "name string")
    assert {(r["id"], r["ident"]) for r in mentions.identifiers(texts, symbols).collect()} == {(2, "Look"), (2, "Engine"), (2, "parse_tokens")}
    files = spark.createDataFrame([("src/main.py",), ("src/utils.py",), ("a/same.py",), ("b/same.py",)], "path string")
    assert {(r["id"], r["path"]) for r in mentions.file_mentions(texts, files).collect()} == {(2, "src/main.py"), (2, "src/utils.py")}


def test_incremental(spark):
    now = incremental.hashed(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, desc string"), ["desc"])
    old = incremental.hashed(spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, desc string"), ["desc"])
    assert {r["path"]: r["change"] for r in incremental.delta(now, old).collect()} == {"a": "same", "b": "changed", "c": "added", "d": "removed"}
    assert incremental.plan(incremental.delta(now, now)).first()["mode"] == "reuse" and incremental.plan(incremental.delta(now, old)).first()["mode"] == "full"
    got = incremental.reuse(now, old.withColumn("result", F.lit("kept")), lambda rows: rows.withColumn("result", F.lit("new")))
    assert {r["path"]: r["result"] for r in got.collect()} == {"a": "kept", "b": "new", "c": "new"}
    assert incremental.input_hash(now, ["path", "desc"]).first() == incremental.input_hash(now.orderBy(F.desc("path")), ["path", "desc"]).first()


def test_quality(spark):
    good = json.dumps({"modules": [{"id": f"mod:{i}", "desc": ""} for i in range(8)]})
    rows = [(good,), (f"```json\n{good}\n```",), ("{}",), (good.replace("mod:3", "x"),), (good.replace("mod:3", "mod:4"),), ("nonsense",)]
    got = quality.module_outputs(spark.createDataFrame(rows, "text string")).collect()
    assert [r["fault"] for r in got] == [None, None, "no modules", "bad id", "id twice", "no modules"]
    v = settings.vocabulary(spark)
    new = quality.expanded(v, spark.createDataFrame([("api",), ("fresh-tag",), ("Bad Tag",)], "tag string"))
    assert [r["tag"] for r in new.where("dimension = 'custom'").collect()] == ["fresh-tag"]


def test_archetype(spark):
    df = spark.createDataFrame([(f"{d}/src/f{i}.py",) for d in ("a", "b") for i in range(9)], "path string")
    assert archetype.detect(df).first()[0] == "monorepo" and archetype.detect(df.limit(0)).first()[0] == "generic"
    assert rank.entry_files(spark.createDataFrame([("app/main.py", "source", 0.5), ("x.py", "source", 0.0)], "path string, role string, score double")).first()["score"] == 40.5


def test_index_documents(spark, tmp_path):
    doc = {"version": 2, "modules": [{"id": "m", "desc": "d", "file_count": 1}], "files": {"__init__.py": {"tags": ["x"], "module": "m", "signatures": [{"name": "f", "kind": "function", "line": 3}]}, "b.py": {}}, "file_dependencies": {"b.py": ["__init__.py"]}}
    (tmp_path / "a.json").write_text(json.dumps(doc), encoding="utf-8")
    (tmp_path / "b.json").write_text("{broken", encoding="utf-8")
    t = index_json.tables(index_json.read(spark, str(tmp_path / "*.json")))
    assert [(r["path"], r["module"], r["n_sigs"]) for r in t["files"].orderBy("ord").collect()] == [("__init__.py", "m", 1), ("b.py", "", 0)]
    assert t["signatures"].first()["name"] == "f" and t["file_deps"].first()["dst"] == "__init__.py" and t["modules"].first()["module"] == "m"


def test_snapshots(spark, files, tmp_path):
    at = str(tmp_path / "archive")
    first = snapshots.save(spark, {"files": files.limit(2)}, at, "one", "20240101T000000_000000Z")
    second = snapshots.save(spark, {"files": files}, at)
    assert first < second and snapshots.resolve(spark, at, "latest~1") == first == snapshots.resolve(spark, at, first)
    assert snapshots.load(spark, at, "files").count() == 6 and snapshots.load(spark, at, "files", "latest~1").count() == 2
    with pytest.raises(LookupError):
        snapshots.resolve(spark, at, "latest~7")


TREE = {
    "pkg/__init__.py": "", "pkg/engine.py": '"""Runs things."""\nfrom .util import helper\nclass Engine:\n    def run(self):\n        return helper()\n', "pkg/util.py": "def helper():\n    return 1\n", "web/app.js": "export class App {}\nfunction start() {}\n",
    "tests/test_engine.py": "import pkg.engine\ndef test_run():\n    pkg.engine.Engine().run()\n", "README.md": "# hi", ".hidden/x.py": "x = 1", "broken.py": "def (",
}


def test_a_tree_from_end_to_end(spark, tmp_path):
    for path, content in TREE.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(content, encoding="utf-8")
    index = api.build(spark, str(tmp_path))
    assert {r["path"] for r in index["files"].collect()} == set(TREE) - {"README.md", ".hidden/x.py"}
    sigs = {(r["path"], r["name"], r["kind"], r["line"], r["parent"]) for r in index["signatures"].collect()}
    assert ("pkg/engine.py", "run", "method", 3, "Engine") in sigs and ("web/app.js", "App", "class", 0, None) in sigs
    assert {(r["src"], r["dst"]) for r in index["file_deps"].collect()} == {("pkg/engine.py", "pkg/util.py"), ("tests/test_engine.py", "pkg/engine.py")}
    raw = spark.createDataFrame(list(TREE.items()), "path string, content string")
    assert ("pkg/engine.py:run", "pkg/util.py:helper") in {(r["caller"], r["callee"]) for r in code.call_dependencies(raw).collect()}
    assert "mod:pkg" in api.overview(index)["content"] and "Runs things" in api.expand(index, "mod:pkg", 3)["content"]
    assert api.expand(index, "pkg/", 3, 5)["consumed_tokens"] <= 5 and api.search(index, pattern="engine").count() == 2
    assert api.rank(index, ["pkg/util.py"]).first()["path"] == "pkg/util.py"
    assert "pkg/engine.py" in {r["path"] for r in api.navigate(index, "what does engine do").collect()}
    assert api.diff(index, index)["magnitude"].first()[0] == 0 and api.findings(index).count() > 0
