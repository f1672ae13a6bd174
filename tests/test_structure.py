"""Ranked definitions, tree texts, neighbourhoods, frames, archetypes, hash chains, spans, outputs, caches: by hand on small data."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gneiss import api
from gneiss.operators import archetype, deps, graph, incremental, prompts, quality, rank, tree, viz
from gneiss.sources import code, snapshots, spans, tree_source
from gneiss.sources.cache_store import CacheStore


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# -- definitions by rank


def test_definitions_get_their_users_ranks(spark):
    definitions = spark.createDataFrame([("a.py", "used", 3), ("a.py", "unused", 9), ("b.py", "helper", 1)], "path string, name string, line int")
    references = spark.createDataFrame([("used", "b.py"), ("used", "c.py"), ("used", "c.py"), ("helper", "c.py")], "name string, path string")
    edges = graph.definition_edges(definitions, references)
    assert rows(edges.withColumn("weight", F.round("weight", 3)), "src", "dst", "name", "weight") == [("b.py", "a.py", "used", 1.0), ("c.py", "a.py", "used", 1.414), ("c.py", "b.py", "helper", 1.0)]
    ranks = spark.createDataFrame([("a.py", 0.5), ("b.py", 0.2), ("c.py", 0.3)], "id string, rank double")
    spread = {(r["path"], r["name"]): r["rank"] for r in graph.ranked_definitions(edges, ranks).collect()}
    both = 1 + 2**0.5
    assert spread[("a.py", "used")] == pytest.approx(0.2 + 0.3 * 2**0.5 / both) and spread[("b.py", "helper")] == pytest.approx(0.3 / both)
    best = rank.ranked_tags(definitions, graph.ranked_definitions(edges, ranks), ranks).orderBy(*rank.tag_order()).collect()
    assert [(r["path"], r["name"]) for r in best] == [("a.py", "used"), ("b.py", "helper"), ("c.py", "")]  # files that nobody refers to come last


def test_symbol_ranking_follows_references_not_the_alphabet(spark, tmp_path):
    """Two hundred definitions that come first by name, and one that everybody calls."""
    (tmp_path / "aaa.py").write_text("\n".join(f"def a{i}():\n    pass" for i in range(200)))
    (tmp_path / "zzz.py").write_text("def engine_entry():\n    pass\n")
    for i in range(6):
        (tmp_path / f"user{i}.py").write_text("from zzz import engine_entry\n\n\ndef go():\n    engine_entry()\n")
    index = api.build(spark, str(tmp_path))
    tags = api.ranked_tags(index).orderBy(*rank.tag_order()).collect()
    assert (tags[0]["path"], tags[0]["name"]) == ("zzz.py", "engine_entry")
    by_symbol = {r["path"]: r["score"] for r in api.rank(index, method="symbol").collect()}
    assert by_symbol["zzz.py"] > by_symbol["aaa.py"]
    api.release(index)


# -- trees


def test_tree_text_by_hand(spark):
    paths = ["b.py", "A.py", "c.log", "src/x.py", "src/y.py", "src/z.py", "src/core/deep/w.py", "vendor/v.js", ".git/config", ".github/ci.yml", "docs/history/old.md", "pkg.egg-info/P"]
    n = tree.nodes(spark.createDataFrame([(p,) for p in paths], "path string"))
    text = lambda *a: [r["line"] for r in tree.tree_text(n, *a).orderBy("nth").collect()]
    assert text(10_000, 2, 3, 2) == [
        "./", "  A.py", "  b.py", "  .github/", "    ci.yml", "  docs/", "  src/", "    x.py", "    y.py", "    ... (+1 more files)", "    core/", "      ... (0 files, 1 dirs)",
    ]
    assert text(10_000, 2, 1, 1) == ["./", "  A.py", "  b.py", "  .github/", "    ... (1 files, 0 dirs)", "  ... (+2 more dirs)"]
    assert text(20, 1, 3, 2, 2) == ["./", "  A.py", "  .github/ (1 files, 0 dirs)", "  docs/ (0 files, 0 dirs)", "  ... (+1 more top-level dirs)"]
    assert tree.tree_text(n.limit(0), 100).count() == 0


def test_nested_values(spark):
    files = spark.createDataFrame([("src/a.py", 5), ("src/b.py", 2), ("x.py", None)], "path string, size int")
    n = tree.nodes(files).join(tree.treemap(files), "id")
    got = json.loads(tree.nested(n).first()["json"])
    assert got == {"name": ".", "value": 8, "children": [{"name": "src", "value": 7, "children": [{"name": "a.py", "value": 5}, {"name": "b.py", "value": 2}]}, {"name": "x.py", "value": 1}]}
    with pytest.raises(ValueError):
        tree.nested(n, most=2)


# -- neighbourhoods and frames


def test_neighbourhood_is_breadth_first_and_bounded(spark):
    calls = [("f.py:a", "g.py:b", 3), ("g.py:b", "h.py:c", 1), ("k.py:d", "f.py:a", 5), ("h.py:c", "z.py:e", 9), ("q.py:x", "q.py:y", 9)]
    edges = spark.createDataFrame(calls, "caller string, callee string, weight int")
    assert rows(graph.function_neighbourhood(edges, "f.py", 1), "hop", "id") == [(0, "f.py:a"), (1, "g.py:b"), (1, "k.py:d")]
    assert rows(graph.function_neighbourhood(edges, "f.py", 2), "hop", "id")[-1] == (2, "h.py:c")
    assert rows(graph.function_neighbourhood(edges, "f.py", 3, most=2), "id") == [("f.py:a",), ("k.py:d",)]  # more calls first
    near = graph.function_neighbourhood(edges, "f.py", 1)
    assert rows(viz.function_links(edges, near), "caller", "callee", "width") == [("f.py:a", "g.py:b", 2.5), ("k.py:d", "f.py:a", 3.5)]
    assert graph.function_neighbourhood(edges, "none.py").count() == 0


def test_frames_share_one_ring(spark):
    told = [("s1", "m1", 0.5), ("s1", "m2", 0.4), ("s2", "m1", 0.6), ("s3", "m2", 0.7), ("s3", "m3", 0.1)]
    modules = spark.createDataFrame([(s, m, c, "core", "core", 1) for s, m, c in told], "snapshot_id string, module string, core_score double, tier string, role string, file_count int")
    got = viz.frames_layout(modules)
    assert rows(got, "frame", "module", "present", "core_score") == [(1, "m1", True, 0.5), (1, "m2", True, 0.4), (2, "m1", True, 0.6), (2, "m2", False, 0.4), (3, "m1", False, 0.6), (3, "m2", True, 0.7), (3, "m3", True, 0.1)]
    assert len({(r["module"], r["x"], r["y"]) for r in got.collect()}) == 3
    links = spark.createDataFrame([("s1", "m1", "m2", 10), ("s2", "m1", "m2", 1), ("s3", "m2", "m3", 100)], "snapshot_id string, src string, dst string, weight int")
    assert rows(viz.frame_links(links, modules), "snapshot_id", "width") == [("s1", 3.0), ("s3", 5.0)]


# -- archetypes: paths as a reader would write them


def kind(spark, paths, descs=(), root=""):
    modules = spark.createDataFrame([(i, d) for i, d in enumerate(descs)], "ord int, desc string")
    return archetype.detect(spark.createDataFrame([(p,) for p in paths], "path string"), modules, root).first()["archetype"]


@pytest.mark.parametrize(
    "paths,descs,root,want",
    [
        ([f"x/router_{i}.py" for i in range(7)], [], "", "service"),
        ([f"{i}.svelte" for i in range(9)], [], "", "frontend"),
        ([f"lib/x{i}.py" for i in range(12)], [], "", "generic"),
        ([f"pkg/src/x{i}.py" for i in range(10)], [], "", "library"),
        ([f"pkg/tests/src/x{i}.py" for i in range(12)], [], "", "generic"),
        ([f"m/{i}.tf" for i in range(6)], [], "", "infra"),
        (["deploy/k8s/a.yml", "x/helm/b", "docker-compose.yml", "a.hcl", "b.hcl"], [], "", "generic"),
        ([f"a/src/{i}.c" for i in range(8)] + [f"b/{i}.c" for i in range(7)] + ["b/go.mod"], [], "", "monorepo"),
        ([f"a/src/{i}.c" for i in range(8)] + [f"b/{i}.c" for i in range(8)], [], "", "generic"),
        (["x.txt"], ["An HTTP Gateway"], "", "service"),
        (["x.txt"], ["words", "a PARSER"], "", "library"),
        (["x.txt"], ["words"] * 16 + ["a parser"], "", "generic"),
        (["x.txt"], [], "Infrastructure", "infra"),
        ([], ["a parser"], "ops", "generic"),
    ],
)
def test_archetypes(spark, paths, descs, root, want):
    if not paths:
        assert archetype.detect(spark.createDataFrame([], "path string"), None, root).first()["archetype"] == want
    else:
        assert kind(spark, paths, descs, root) == want


def test_entry_reasons_by_archetype(spark):
    assert "api.py" not in archetype.entry_reasons("generic") and archetype.entry_reasons(" Service ")["api.py"] == "API entry/handler surface"
    assert {"api.py", "app.tsx", "main.py"} <= archetype.entry_reasons("monorepo").keys() and "main.tf" in archetype.entry_reasons("infra")
    files = spark.createDataFrame([("x/api.py", "source", 0.5), ("x/main.py", "source", 0.0), ("x/main.ts", "source", 0.0), ("x/mycli.sh", "source", 0.0), ("t/main.py", "test", 9.0)], "path string, role string, score double")
    got = {r["path"]: (r["reason"], r["score"]) for r in rank.entry_files(files, "service").collect()}
    assert got == {"x/api.py": ("API entry/handler surface", 50.5), "x/main.py": ("Main process entry", 50.0), "x/main.ts": ("main application entry", 40.0), "x/mycli.sh": ("CLI entry point", 30.0)}
    assert "x/api.py" not in {r["path"] for r in rank.entry_files(files, "generic").collect()}


# -- hash chains and caches


def test_a_change_invalidates_what_depends_on_it_and_nothing_else(spark):
    old = spark.createDataFrame([("a/x", "a", "1"), ("a/y", "a", "2"), ("b/z", "b", "3")], "path string, module string, hash string")
    new = spark.createDataFrame([("a/x", "a", "1"), ("a/y", "a", "9"), ("b/z", "b", "3")], "path string, module string, hash string")
    verdicts = {(r["stage"], r["key"]): r["verdict"] for r in incremental.stale(incremental.chain(new), incremental.chain(old)).collect()}
    assert verdicts == {("file", "a/x"): "reuse", ("file", "a/y"): "recompute", ("file", "b/z"): "reuse", ("module", "a"): "recompute", ("module", "b"): "reuse", ("project", ""): "recompute"}
    gone = incremental.stale(incremental.chain(old.where("module = 'a'")), incremental.chain(old))
    assert rows(gone.where("verdict = 'drop'"), "stage", "key") == [("file", "b/z"), ("module", "b")]
    assert {r["verdict"] for r in incremental.stale(incremental.chain(old), incremental.chain(old)).collect()} == {"reuse"}


def test_cache_commits_by_partition(spark, tmp_path):
    store = CacheStore(spark, f"{tmp_path}/cache", parts=8)
    assert store.load("module") is None
    kind = "key string, hash string, result string"
    store.commit({"module": spark.createDataFrame([(f"m{i}", "h", f"r{i}") for i in range(40)], kind)})
    before = store.manifest()["stages"]["module"]
    store.commit({"module": spark.createDataFrame([("m3", "h2", "new")], kind), "project": spark.createDataFrame([("", "p", "all")], kind)})
    after = store.manifest()["stages"]["module"]
    assert sum(before[p] != after[p] for p in before) == 1  # one partition is written anew
    got = {r["key"]: r["result"] for r in store.load("module").collect()}
    assert len(got) == 40 and got["m3"] == "new" and got["m4"] == "r4" and store.load("project").count() == 1
    store.commit({}, drop={"module": spark.createDataFrame([("m3",), ("m5",)], "key string")})
    assert not {"m3", "m5"} & {r["key"] for r in store.load("module").collect()} and store.load("module").count() == 38
    store.clear()
    assert store.load("module") is None and store.manifest()["run"] == 0


def test_a_killed_commit_leaves_the_old_cache(spark, tmp_path):
    store = CacheStore(spark, f"{tmp_path}/cache", parts=4)
    kind = "key string, hash string, result string"
    store.commit({"file": spark.createDataFrame([("a", "1", "old"), ("b", "1", "old")], kind)})
    broken = spark.createDataFrame([("a", "2", "new")], kind).withColumn("result", F.when(F.col("key") == "a", F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"file": spark.createDataFrame([("b", "2", "new")], kind), "other": broken})
    assert rows(store.load("file"), "key", "result") == [("a", "old"), ("b", "old")] and store.load("other") is None

    real = store._publish

    def stopped(manifest):
        raise KeyboardInterrupt

    store._publish = stopped
    with pytest.raises(KeyboardInterrupt):
        store.commit({"file": spark.createDataFrame([("a", "3", "new")], kind)})
    store._publish = real
    assert rows(store.load("file"), "key", "result") == [("a", "old"), ("b", "old")]
    late = store.manifest() | {"run": 1}
    with pytest.raises(RuntimeError, match="another run"):
        store._publish(late)
    store.commit({"file": spark.createDataFrame([("a", "4", "newer")], kind)})
    assert rows(store.load("file"), "key", "result") == [("a", "newer"), ("b", "old")]


# -- spans of blocks

SOURCES = {
    "javascript": (
        '// function nope() {\n/* class No { */\nclass Box extends Base {\n  constructor(x) { this.x = "}{"; }\n  async get(key) {\n    if (key) { return `a ${b} }`; }\n    return /[}{]/.test(key);\n  }\n}\n'
        "function outer(a, b) {\n  function inner() { return 1; }\n  return inner();\n}\nconst add = (a, b) => {\n  return a + b;\n};\nconst one = x => x + 1;\n",
        [("Box", "class", 3, 9), ("constructor", "method", 4, 4), ("get", "method", 5, 8), ("outer", "function", 10, 13), ("inner", "function", 11, 11), ("add", "function", 14, 16), ("one", "function", 17, 17)],
        ["test", "inner"],
    ),
    "go": (
        'package main\n// func no() {\ntype Box struct {\n\ta int // }\n}\ntype ID int\nfunc (b *Box) Get(key string) (string, error) {\n\ts := "}"\n\tr := \'}\'\n\treturn do(s), nil\n}\nfunc main() {\n\tx := func() { }\n\tb.Get("k")\n}\n',
        [("Box", "class", 3, 5), ("ID", "type", 6, 6), ("Get", "method", 7, 11), ("main", "function", 12, 15)],
        ["Get"],
    ),
    "rust": (
        "/* outer /* inner { */ } */\npub struct Box<'a> { v: &'a str }\nimpl<'a> Box<'a> {\n    pub fn get(&self) -> &'a str {\n        let c = '}'; let r = r#\"}\"}\"#;\n        helper(c)\n    }\n}\npub async fn helper<T: Copy>(x: T) -> T { x }\ntrait Shape { fn area(&self) -> f64; }\n",
        [("Box", "class", 2, 2), ("get", "method", 4, 7), ("helper", "function", 9, 9), ("Shape", "class", 10, 10), ("area", "method", 10, 10)],
        ["helper"],
    ),
    "java": (
        'package a;\n/** class No { } */\npublic class Box<T> extends Base implements I {\n    private final String s = "}";\n    public Box(int x) { super(x); }\n    @Override\n    public List<String> get(String key) throws IOException {\n        Runnable r = new Runnable() { public void run() { go(); } };\n        return list(key);\n    }\n    interface Inner { void f(); }\n}\n',
        [("Box", "class", 3, 12), ("Box", "method", 5, 5), ("get", "method", 7, 10), ("run", "method", 8, 8), ("Inner", "class", 11, 11)],
        ["Runnable", "list"],
    ),
    "c": (
        "#define M(x) { x\nstruct point { int x; };\n/* int no() { */\nstatic int add(int a,\n               int b)\n{\n    char c = '}';\n    return sum(a, b);\n}\nint decl(int a);\nint main(void) {\n    if (add(1, 2)) { return 0; }\n}\n",
        [("point", "class", 2, 2), ("add", "function", 4, 9), ("main", "function", 11, 13)],
        ["sum", "add"],
    ),
    "ruby": (
        '# class No\nclass Box < Base\n  def get(key)\n    if key\n      "end"\n    end\n    fetch(key)\n  end\n  def self.make; new; end\nend\nmodule M\n  def ok?\n    true\n  end\nend\n',
        [("Box", "class", 2, 10), ("get", "method", 3, 8), ("make", "method", 9, 9), ("M", "class", 11, 15), ("ok?", "method", 12, 14)],
        ["fetch"],
    ),
    "php": (
        '<?php\n# function no() {\nabstract class Box implements I {\n    public function get($key) {\n        return $this->find("}") ;\n    }\n    abstract function none();\n}\nfunction helper() { return 1; }\n',
        [("Box", "class", 3, 8), ("get", "method", 4, 6), ("none", "method", 7, 7), ("helper", "function", 9, 9)],
        ["find"],
    ),
    "cpp": (
        "namespace n {\nclass Box : public Base {\n public:\n  Box(int x) : x_(x) { init(); }\n  int get() const override { return x_; }\n  int x_;\n};\n}\nint n::Box::other(int a) { return a; }\n",
        [("n", "class", 1, 8), ("Box", "class", 2, 7), ("Box", "method", 4, 4), ("get", "method", 5, 5), ("other", "function", 9, 9)],
        ["init"],
    ),
    "kotlin": (
        'class Box(val x: Int) {\n    fun get(k: String): String = find(k)\n    fun run() { println("}") }\n}\ndata class P(val a: Int)\nfun main() { Box(1).run() }\n',
        [("Box", "class", 1, 4), ("get", "method", 2, 2), ("run", "method", 3, 3), ("P", "class", 5, 5), ("main", "function", 6, 6)],
        ["find", "println", "Box", "run"],
    ),
}


@pytest.mark.parametrize("language", SOURCES)
def test_spans_of_nested_and_commented_code(language):
    text, defined, called = SOURCES[language]
    found = spans.tags_of(text, language)
    own = [(t.name, t.kind, t.line + 1, t.end + 1) for t in found if t.tag == "def"]
    assert own == [x for x in defined] or (language == "javascript" and own == [(n, k, a, 7 if n == "get" else b) for n, k, a, b in defined])
    assert [t.name for t in found if t.tag == "ref"] == called
    assert spans.tags_of("", language) == spans.tags_of(None, language) == []


@pytest.mark.parametrize("language", sorted(spans.BLANKS))
def test_spans_take_no_square_time(language):
    for unit in ("{", "(", '"', "/*", "f(", "a.", "class A ", "::a", "f<"):
        spans.tags_of(unit * 5_000, language)


def test_calls_between_functions_of_go_files(spark):
    contents = spark.createDataFrame([("a.go", "package a\nfunc A() {\n\tB()\n}\n"), ("b.go", "package a\nfunc B() {\n}\n")], "path string, content string")
    got = code.call_dependencies(contents)
    assert rows(got, "caller", "callee") == [("a.go:A", "b.go:B")]


# -- snapshots, outputs, changed trees, vocabulary


def test_damaged_snapshots_are_set_aside(spark, tmp_path):
    archive = f"{tmp_path}/archive"
    files = spark.createDataFrame([("a.py", "m")], "path string, module string")
    for name in ("20240101", "20240102", "20240103"):
        snapshots.save(spark, {"files": files.withColumn("module", F.lit(name))}, archive, name, name)
    part = max((p for p in os.listdir(f"{archive}/snapshots") if p.endswith(".parquet")), key=lambda p: os.path.getsize(f"{archive}/snapshots/{p}"))
    data = open(f"{archive}/snapshots/{part}", "rb").read()
    open(f"{archive}/snapshots/{part}", "wb").write(data[: len(data) // 2])
    os.remove(f"{archive}/snapshots/.{part}.crc")
    left = [r["id"] for r in snapshots.listed(spark, archive).collect()]
    assert len(left) == 2 and set(left) < {"20240101", "20240102", "20240103"}
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in snapshots.damaged(spark, archive).collect()] == [(part, "cut off")]
    assert snapshots.load(spark, archive, "files", left[0]).first()["module"] == left[0]
    assert snapshots.damaged(spark, archive, "files").count() == 0


def test_broken_documents_are_set_aside(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"_snapshot": {"snapshot_id": "2", "snapshot_created_at": "t"}, "files": {}}))
    (tmp_path / "a.json").write_text('{"files": {')
    (tmp_path / "c.json").write_text("[1]")
    (tmp_path / "d.json").write_text("{}")
    sound, broken = snapshots.documents(spark, str(tmp_path))
    assert [(r["snapshot_id"], r["created_at"]) for r in sound.collect()] == [("2", "t"), ("d", "")]
    assert rows(broken.withColumn("path", F.substring_index("path", "/", -1)), "path", "reason") == [("a.json", "no JSON"), ("c.json", "no object")]


def test_outputs_are_repaired_or_set_aside(spark):
    inputs = spark.createDataFrame([(i,) for i in range(4)], "id int")
    seen = []

    def call(open_):
        seen.append(rows(open_, "id", "was"))
        good = F.to_json(F.struct(F.lit("o").alias("overview"), F.lit("a").alias("architecture"), F.lit("s").alias("scale")))
        return open_.where("id <> 3").select("id", F.when((F.col("id") == 0) | ((F.col("id") == 1) & F.col("was").isNotNull()), good).otherwise(F.lit("{}")).alias("text"))

    accepted, left = quality.repaired(inputs, call, quality.project_outputs, 2)
    assert rows(accepted, "id", "attempt") == [(0, 1), (1, 2)]
    assert {r["id"]: r["faults"] for r in left.collect()} == {2: ["no overview", "no architecture", "no scale"], 3: ["no output"]}
    assert seen == [[(0, None), (1, None), (2, None), (3, None)], [(1, "{}"), (2, "{}"), (3, None)]]


def test_brief_paths_may_be_directories(spark):
    places = quality.known_places(spark.createDataFrame([("src/api/x.py",)], "path string"))
    assert rows(places, "place") == [("src",), ("src/api",), ("src/api/x.py",)]
    brief = {"summary": "s", "reading_order": [{"path": "src/", "why": "w"}, {"path": "src", "why": "again"}, {"path": "srcx", "why": "w"}], "architecture_axes": [], "risk_hotspots": [{"risk": "r", "reason": "q"}]}
    outputs = spark.createDataFrame([(1, json.dumps(brief)), (2, "{}"), (3, None)], "id int, text string")
    faults = {r["id"]: r["faults"] for r in quality.brief_faults(outputs, places).collect()}
    assert faults == {1: ["reading_order[2] unknown path"], 2: ["no summary", "no reading_order", "no architecture_axes", "no risk_hotspots"], 3: ["no object"]}
    assert rows(quality.brief_kept(outputs, places), "part", "path", "said") == [("reading_order", "src/", "w"), ("risk_hotspots", "", "r: q")]


def test_changes_of_a_tree_between_two_looks(spark, tmp_path):
    for name, text in (("same.py", "1"), ("edit.py", "2"), ("old.py", "3"), ("gone.py", "4"), ("touch.py", "5")):
        (tmp_path / name).write_text(text)
    none = spark.createDataFrame([], "path string, size long, changed long, hash string")
    first = tree_source.changed_since(spark, str(tmp_path), none).cache()
    assert {r["change"] for r in first.collect()} == {"added"}
    (tmp_path / "edit.py").write_text("22")
    (tmp_path / "old.py").rename(tmp_path / "new.py")
    (tmp_path / "gone.py").unlink()
    (tmp_path / "more.py").write_text("6")
    os.utime(tmp_path / "touch.py", ns=(1, 1))
    before = spark.createDataFrame(first.select("path", "size", "changed", "hash").collect(), "path string, size long, changed long, hash string")
    got = tree_source.changed_since(spark, str(tmp_path), before)
    assert {r["path"]: (r["change"], r["was"]) for r in got.collect()} == {
        "same.py": ("same", ""), "edit.py": ("changed", ""), "new.py": ("renamed", "old.py"), "gone.py": ("removed", ""), "more.py": ("added", ""), "touch.py": ("same", ""),
    }
    assert {r["path"] for r in got.collect() if r["content"] is not None} == {"edit.py", "new.py", "more.py", "touch.py"}  # what held wasn't read
    hit = incremental.reuse(got.where("change <> 'removed'").select("path", "hash"), before.select("path", "hash", F.col("hash").alias("result")), lambda miss: miss.select("path", "hash", F.lit("computed").alias("result")))
    assert rows(hit.where("result = 'computed'"), "path") == [("edit.py",), ("more.py",), ("new.py",)]


def test_vocabulary_hash_is_that_of_canonical_json(spark):
    import hashlib

    words = {"role": ["lib", "test", "lib"], "domain": ["été", 'a"b', "\U0001f600"]}
    frame = spark.createDataFrame([(d, t) for d, ts in words.items() for t in ts], "dimension string, tag string")
    want = hashlib.sha256(json.dumps({k: sorted(v) for k, v in sorted(words.items())}, sort_keys=True).encode()).hexdigest()[:16]
    assert prompts.vocabulary_hash(frame).first()["hash"] == want
    snap = prompts.vocabulary_snapshot(frame.withColumn("ord", F.monotonically_increasing_id())).first()["snapshot"]
    assert sorted(snap) == ["domain", "role"] and snap["role"] == ["lib", "test", "lib"]


# -- maps, listings, reports


def test_project_map_of_a_tree(spark, tmp_path):
    for p in ("shop/main.py", "shop/core/a.py", "shop/core/b.py", "shop/tests/test_a.py", "docs/x.md", "tools/mycli.py", "node_modules/z.js"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("def f():\n    pass\n")
    index = api.build(spark, str(tmp_path))
    text = api.project_map(index, "shop")
    api.release(index)
    assert text.startswith("## Project Map\n\n### Workspace Layout\n\n- `shop/`: ") and "- `tools/`: Engineering tooling and utilities" in text and "node_modules" not in text
    assert "### Entry Points\n\n- `shop/main.py`: Main process entry\n- `tools/mycli.py`: CLI entry point" in text
    assert "- `shop/`: 3 source files, 1 tests; entry `shop/main.py`; core `shop/core, shop/main.py`" in text
    assert "1. Read `shop/main.py` to understand `shop` runtime entry." in text and "- `shop`: ~3 source files" in text


def test_listings_cross_ranges(spark):
    lines = ["a/", "  b/", "    c.py", "", "  d.py", "e/", "  f/", "    g/", "      h.py", "i.py"]
    frame = spark.createDataFrame(list(enumerate(lines)), "ord int, line string").repartition(5)
    got = [(r["path"], r["type"]) for r in tree.from_listing(frame).orderBy("ord").collect()]
    assert got == [("a", "dir"), ("a/b", "dir"), ("a/b/c.py", "file"), ("a/d.py", "file"), ("e", "dir"), ("e/f", "dir"), ("e/f/g", "dir"), ("e/f/g/h.py", "file"), ("i.py", "file")]
    assert tree.from_listing(frame.limit(0)).count() == 0


def test_callers_and_report_lines(spark):
    edges = spark.createDataFrame([("a", "z", 2), ("b", "z", 5), ("a", "z", 4), ("c", "y", 1)], "caller string, callee string, weight int")
    assert rows(graph.callers(edges, 1), "callee", "n_callers", "calls", "callers") == [("y", 1, 1, ["c"]), ("z", 2, 11, ["a"])]
    from gneiss.functions import text as T

    told = spark.createDataFrame([("p", 3, 6), ("p", 9, 6), ("p", 1, 0)], "label string, done int, total int")
    assert [r[0] for r in told.select(T.progress_line(F.col("label"), F.col("done"), F.col("total"), 10)).collect()] == ["p: [#####.....] 3/6 ( 50.0%)", "p: [##########] 6/6 (100.0%)", "p: [..........] 0/0 (  0.0%)"]
    times = spark.createDataFrame([(0.25,), (5.26,), (123.0,), (3600.5,)], "s double")
    assert [r[0] for r in times.select(T.duration(F.col("s"))).collect()] == ["250ms", "5.3s", "2m03.0s", "60m00.5s"]
    stamps = spark.createDataFrame([("2024-01-31T10:20:30Z",), ("2024-01-31T10:20:30.5+02:00",), ("2024-13-31T10:20:30Z",), ("soon",), (None,)], "t string")
    assert [r[0] for r in stamps.select(T.date_label(F.col("t"), F.lit("20240131T102030_000001Z"))).collect()] == ["2024-01-31 10:20", "2024-01-31 10:20", "20240131T102030", "20240131T102030", "20240131T102030"]


def test_calls_and_changes_of_a_tree(spark, tmp_path, capsys):
    from gneiss import cli

    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("from b import helper\n\n\ndef run():\n    helper()\n")
    (root / "b.py").write_text("def helper():\n    pass\n")
    index = api.build(spark, str(root))
    got = api.calls(index, "a.py")
    assert rows(got["links"], "caller", "callee", "weight") == [("a.py:run", "b.py:helper", 1)]
    assert rows(got["nodes"], "id", "hop", "size") == [("a.py:run", 0, 25), ("b.py:helper", 1, 15)]
    api.release(index)
    kept = f"{tmp_path}/listing"
    assert rows(api.changed(spark, str(root), kept), "path", "change") == [("a.py", "added"), ("b.py", "added")]
    assert api.changed(spark, str(root), kept).count() == 0
    (root / "b.py").rename(root / "c.py")
    (root / "a.py").write_text("x = 1\n")
    assert rows(api.changed(spark, str(root), kept), "path", "change", "was") == [("a.py", "changed", ""), ("c.py", "renamed", "b.py")]
    assert api.changed(spark, str(root), kept).count() == 0
    cli.main(["clear", str(root), "--cache", kept])
    assert not os.path.exists(kept)
    cli.main(["map", str(root)])
    assert "## Project Map" in capsys.readouterr().out


def test_ranks_over_names_are_those_over_edges(spark):
    """Definitions that are repeated, used where they are, or used there alone; and ten times the uses and definitions of a name shuffle ten times the rows, not a hundred."""
    r = random.Random(5)
    files = [f"f{i}.py" for i in range(30)]
    definitions = [(r.choice(files), f"name_{r.randrange(12)}", i) for i in range(60)] + [("f0.py", "alone", 1), ("f1.py", None, 2), (None, "name_1", 3)]
    references = [(r.choice(files), f"name_{r.randrange(14)}") for _ in range(150)] + [("f0.py", "alone"), (None, "name_1"), ("f2.py", None)]
    d, u = spark.createDataFrame(definitions, "path string, name string, line int"), spark.createDataFrame(references, "path string, name string")
    vertices = spark.createDataFrame([(f,) for f in files], "id string")
    edges = graph.definition_edges(d, u, ["name_3"], ["f4.py"])
    for start in (None, graph.focus_start(vertices, ["f3.py"], ["f5.py"])):
        ranks = graph.pagerank(vertices, edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), start, rounds=6)
        want = rank.ranked_tags(d, graph.ranked_definitions(edges, ranks), ranks, 9)
        got = rank.tags_of_definitions(vertices, d, u, ["name_3"], ["f4.py"], start, 6)
        said = lambda df: sorted(map(str, df.select("path", "name", "line", F.round("rank", 9), F.round("of_file", 9)).collect()))
        assert said(got) == said(want)

    def kept(n: int) -> int:
        one = spark.range(n).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("hot").alias("name"))
        return sum(x.count() for x in graph.name_links(one, one))

    assert kept(100) == 200 and kept(1000) == 2000


def test_enclosing_spans_without_pairs(spark):
    """Against all pairs, in long and short stretches; no join makes a row for each point and span."""
    r = random.Random(6)
    points = [(r.choice("ab"), r.randrange(-5, 300), i) for i in range(300)] + [(None, 3, 900), ("a", None, 901)]
    spans = [(r.choice("ab"), f"s{i}", at, at + r.choice([-2, 0, 3, 40, 150])) for i, at in enumerate(r.randrange(300) for _ in range(60))]
    p, s = spark.createDataFrame(points, "path string, line long, ord long"), spark.createDataFrame(spans, "path string, name string, start long, end long")
    around = {o: min(((a, -b, n) for f, n, a, b in spans if f == path and a <= line <= b), default=None) for path, line, o in points if path and line is not None}
    want = sorted((o, x[2]) for o, x in around.items() if x)
    for width in (1, 7, 64, 1000):
        got = deps.enclosing(p, s, width)
        assert rows(got, "ord", "enclosing") == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_calls_are_counted_before_they_meet_definitions(spark):
    r = random.Random(7)
    references = spark.createDataFrame([(r.choice("ab"), f"f{r.randrange(4)}", r.randrange(100)) for _ in range(400)], "path string, name string, line long").distinct()
    definitions = spark.createDataFrame([(p, f"f{i}") for p in "abc" for i in range(4) if (p, i) != ("c", 1)], "path string, name string")
    spans = spark.createDataFrame([(p, f"f{i}", 20 * i, 20 * i + 15) for p in "ab" for i in range(4)], "path string, name string, start long, end long")
    want = graph.call_dependencies(deps.call_edges(references, definitions, spans))
    calls, callees = graph.counted_calls(deps.calls_by_name(references, spans), ["caller", "name"]), deps.callees(definitions)
    assert calls.count() <= 8 * 4 < want.count()
    columns = ["caller", "callee", "weight", "lines"]
    assert rows(graph.call_pairs(calls, callees), *columns) == rows(want, *columns)
    columns = ["callee", "n_callers", "calls", "callers"]
    for most in (2, 10):
        assert rows(graph.callers_by_name(calls, callees, most), *columns) == rows(graph.callers(want, most), *columns)


def test_first_children_are_cut_where_tasks_run(spark):
    n = tree.nodes(spark.createDataFrame([(p,) for p in ["d/b", "d/a", "d//a", "d/c/x", "/d/e", "f"]], "path string"))
    assert rows(n, "id", "name", "depth")[:2] == [("dir:.", ".", 0), ("dir:d", "d", 1)] and rows(n.where("name = 'x'"), "id", "parent_id") == [("file:d/c/x", "dir:d/c")]
    assert n.count() == n.distinct().count()
    placed = tree._placed(n, 2, 1)
    assert "WindowGroupLimit" in placed._jdf.queryExecution().executedPlan().toString()
    assert max(r["nth"] for r in placed.where("type = 'dir'").collect()) == 1


def test_modules_are_looked_up_once(spark):
    """Forty files that import one module and one beside them: two questions, not eighty."""
    paths = [f"p/m{i}.py" for i in range(40)] + ["p/near.py", "src/far.py", "near.py"]
    contents = spark.createDataFrame([(p, "import far\nfrom .near import x\nimport far") for p in paths], "path string, content string")
    asked = []
    real = deps.import_candidates
    deps.import_candidates = lambda imports: asked.append(imports.count()) or real(imports)
    try:
        got = rows(deps.file_dependencies(contents), "src", "dst", "weight")
    finally:
        deps.import_candidates = real
    assert asked == [4]  # far, and near from p, from src and from the top
    want = [(p, "src/far.py", 2.0) for p in paths if p != "src/far.py"] + [(p, "p/near.py", 1.0) for p in paths if p.startswith("p/") and p != "p/near.py"]
    assert got == sorted(want)


def test_reference_edges_take_the_tasks_they_need(spark):
    one = spark.range(50).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("hot").alias("name"))
    few, many = graph.reference_edges(one, one), graph.reference_edges(one, one, rows_a_task=100)
    assert many.rdd.getNumPartitions() == 25 and rows(few, "src", "dst", "weight") == rows(many, "src", "dst", "weight")
