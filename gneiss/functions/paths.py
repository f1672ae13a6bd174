"""Path expressions: parts, languages, and the file classification cascade."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".rb": "ruby",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".cs": "c_sharp", ".scala": "scala", ".sc": "scala", ".dart": "dart", ".php": "php", ".el": "elisp", ".ex": "elixir", ".exs": "elixir", ".elm": "elm",
    ".hs": "haskell", ".jl": "julia", ".ml": "ocaml", ".mli": "ocaml_interface", ".ql": "ql", ".zig": "zig", ".f": "fortran", ".f90": "fortran",
    ".f95": "fortran", ".f03": "fortran", ".for": "fortran", ".m": "matlab", ".hcl": "hcl", ".tf": "hcl",
}
# Names and directories by what they hold.
EXCLUDED_DIRS = "vendor vendors third_party third-party node_modules dist build target out bin obj coverage htmlcov .next .nuxt .svelte-kit .parcel-cache .cache tmp temp .tmp release-flow-test local-test-env .tox .eggs .gradle .dart_tool .terraform __pycache__ site-packages".split()
VIRTUAL_ENVS = [".venv", "venv", "env"]
INFRA_DIRS = "infra terraform helm charts k8s deploy deployment".split()
FIXTURE_DIRS = "fixtures fixture mocks mock testdata samples sample_data".split()
TEST_DIRS = "test tests __tests__ spec specs unittest unittests integrationtest integrationtests e2e e2etests benchmark benchmarks benches".split()
ARTIFACT_DIRS = ".pytest_cache .mypy_cache .ruff_cache __pycache__ snapshots dist build".split()
ARTIFACT_NAMES = "opencode.json latest-context.json latest-context-history.jsonl code-signatures.json architect-metrics.json phase1-cache.json phase2-cache.json phase3-cache.json tag-vocab.json tree.json tree-diff.json structure-prompt.md".split()
DOC_STEMS = "readme changelog changes license licence authors contributors copying notice".split()
SOURCE_NAMES = "makefile dockerfile justfile jenkinsfile rakefile gemfile vagrantfile brewfile".split()
NOISE_SEGMENTS = ".git __pycache__ node_modules build dist .pytest_cache .mypy_cache .ruff_cache .tox .nox .venv venv env vendor tmp fangan plans claude_skills history snapshots".split()
NOISE_SUFFIXES = ".log .pid .tmp .cache .val .pyc .pyo".split()
NOISE_NAMES = [".ds_store", "thumbs.db"]


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def dirs(path: Column) -> Column:
    p = parts(path)
    return F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last extension in lower case with its dot; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def normal(part: Column) -> Column:
    return F.regexp_replace(F.lower(part), r"(?U)[^\p{Alnum}]", "")


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, suffix(path))


def is_hidden(path: Column) -> Column:
    return F.exists(parts(path), lambda p: p.startswith("."))


def is_artifact(path: Column) -> Column:
    n = name(path)
    late = n.startswith("latest-context") & suffix(path).isin(".json", ".jsonl")
    return F.exists(parts(path), lambda p: p.isin(ARTIFACT_DIRS)) | n.isin(ARTIFACT_NAMES) | n.endswith("-viz.html") | late


def is_doc(path: Column) -> Column:
    named = F.lower(stem(path)).rlike("^(" + "|".join(DOC_STEMS) + ")")
    planned = (suffix(path) == ".md") & F.exists(dirs(path), lambda p: F.lower(p) == "plans")
    return named | suffix(path).isin(".rst", ".adoc", ".txt") | planned


def excluded_dir(path: Column) -> Column:
    """Why a parent directory excludes a path: the first directory that does, or null."""
    hit = F.filter(F.transform(dirs(path), F.lower), lambda p: p.isin(VIRTUAL_ENVS + EXCLUDED_DIRS) | normal(p).isin(EXCLUDED_DIRS))
    first = F.get(hit, F.lit(0))
    return F.when(first.isin(VIRTUAL_ENVS), "virtualenv").otherwise(first)


def is_fixture(path: Column) -> Column:
    return F.exists(dirs(path), lambda p: normal(p).isin(FIXTURE_DIRS))


def is_infra(path: Column) -> Column:
    return suffix(path).isin(".tf", ".hcl") | F.exists(dirs(path), lambda p: normal(p).isin(INFRA_DIRS))


def is_generated(path: Column) -> Column:
    return F.lower(name(path)).rlike(r"\.min\.js$|\.bundle\.js$|\.pb\.go$|\.generated\.|\.gen\.|_generated\.|_pb2\.py|_pb2_grpc\.py")


def is_test_dir(part: Column) -> Column:
    n = normal(part)
    return n.isin(TEST_DIRS) | n.rlike("(tests|specs)$")


def is_test(path: Column) -> Column:
    named = F.lower(name(path)).rlike(r"^(test_|spec_)|_test\.(py|go|rb|dart)$|_spec\.(py|rb)$|\.test\.|\.spec\.|test\.php$")
    return F.exists(dirs(path), is_test_dir) | named


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression for Java and RE2; a pattern without a slash matches at any depth."""
    body = fnmatch.translate(glob).replace("(?s:", "").replace(")\\Z", "").replace(")\\z", "")
    return f"^(.*/)?{body}$" if not glob.startswith("/") else f"^{body}$"


def is_ignored(path: Column, paths: tuple[str, ...] = (), globs: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> Column:
    tests = [F.lit(False)]
    tests += [(path == p) | path.startswith(f"{p}/") for p in paths]
    tests += [path.rlike(glob_pattern(g)) for g in globs]
    tests += [suffix(path).isin(*extensions)] if extensions else []
    return any_of(tests)


def classify(path: Column, is_code: Column | None = None, **rules: tuple[str, ...]) -> Column:
    """kind, reason, first_party, in_architecture, in_test_support; the first rule that holds decides.

    ``is_code``: a probe's verdict for files without an extension; else the extension decides.
    """
    code = language(path).isNotNull() | F.lower(name(path)).isin(SOURCE_NAMES) if is_code is None else is_code
    because = excluded_dir(path)

    def out(kind: str, reason: Column | str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
            F.lit(kind not in ("excluded", "hidden", "runtime_artifact")).alias("first_party"),
            F.lit(kind == "source").alias("in_architecture"),
            F.lit(kind == "test").alias("in_test_support"),
        )

    return (
        F.when(is_ignored(path, **rules), out("excluded", "architecture_rules"))
        .when(is_hidden(path), out("hidden", "hidden"))
        .when(is_artifact(path), out("runtime_artifact", "runtime_artifact"))
        .when(because.isNotNull(), out("excluded", because))
        .when(is_doc(path), out("doc", "documentation"))
        .when(is_fixture(path), out("fixture", "fixture"))
        .when(is_infra(path), out("infra", "infrastructure"))
        .when(is_generated(path), out("generated", "generated"))
        .when(is_test(path), out("test", "test"))
        .when(~code, out("ignored", "unsupported"))
        .otherwise(out("source", ""))
    )


def in_tree(path: Column) -> Column:
    """Stricter than ``classify``: tests, docs, fixtures and infra are out at any depth, the leaf too."""
    banned = F.exists(parts(path), lambda p: F.lower(p).isin(VIRTUAL_ENVS + EXCLUDED_DIRS) | normal(p).isin([*EXCLUDED_DIRS, *FIXTURE_DIRS, *INFRA_DIRS, "docs"]) | is_test_dir(p))
    plain = ~(is_hidden(path) | is_artifact(path) | banned | is_doc(path)) & (path != "")
    return plain & ((suffix(path) == "") | classify(path)["in_architecture"])


def is_noise(path: Column) -> Column:
    """Paths that listings leave out."""
    n = F.lower(name(path))
    return F.exists(parts(path), lambda p: F.lower(p).isin(NOISE_SEGMENTS)) | n.isin(NOISE_NAMES) | any_of([n.endswith(s) for s in NOISE_SUFFIXES])


def safe_path(raw: Column) -> Column:
    """A path as it may be looked up, or null: slashes forward, no leading one, no step upward."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), r"^\s+|\s+$", ""), r"^(\./|/)+", "")
    return F.when((clean != "") & ~F.exists(F.split(clean, "/"), lambda p: p == ".."), clean)
