"""What kind of repository it is, from its paths: counts of path kinds by one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P

# Marks of a project's root.
MARKERS = "pyproject.toml package.json go.mod cargo.toml pom.xml build.gradle".split()
# In order, an archetype, how many paths make it, and what a path of it (in lower case) ends in or holds.
FRONTEND_ENDS, FRONTEND_WORDS = ".tsx .jsx .vue .svelte .css .scss".split(), ["vite.config", "next.config"]
INFRA_ENDS, INFRA_WORDS = ".tf .hcl docker-compose.yml docker-compose.yaml".split(), ["/k8s/", "/helm/"]
SERVICE_WORDS = ["/server", "/gateway", "/api/", "http", "router"]
LIBRARY_WORD, LIBRARY_NOT = "/src/", ["/tests/", "/test/"]
LEAST = {"frontend": 8, "infra": 6, "service": 6, "library": 10}
# Words of the first 16 modules' descriptions, and names of the root, that tell where paths don't.
SAID = [("service", ["gateway", "proxy", "router", "server"]), ("library", ["indexing", "parser", "library", "sdk"])]
FIRST_MODULES = 16
INFRA_ROOTS = ["infra", "infrastructure", "ops"]

# Why a reader would start at a file, for all repositories and by archetype.
ENTRY_REASONS = {
    "pyproject.toml": "Python project and dependency manifest", "package.json": "Node project and script manifest", "go.mod": "Go module manifest",
    "cargo.toml": "Rust crate manifest", "__main__.py": "CLI/runtime bootstrap", "main.py": "Main process entry", "main_solver.py": "Main solver orchestration entry",
    "run.py": "Runtime launcher entry", "start.py": "Runtime launcher entry", "serve.py": "Server startup entry", "bootstrap.py": "Bootstrap sequence entry",
    "launcher.py": "Launcher entry", "entrypoint.py": "Container/runtime entrypoint", "main.go": "Main process entry", "main.rs": "Main process entry",
    "cli.py": "Command-line entry", "server.py": "Server entry", "http_proxy.py": "HTTP proxy entry", "project_router.py": "Per-project request routing",
    "dashboard.html": "Admin dashboard UI",
}
SERVICE_REASONS = {"api.py": "API entry/handler surface", "router.py": "HTTP routing surface", "gateway.py": "Gateway or edge orchestration"}
FRONTEND_REASONS = {"vite.config.ts": "Frontend bundler/runtime config", "next.config.js": "Frontend runtime config", "app.tsx": "Frontend application entry", "main.tsx": "Frontend application entry"}
INFRA_REASONS = {"main.tf": "Infrastructure root module entry", "terragrunt.hcl": "Infrastructure orchestration entry"}

# What top directories are called and hold, words in their names, and what else they are by archetype.
ARCHETYPES = "monorepo service library frontend infra generic".split()
DIRECTORIES = {
    "src": "Primary application/source code", "lib": "Reusable library source code", "app": "Application entry code", "apps": "Multiple application packages",
    "services": "Service packages", "packages": "Shared packages/modules", "modules": "Feature modules", "tests": "Automated tests and validation suites",
    "test": "Automated tests and validation suites", "docs": "Documentation and references", "scripts": "Developer/CI automation scripts",
    "tools": "Engineering tooling and utilities", "configs": "Configuration templates and profiles", "config": "Configuration templates and profiles",
    "infra": "Infrastructure and deployment assets", "deploy": "Deployment definitions", "gateway": "Request gateway/edge logic", "web": "Web frontend assets",
    "frontend": "Frontend application code", "backend": "Backend service code", "abstract_class": "Abstract interfaces and shared base classes",
    "problem_solvers": "Problem-specific solver implementations", "meta_coding": "Meta-programming and code-generation pipeline",
    "algebraic_solver": "Numerical/algebraic solver implementations", "visualization": "Visualization, plotting, and report utilities",
}
DIRECTORY_WORDS = [
    ("solver solvers engine", "Problem-solving and algorithm execution components"),
    ("meta codegen generator compiler transform", "Meta-programming and code transformation components"),
    ("visual plot chart render", "Visualization and presentation components"),
    ("abstract base interface", "Abstract contracts and foundational components"),
    ("algebra numeric linear math", "Numerical and mathematical computation components"),
    ("model network nn", "Model definitions and runtime components"),
    ("data dataset loader", "Data processing and loading components"),
]
OTHERWISE = {"monorepo": "Workspace project/package", "service": "Service component", "frontend": "Frontend component/module", "infra": "Infrastructure component", "library": "Library component"}


def normal(value: str | None) -> str:
    """A known archetype, however it is spelled; generic otherwise."""
    value = (value or "").strip().lower()
    return value if value in ARCHETYPES else "generic"


def described(directory: Column, archetype: str) -> Column:
    """What a top directory holds: by its name, by a word in it, by the archetype."""
    low = F.lower(directory)
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in DIRECTORIES.items() for x in kv]), low)
    worded = F
    for words, said in DIRECTORY_WORDS:
        worded = worded.when(low.rlike("|".join(words.split())), said)
    return F.coalesce(out, worded.otherwise(OTHERWISE.get(normal(archetype), "Workspace module")))


def entry_reasons(archetype: str) -> dict[str, str]:
    """Names of entry files of a repository of this archetype, and why they are."""
    kind = normal(archetype)
    out = dict(ENTRY_REASONS)
    if kind in ("service", "monorepo"):
        out |= SERVICE_REASONS
    if kind in ("frontend", "monorepo"):
        out |= FRONTEND_REASONS
    return out | INFRA_REASONS if kind == "infra" else out


def kinds_of(low: Column) -> dict[str, Column]:
    """What a path in lower case tells: archetype to predicate."""
    held = lambda words: P.any_of([F.contains(low, F.lit(w)) for w in words])
    ends = lambda words: P.any_of([low.endswith(w) for w in words])
    return {"frontend": ends(FRONTEND_ENDS) | held(FRONTEND_WORDS), "infra": ends(INFRA_ENDS) | held(INFRA_WORDS), "service": held(SERVICE_WORDS), "library": held([LIBRARY_WORD]) & ~held(LIBRARY_NOT)}


def counts(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """files(path) -> files, projects (top directories of 8 files with a marker or a src folder) and a count for each kind of path.

    One row, or one for each repository that the columns ``by`` tell apart; all by partial sums.
    """
    by = by or []
    split = F.split("path", "/")
    mark = F.lower(P.name(F.col("path"))).isin(MARKERS) | F.exists(F.slice(split, 2, 1_000_000), lambda p: F.lower(p) == "src")
    told = files.select(*by, F.get(split, F.lit(0)).alias("top"), mark.cast("int").alias("mark"), *[k.alias(name) for name, k in kinds_of(F.lower("path")).items()])
    tops = told.groupBy(*by, "top").agg(F.count("*").alias("n"), F.sum("mark").alias("marks"), *[F.count_if(name).alias(name) for name in LEAST])
    return tops.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count_if((F.col("n") >= 8) & (F.col("marks") >= 1)).alias("projects"), *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in LEAST])


def detect(files: DataFrame, modules: DataFrame | None = None, root: str | Column = "", by: list[str] | None = None) -> DataFrame:
    """files(path), modules(ord, desc), the root's name -> archetype: one row, or one for each repository told apart by ``by``.

    Paths decide, then what the first modules are said to be, then the root's name.
    """
    by = by or []
    kind = F.when(F.col("files") == 0, "generic").when(F.col("projects") >= 2, "monorepo")
    for name, least in LEAST.items():
        kind = kind.when(F.col(name) >= least, name)
    told = counts(files, by)
    if modules is not None:
        if by:
            first = modules.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).where(F.col("nth") <= FIRST_MODULES)
        else:
            first = modules.orderBy("ord").limit(FIRST_MODULES)
        low = F.lower(F.coalesce("desc", F.lit("")))
        words = first.groupBy(*by).agg(*[F.coalesce(F.bool_or(P.any_of([F.contains(low, F.lit(w)) for w in ws])), F.lit(False)).alias(f"said_{k}") for k, ws in SAID])
        told = told.join(words, by, "left") if by else told.join(F.broadcast(words))  # one row
        for k, _ in SAID:
            kind = kind.when(F.col(f"said_{k}"), k)
    name = F.lit(root) if isinstance(root, str) else root
    return told.select(*by, kind.when(F.lower(name).isin(INFRA_ROOTS), "infra").otherwise("generic").alias("archetype"))


def reason_rows() -> list[tuple[str, str, str]]:
    """archetype, name, reason: the entry files of every archetype as rows of a small fixed table."""
    return [(kind, name, reason) for kind in ARCHETYPES for name, reason in entry_reasons(kind).items()]
