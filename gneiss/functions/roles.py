"""Roles, bonuses and tiers of files and modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions import paths as P

# A role's path patterns and tags, in the order in which they are tried.
PATH_ROLES = [
    (r"(^|/)tests?/", "test"), (r"(^|/)test_[^/]*$", "test"), (r"_test\.py$", "test"), (r"_spec\.py$", "test"), (r"(^|/)conftest\.", "test"),
    (r"(?i)\.md$", "docs"), (r"(^|/)docs/", "docs"), (r"(?i)(^|/)README", "docs"), (r"(?i)(^|/)LICENSE", "docs"), (r"(?i)(^|/)CHANGELOG", "docs"),
    (r"\.(yml|yaml|toml|cfg|ini)$", "infra"), (r"(^|/)setup\.[^/]*$", "infra"), (r"(^|/)Makefile$", "infra"), (r"(^|/)Dockerfile", "infra"), (r"(^|/)\.env", "infra"),
    (r"(^|/)cli/", "interface"), (r"(^|/)mcp/", "interface"), (r"(^|/)viz/", "interface"), (r"(^|/)ui/", "interface"), (r"(^|/)web/", "interface"),
]
TAG_ROLES = [("test spec mock", "test"), ("entrypoint cli ui mcp web", "interface"), ("config setup ci adapter util helper", "infra"), ("docs asset", "docs")]
ROLE_ORDER = ["core", "interface", "infra", "test", "docs"]
BONUSES = [("entrypoint", 1.0), ("entry", 1.0), ("main", 1.0), ("api", 0.8), ("lib", 0.8), ("core", 0.8), ("service", 0.8), ("util", 0.6), ("helper", 0.6), ("config", 0.4), ("setup", 0.4), ("test", 0.2), ("spec", 0.2), ("mock", 0.2)]
CORE, SECONDARY, TESTS = 0.30, 0.10, 0.7
PROMPT_CONFIG_NAMES = "pyproject.toml setup.cfg setup.py makefile dockerfile .env tox.ini noxfile.py".split()
PROMPT_CONFIG_EXTS = ".yml .yaml .toml .cfg .ini".split()


def has_tag(tags: Column, words: str) -> Column:
    return F.coalesce(F.exists(tags, lambda t: F.lower(t).isin(words.split())), F.lit(False))


def file_role(path: Column, tags: Column) -> Column:
    """Role of a file: by path, then by tag, else core."""
    role = F
    for pattern, named in PATH_ROLES:
        role = role.when(path.rlike(pattern), F.lit(named))
    for words, named in TAG_ROLES:
        role = role.when(has_tag(tags, words), F.lit(named))
    return role.otherwise(F.lit("core"))


def role_bonus(tags: Column) -> Column:
    """Bonus of the first tag that holds a keyword; within a tag the first keyword counts."""

    def of(tag: Column) -> Column:
        bonus = F
        for word, value in BONUSES:
            bonus = bonus.when(F.contains(F.lower(tag), F.lit(word)), F.lit(value))
        return bonus.otherwise(F.lit(None).cast("double"))

    return F.coalesce(F.get(F.filter(F.transform(tags, of), lambda b: b.isNotNull()), F.lit(0)), F.lit(0.0))


def tier(score: Column, test_ratio: Column) -> Column:
    """Tier by score; modules of tests mostly can't be core."""
    guarded = (test_ratio >= TESTS) & (score >= CORE)
    return F.when(guarded, "secondary").when(score >= CORE, "core").when(score >= SECONDARY, "secondary").otherwise("peripheral")


def prompt_role(path: Column, tags: Column) -> Column:
    """source, test, config or docs."""
    n = F.lower(P.name(path))
    in_tests = F.exists(P.parts(path), lambda p: F.lower(p).isin("tests", "test", "__tests__"))
    return (
        F.when(in_tests | n.rlike(r"^(test_|conftest\.)|(_test|_spec)\.py$"), "test")
        .when(n.isin(PROMPT_CONFIG_NAMES) | P.suffix(path).isin(PROMPT_CONFIG_EXTS), "config")
        .when(P.is_doc(path), "docs")
        .when(has_tag(tags, "test spec mock"), "test")
        .when(has_tag(tags, "config ci setup"), "config")
        .when(has_tag(tags, "docs asset"), "docs")
        .otherwise("source")
    )
