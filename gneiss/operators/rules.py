"""Architecture rules as frames of findings: rule_id, severity, subject, detail (JSON)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import paths as P
from gneiss.operators import graph as G
from gneiss.plans.lineage import cut

# Extensions of files that aren't code, names that run without being imported.
NON_CODE = ".md .txt .rst .adoc .json .yaml .yml .toml .cfg .ini .env .sh .bash .zsh .fish .bat .ps1 .html .css .svg .xml .xsl .png .jpg .jpeg .gif .ico .webp .lock .sum .mod .scm".split()
RUN_DIRECTLY = "cli.py __main__.py __init__.py conftest.py setup.py".split()

Rule = Callable[[dict[str, DataFrame]], DataFrame]


def findings(df: DataFrame, rule: str, severity: str, subject: Column, **detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), subject.alias("subject"), F.to_json(F.struct(*[v.alias(k) for k, v in detail.items()])).alias("detail"))


def fan_in(t: dict[str, DataFrame]) -> DataFrame:
    """How often each file is imported: counted once for all rules, if ``run`` has."""
    return t["fan_in"] if "fan_in" in t else G.fan_in(t["file_deps"])


def layer_violation(t: dict[str, DataFrame]) -> DataFrame:
    m = t["modules"].select("module", "tier", "role")
    src = m.where("tier = 'core' and role <> 'interface'").select(F.col("module").alias("src"))
    dst = m.where("tier = 'peripheral'").select(F.col("module").alias("dst"))
    hit = t["module_deps"].join(src, "src").join(dst, "dst")
    return findings(hit, "layer-violation", "critical", F.col("src"), target=F.col("dst"))


def circular_dependency(t: dict[str, DataFrame]) -> DataFrame:
    c = G.back_edge_cycles(t["module_deps"])
    return findings(c, "circular-dependency", "warning", F.array_join("cycle", ">"), cycle=F.col("cycle"))


def core_score_anomaly(t: dict[str, DataFrame]) -> DataFrame:
    low = t["modules"].where("tier = 'peripheral'").select("module")
    hit = fan_in(t).where("fan_in >= 5").join(t["files"].select("path", "module"), "path").join(low, "module")
    return findings(hit, "core-score-anomaly", "warning", F.col("path"), fan_in=F.col("fan_in"), module=F.col("module"))


def high_fan_out(t: dict[str, DataFrame]) -> DataFrame:
    out = t["module_deps"].groupBy("src").agg(F.count("*").alias("n")).where("n >= 6")
    return findings(out, "high-fan-out", "info", F.col("src"), out_degree=F.col("n"))


def orphan_files(t: dict[str, DataFrame]) -> DataFrame:
    lost = t["files"].where("module = ''")
    listed = lost.agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 0")
    return findings(listed, "orphan-files", "info", F.col("n").cast("string"), files=F.col("n"))


def size_imbalance(t: dict[str, DataFrame]) -> DataFrame:
    counts = t["modules"].select("module", "file_count")
    middle = counts.agg(F.median("file_count").alias("median"))
    limit = F.greatest(F.col("median") * 3, F.lit(15.0))
    hit = counts.join(F.broadcast(middle)).where(F.col("file_count") >= limit)
    return findings(hit, "size-imbalance", "warning", F.col("module"), file_count=F.col("file_count"), threshold=limit)


def zombie_files(t: dict[str, DataFrame]) -> DataFrame:
    """Code files that nothing imports, in modules of little score (or none)."""
    n = P.name(F.col("path"))
    runs = n.isin(RUN_DIRECTLY) | n.startswith("test_") | n.endswith("_test.py")
    code = t["files"].where((P.suffix(F.col("path")) != "") & ~P.suffix(F.col("path")).isin(NON_CODE) & ~runs).select("path", "module")
    scores = t["modules"].select("module", "core_score")
    return code.join(fan_in(t), "path", "left_anti").join(scores, "module", "left").where(F.coalesce("core_score", F.lit(0.0)) < 0.1).select("path", "module")


def zombie_code(t: dict[str, DataFrame]) -> DataFrame:
    listed = zombie_files(t).agg(F.count("*").alias("n")).where("n > 0")
    return findings(listed, "zombie-code", "info", F.col("n").cast("string"), files=F.col("n"))


#: In the order in which they run; a new rule is a new entry.
RULES: dict[str, Rule] = {
    "circular-dependency": circular_dependency,
    "core-score-anomaly": core_score_anomaly,
    "high-fan-out": high_fan_out,
    "layer-violation": layer_violation,
    "orphan-files": orphan_files,
    "size-imbalance": size_imbalance,
    "zombie-code": zombie_code,
}


def run(tables: dict[str, DataFrame], only: list[str] | None = None) -> DataFrame:
    """files(path, module), modules(module, tier, role, core_score, file_count), module_deps(src, dst), file_deps(src, dst) -> all findings."""
    names = [n for n in RULES if only is None or n in only]
    if {"core-score-anomaly", "zombie-code"} <= {*names}:
        tables = tables | {"fan_in": cut(G.fan_in(tables["file_deps"]))}  # two rules read it
    return reduce(DataFrame.unionByName, [RULES[n](tables) for n in names])


def score(found: DataFrame) -> DataFrame:
    points = F.coalesce(F.sum(F.when(F.col("severity") == "critical", 20).when(F.col("severity") == "warning", 5).otherwise(0)), F.lit(0))
    return found.agg(F.greatest(F.lit(0), 100 - points).cast("long").alias("score"))


def worst_first(found: DataFrame) -> DataFrame:
    grave = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("severity").orderBy("rule_id", "subject"))).orderBy(grave, "nth")
